"""Shared folders, written intermediate tables, joins of uneven groups and Arrow helpers of the operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm import files

#: Groups of more rows than this (at least) are joined by a broadcast of their few keys; keys that such a broadcast holds at most.
HEAVY, HEAVY_KEYS = 1000, 10_000


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees; without one nothing is written anywhere."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root; retries and repeated runs never meet in one folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor repeats one stage, not the whole job), fixes values that
    depend on the partitioning, and gives the optimizer true sizes.
    """
    return _write(df, shared_folder(df.sparkSession, name))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, which ``clear`` deletes once its result is written.

    A frame that reads a cleared table can't be used any more, so only what the operator has written elsewhere leaves it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self.spark, name)
        self.paths.append(path)
        return _write(df, path)

    def clear(self) -> None:
        for path in self.paths:
            fs, at = files.store(path)
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                fs.delete_dir(at)
        self.paths = []


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the contract's fold number."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty, without decoding."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batches_of(rows: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """``make`` of slices of at most ``most`` rows: Spark bounds the bytes of a batch, this the Python objects made of it."""
    for batch in rows:
        for at in range(0, batch.num_rows, most):
            yield make(batch.slice(at, most))


def by_key(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(key, its rows) of rows that are sorted by their first column; one key's rows are in memory at a time."""
    key, held = None, []
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if held and keys[begin] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield key, pa.Table.from_batches(held)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of rows with one row per group, of which ``size`` is the number of rows.

    The keys of large groups (more than HEAVY rows and more than 1/HEAVY_KEYS of all, so HEAVY_KEYS at most) are broadcast:
    no task gets a whole large group.  All others meet by a merge join.  Keys are not null; ``groups`` is a written table.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    most = max(HEAVY, (total or 0) // HEAVY_KEYS)
    is_heavy = F.col(size) > most
    heavy = groups.where(is_heavy)
    if (largest or 0) <= most:
        return rows.join(groups.hint("merge"), key)
    few = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(groups.where(~is_heavy).hint("merge"), key)
    return few.unionByName(rows.join(F.broadcast(heavy), key))


def prefix_bases(df: DataFrame, part: str, totals: dict[str, Column]) -> DataFrame:
    """One row per partition number: what all earlier partitions hold, for each named total.

    The window below runs over one row per partition, a number that the session sets, never over data.
    """
    from pyspark.sql import Window

    sums = df.groupBy(part).agg(*(F.sum(c).alias(f"_t_{k}") for k, c in totals.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).cast("long").alias(k) for k in totals))


def with_columns(df: DataFrame, text_col: str, names: list[str], types: list[str], make: Callable[[list], list[pa.Array]]) -> tuple[DataFrame, list[str]]:
    """``df`` with further columns that ``make`` computes from the texts of a batch; (frame, the names given).

    A name that ``df`` has already gets underscores, so no column is lost.
    """
    given = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        given.append(name)
    at = df.columns.index(text_col)
    n = len(df.columns)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows, lambda b: pa.record_batch([*b.columns[:n], *make(b.column(at).to_pylist())], [*b.schema.names, *given]))

    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields))
    for name, kind in zip(given, types, strict=True):
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema), given
