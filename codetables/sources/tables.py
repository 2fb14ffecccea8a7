"""Index tables on disk, partitioned by repository: replacing, removing, checked vector writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.operators import retrieval

TABLES = ("files", "symbols", "imports", "edges", "chunks")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below spark.checkpoint.dir and read it back: true sizes for the optimizer, and no recomputation after a lost executor."""
    sc = df.sparkSession.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session has shuffle partitions.

    Spark merges shuffle partitions by their bytes; rows that are small but costly to work on would end in one task.
    """
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def write(df: DataFrame, root: str, table: str) -> None:
    """Rewrite the partitions of the repositories in ``df``; others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("repo_id").parquet(f"{root}/{table}")


def remove(spark: SparkSession, root: str, table: str, repo_ids: list[str]) -> None:
    """Drop whole partitions of the named repositories, through Spark's file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for repo in repo_ids:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/repo_id={repo}")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            fs.delete(path, True)


def replace_index(spark: SparkSession, root: str, repo_ids: list[str], new: dict[str, DataFrame]) -> None:
    """Replace all tables of the named repositories, also of those for which ``new`` has no row."""
    for table, df in new.items():
        mine = df.where(F.col("repo_id").isin(repo_ids))
        present = [r.repo_id for r in mine.select("repo_id").distinct().collect()]  # of the named repositories only
        write(mine, root, table)
        remove(spark, root, table, [r for r in repo_ids if r not in present])


def write_vectors(chunks: DataFrame, root: str, dimension: int) -> str | None:
    """Write chunk vectors if all have the dimension; else nothing, and a warning.  Structure tables are another job."""
    q = retrieval.quality(chunks, dimension).first()
    if q.null_vectors or q.wrong_dimension:
        return f"{q.null_vectors} chunks without a vector, {q.wrong_dimension} of another dimension than {dimension}"
    write(chunks, root, "chunk_vectors")
    return None
