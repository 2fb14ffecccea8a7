"""Operator 1: token ids as flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

The format, in one folder:

* ``tokens-*.bin``: ids of whole documents one after another, little-endian unsigned, 16 bits where the
  vocabulary allows it, else 32;
* ``offsets-*.bin``: for each document of that part its first id's place in the whole collection, and one
  more for the end, as little-endian unsigned 64-bit integers;
* ``docids-*.bin``: the documents' ids as little-endian signed 64-bit integers;
* a Parquet table ``manifest`` with a row per part: its files, counts and bases.

Documents are range-partitioned and sorted by id; each task streams its part to its own files.  A part's
base is the prefix sum of the counts of the parts before it, over a table with one row per part.  A lost
task leaves files that no manifest row names; its repetition writes others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm import chunks, files
from codetables.llm.common import documents, parallelism, prefix_bases, shared_folder, written

PARTS = "part int, tokens string, docids string, n_docs long, n_null_ids long, n_tokens long, lengths string"


def write(df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False) -> tuple[str, DataFrame]:
    """Write the documents of ``df`` in ascending id order; (folder, manifest).

    Each text is encoded whole, null as empty, and followed by ``end_id``.  Rows with a null id come first;
    equal ids are ordered by text, so repeated rows are adjacent.  An empty table gives a manifest without
    rows.  Columns other than the two are ignored, whatever their names.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(parallelism(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunks.encoder(tokenizer, drops_space)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part, n, nulls = batch.column(2)[0].as_py(), 0, 0
                (tokens, out), (docids, ids_out), (lengths, lengths_out) = (files.new_file(folder, f"{k}-{part:06d}", ".bin") for k in ("tokens", "docids", "lengths"))
                total = 0
            nulls += batch.column(0).null_count
            ids_out.write(np.ascontiguousarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), "<i8").tobytes())
            for texts in chunks.groups(batch.column(1).to_pylist(), len, 1 << 20):
                got = enc.encode(texts)
                sizes = np.array([len(x) // width + 1 for x in got], "<u8")
                lengths_out.write(sizes.tobytes())
                for x in got:
                    out.write(x)
                    out.write(end)
                n, total = n + len(got), total + int(sizes.sum())
        if out is not None:
            for f in (out, ids_out, lengths_out):
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "tokens": tokens, "docids": docids, "n_docs": n, "n_null_ids": nulls, "n_tokens": total, "lengths": lengths}], pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("docids", pa.string()), ("n_docs", pa.int64()), ("n_null_ids", pa.int64()), ("n_tokens", pa.int64()), ("lengths", pa.string())]))

    parts = written(sorted_rows.mapInArrow(run, PARTS), "token-parts")
    bases = prefix_bases(parts, "part", {"base": F.col("n_tokens"), "doc_base": F.col("n_docs")})
    placed = parts.join(F.broadcast(bases), "part")  # both have one row per part

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                sizes = files.mapped(folder, r.pop("lengths"), "<u8")
                starts = np.zeros(len(sizes) + 1, "<u8")
                np.cumsum(sizes, out=starts[1:])
                r["offsets"], out = files.new_file(folder, f"offsets-{r['part']:06d}", ".bin")
                with out:
                    out.write((starts + np.uint64(r["base"])).astype("<u8").tobytes())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("docids", pa.string()), ("n_docs", pa.int64()), ("n_null_ids", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("doc_base", pa.int64()), ("offsets", pa.string())]))

    manifest = placed.repartition(parallelism(spark), "part").mapInArrow(offsets, "part int, tokens string, docids string, n_docs long, n_null_ids long, n_tokens long, base long, doc_base long, offsets string")
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return folder, spark.read.schema(manifest.schema).parquet(path)


def part_arrays(folder: str, row: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of one manifest row, mapped."""
    return files.mapped(folder, row["tokens"], dtype), files.mapped(folder, row["offsets"], "<u8"), files.mapped(folder, row["docids"], "<i8")


def dtype_of(tokenizer: str) -> str:
    return chunks.encoder(tokenizer, False).dtype.str


def read_digests(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets, docids = part_arrays(folder, r, dtype)
                ids = ids.view(np.ndarray)
                starts = offsets.astype(np.int64)
                local = (starts - r["base"]).tolist()
                for i in range(0, len(docids), 4096):
                    j = min(i + 4096, len(docids))
                    crc = [zlib.crc32(ids[local[k] : local[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
                    null = np.arange(i, j) < r["n_null_ids"]
                    yield pa.record_batch([pa.array(np.asarray(docids[i:j], np.int64), mask=null), pa.array(starts[i:j]), pa.array(np.diff(starts[i : j + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = manifest.repartition(parallelism(manifest.sparkSession), "part")  # a small table would else be one task
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder, manifest = write(documents(spark, sf_dir), path, end_id=0)
    return read_digests(manifest, folder, dtype_of(path))
