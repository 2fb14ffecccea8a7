"""Operator 8: contiguous shards of near equal size, cut from global prefix sums of the byte sizes.

Only DataFrame functions.  Rows are range-partitioned by id; totals per partition, summed over the
partitions before it, give each partition its base; a running sum inside the partition does the rest.
Shard k gets the rows that begin in the k-th equal part of all bytes, so two shards differ by no more
than the largest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm.common import documents, parallelism, prefix_bases, written


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``df``.

    size: UTF-8 bytes of the text plus 1; a null text has none and counts as empty.  Rows are in order of
    id (null first), then of size, checksum and a hash of the text, then as read; equal rows may lie on both sides of
    a cut.  Slots count from 0 in each shard.  An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "size", "text_crc32", "tie", "row"]
    rows = written(rows.repartitionByRange(parallelism(spark), *order).withColumn("part", F.spark_partition_id()), "shard-rows")

    bases = prefix_bases(rows, "part", {"base": F.col("size"), "rank_base": F.lit(1)})
    total = rows.agg(F.sum("size").alias("total"))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("inside"), F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)).alias("inside_rank"))
    placed = placed.join(F.broadcast(bases), "part").crossJoin(F.broadcast(total))  # one row per partition; one row
    placed = placed.select("doc_id", "size", "text_crc32", (F.col("rank_base") + F.col("inside_rank")).alias("rank"), F.expr(f"CAST((base + inside) * CAST({n_shards} AS DECIMAL(10, 0)) DIV total AS INT)").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
