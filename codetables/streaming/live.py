"""Live totals: usage by model, job states, incremental re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_totals(usage: DataFrame) -> DataFrame:
    """Running totals per model of a stream (update or complete mode) or a batch."""
    return usage.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def job_states(events: DataFrame) -> DataFrame:
    """Latest status per job; of equal times the later stage of queued, running, completed or failed."""
    stage = F.array_position(F.array(*map(F.lit, ("queued", "running", "completed", "failed"))), F.col("status"))
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", stage)).alias("status"), F.max("at").alias("at"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo_id, path, change (added, changed, removed) between two snapshots (repo_id, path, content) by content hash."""
    h = lambda df, name: df.select("repo_id", "path", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias(name))
    both = h(before, "old").join(h(after, "new"), ["repo_id", "path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("repo_id", "path", change.alias("change")).where("change IS NOT NULL")


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop; the checkpoint makes the next call go on from here."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", sink).outputMode("append").start().awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start().awaitTermination()
