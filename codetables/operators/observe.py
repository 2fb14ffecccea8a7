"""Job statistics, usage and cost roll-ups, job ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("queued", "running", "completed", "failed")


def seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def job_stats(jobs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total_jobs, a count per state, mean_seconds of completed jobs with both times, null-safe sums of the counters."""
    whole = (F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("files_indexed", "symbols_indexed", "chunks_indexed")]
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in STATES]
    return jobs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_jobs"), *counts, F.avg(F.when(whole, seconds(F.col("started_at"), F.col("finished_at")))).alias("mean_seconds"), *sums)


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row per key; the greater ``tie`` of equal times."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at, tie)).alias("r"))
    return newest.select("r.*")


def newest(rows: DataFrame, n: int, at: str = "created_at", tie: str = "job_id") -> DataFrame:
    return rows.orderBy(F.desc(at), tie).limit(max(1, min(n, 100)))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost_usd: tokens per million times price, rounded to 6; an unknown model costs 0."""
    p = F.broadcast(prices.select("model", "input_price", "output_price"))  # a price list, a few rows
    usd = (F.col("input_tokens") / 1e6) * F.coalesce("input_price", F.lit(0.0)) + (F.col("output_tokens") / 1e6) * F.coalesce("output_price", F.lit(0.0))
    return usage.join(p, "model", "left").withColumn("cost_usd", F.round(usd, 6)).drop("input_price", "output_price")


def unpriced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    return usage.join(prices, "model", "left_anti").select("model").distinct()


def usage_summary(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """calls, tokens, cost (6 places), mean latency (1 place); zeros where there is no call."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return usage.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("calls"), zero(F.sum("input_tokens")).cast("long").alias("input_tokens"), zero(F.sum("output_tokens")).cast("long").alias("output_tokens"),
        zero(F.round(F.sum("cost_usd"), 6)).cast("double").alias("cost_usd"), zero(F.round(F.avg("latency_ms"), 1)).cast("double").alias("mean_latency_ms"),
    )


def reported_tokens(rows: DataFrame) -> DataFrame:
    """input_tokens and output_tokens from the first reporting struct that has them; rows without any token go."""
    pick = lambda k: F.coalesce(F.col(f"usage_metadata.{k}"), F.col(f"token_usage.{k}"), F.lit(0))
    return rows.withColumns({"input_tokens": pick("input_tokens"), "output_tokens": pick("output_tokens")}).where("input_tokens + output_tokens > 0")


def ledger_state(events: DataFrame) -> DataFrame:
    """Current state of each job from appended status rows: of equal times the later stage; errors cut to 2000 characters."""
    cut = events.withColumn("error", F.substring("error", 1, 2000)).withColumn("_stage", F.array_position(F.array(*map(F.lit, STATES)), F.col("status")))
    return latest(cut, "job_id", "at", "_stage").drop("_stage")


def price_list(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "model string, input_price double, output_price double")

