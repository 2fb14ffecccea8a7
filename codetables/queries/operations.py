"""Job, usage, cost and admission queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.operators import observe
from codetables.queries import adapters as a
from codetables.streaming import admission, live

QUERIES, ORACLE_SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STATS = """count(*) AS total_jobs, count(*) FILTER (status = 'queued') AS queued_jobs, count(*) FILTER (status = 'running') AS running_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs,
round(avg(CASE WHEN status = 'completed' AND started_at IS NOT NULL AND finished_at IS NOT NULL THEN (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 END), 3) AS mean_seconds,
CAST(coalesce(sum(files_indexed), 0) AS BIGINT) AS files_indexed, CAST(coalesce(sum(symbols_indexed), 0) AS BIGINT) AS symbols_indexed, CAST(coalesce(sum(chunks_indexed), 0) AS BIGINT) AS chunks_indexed"""


@register(f"WITH {a.JOBS} SELECT {_STATS} FROM jobs")
def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.job_stats(a.jobs(spark, sf_dir)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@register(f"WITH {a.JOBS} SELECT mode, {_STATS} FROM jobs GROUP BY mode")
def job_stats_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.job_stats(a.jobs(spark, sf_dir), ["mode"]).withColumn("mean_seconds", F.round("mean_seconds", 3))


@register(f"WITH {a.JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) AS k FROM jobs) SELECT repo_id, job_id, status FROM n WHERE k = 1")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.latest(a.jobs(spark, sf_dir), "repo_id", "created_at", "job_id").select("repo_id", "job_id", "status")


@register(f"WITH {a.JOBS} SELECT job_id, repo_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 100")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.newest(a.jobs(spark, sf_dir), 100).select("job_id", "repo_id", "status")


_SUM = """count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd, CAST(round(coalesce(avg(latency_ms), 0), 1) AS DOUBLE) AS mean_latency_ms"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.cost(a.usage(spark, sf_dir), observe.price_list(spark, a.PRICES))


@register(f"WITH {a.USAGE} SELECT {_SUM} FROM priced")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.usage_summary(_priced(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 4))


@register(f"WITH {a.USAGE} SELECT model, {_SUM} FROM priced GROUP BY model")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.usage_summary(_priced(spark, sf_dir), ["model"]).withColumn("cost_usd", F.round("cost_usd", 4))


@register(f"WITH {a.USAGE} SELECT user_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS calls FROM usage GROUP BY user_id")
def usage_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = observe.usage_summary(_priced(spark, sf_dir), ["user_id"])
    return u.select("user_id", "input_tokens", "output_tokens", "calls")


@register(f"WITH {a.USAGE} SELECT DISTINCT model FROM usage WHERE model NOT IN (SELECT model FROM prices)")
def unpriced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.unpriced(a.usage(spark, sf_dir), observe.price_list(spark, a.PRICES))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))


@register()
def admission_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.batch(_requests(spark, sf_dir), most=5, window=3600)


#: Requests and seconds of two endpoints; the others have two in ten minutes.
_LIMITS = {"click": (3, 86_400), "view": (5, 259_200)}


@register(f"""WITH RECURSIVE e AS (
  SELECT user_id, event_type AS endpoint, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n,
    CASE event_type {' '.join(f"WHEN '{k}' THEN {n}" for k, (n, _) in _LIMITS.items())} ELSE 2 END AS most, 1000000::BIGINT * CASE event_type {' '.join(f"WHEN '{k}' THEN {w}" for k, (_, w) in _LIMITS.items())} ELSE 600 END AS w FROM events
), r AS (
  SELECT user_id, endpoint, n, event_id, true AS allowed, [t] AS admitted, most FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.endpoint, e.n, e.event_id, len(list_filter(r.admitted, lambda x: x > e.t - e.w)) < e.most,
    CASE WHEN len(list_filter(r.admitted, lambda x: x > e.t - e.w)) < e.most THEN list_filter(r.admitted, lambda x: x > e.t - e.w) || [e.t] ELSE list_filter(r.admitted, lambda x: x > e.t - e.w) END, e.most
  FROM r JOIN e ON e.user_id = r.user_id AND e.endpoint = r.endpoint AND e.n = r.n + 1
) SELECT user_id, endpoint, event_id AS request_id, allowed, CAST(most - len(admitted) AS INTEGER) AS remaining FROM r""")
def admission_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission with limits of their own for two endpoints."""
    return admission.batch(_requests(spark, sf_dir), most=2, window=600, limits=_LIMITS).select("user_id", "endpoint", "request_id", "allowed", "remaining")


@register()
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions made on a stream that ends when the table is read."""
    folder = _scratch(spark, "admission")
    source = spark.readStream.schema(a.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    e = source.select("user_id", F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))
    live.drain(admission.stream(e, 5, 3600, "36500 days"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(admission.OUT).parquet(f"{folder}/out")


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register(f"WITH {a.USAGE} SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY model")
def live_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per model after the last micro-batch of a stream over the events."""
    folder = _scratch(spark, "live-usage")
    source = spark.readStream.schema(a.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    u = source.select(F.col("event_type").alias("model"), F.floor(F.col("value") * 100).alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))
    live.drain(live.usage_totals(u), f"{folder}/out", f"{folder}/checkpoint", mode="complete")
    out = spark.read.parquet(f"{folder}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


@register("""WITH e AS (SELECT user_id AS job_id, ts, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, event_id % 4 AS stage FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, stage DESC) AS k FROM e) SELECT job_id, status FROM n WHERE k = 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, observe.STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    return live.job_states(e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), status.alias("status"))).select("job_id", "status")


@register("""WITH e AS (SELECT user_id AS job_id, date_trunc('day', ts) AS day, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, event_id % 4 AS stage, max(event_id) AS last FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY day DESC, stage DESC) AS k FROM e)
SELECT job_id, status, substr(repeat(CAST(last AS VARCHAR), 600), 1, 2000) AS error FROM n WHERE k = 1""")
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's last state of its last day: on equal times the later stage counts."""
    e = a.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, observe.STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    events = e.groupBy(F.col("user_id").alias("job_id"), F.date_trunc("day", "ts").alias("at"), status.alias("status")).agg(F.max("event_id").alias("last"))
    return observe.ledger_state(events.withColumn("error", F.repeat(F.col("last").cast("string"), F.lit(600)))).select("job_id", "status", "error")
