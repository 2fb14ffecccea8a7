"""JSON records: benchmark questions, usage, remote payloads; appended usage rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "question string, repo_id string, expected_file_path string, expected_symbol string, category string"
USAGE = "model string, provider string, input_tokens long, output_tokens long, latency_ms double, estimated_cost_usd double, timestamp string, request_id string, user_id string, repo_id string"
REPOSITORY = "id long, name string, full_name string, private boolean, default_branch string, description string, owner struct<login:string>"
PULL = "number int, title string, body string, state string, updated_at string, head struct<ref:string,sha:string>, base struct<ref:string,sha:string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array per file; a path that doesn't exist is an empty table."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, QUESTION)


def write_questions(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, USAGE).withColumn("ts", F.try_to_timestamp("timestamp")).drop("timestamp")


def append_usage(usage: DataFrame, path: str) -> None:
    """New rows are new files: nothing that is there is written again."""
    usage.write.mode("append").parquet(path)


def repositories(payloads: DataFrame, column: str = "payload") -> DataFrame:
    r = payloads.select(F.from_json(column, REPOSITORY).alias("r")).where("r IS NOT NULL")
    return r.select("r.id", "r.name", "r.full_name", F.coalesce("r.private", F.lit(False)).alias("private"), F.coalesce("r.default_branch", F.lit("main")).alias("default_branch"), F.coalesce("r.description", F.lit("")).alias("description"), F.col("r.owner.login").alias("owner"))


def pulls(payloads: DataFrame, state: str | None = None, n: int | None = 30, column: str = "payload") -> DataFrame:
    """Slim pull requests, newest update first."""
    p = payloads.select(F.from_json(column, PULL).alias("p")).where("p.number IS NOT NULL")
    out = p.select("p.number", F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.body", F.lit("")).alias("body"), "p.state", F.try_to_timestamp("p.updated_at").alias("updated_at"), F.col("p.head.ref").alias("head_ref"), F.col("p.base.sha").alias("base_sha"))
    out = out if state is None else out.where(F.col("state") == state)
    return out if n is None else out.orderBy(F.desc("updated_at"), "number").limit(n)
