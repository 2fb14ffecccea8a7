"""Filters that narrow a table to what was asked for; all of them reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetables.functions import text as tx


def in_repositories(df: DataFrame, repo_id: str | None = None, repo_ids: list[str] | None = None) -> DataFrame:
    """One repository, or several; the single one wins when both are given.  The partition column prunes files."""
    if repo_id is not None:
        return df.where(F.col("repo_id") == repo_id)
    return df if repo_ids is None else df.where(F.col("repo_id").isin(repo_ids))


def with_language(df: DataFrame, language: str | None) -> DataFrame:
    return df if language is None else df.where(F.col("language") == language)


def in_file(df: DataFrame, path: str | None) -> DataFrame:
    return df if path is None else df.where(F.col("path") == path)


def below_prefix(df: DataFrame, prefix: str | None) -> DataFrame:
    """Paths that begin with the prefix, in which the LIKE wildcards keep their meaning."""
    return df if prefix is None else df.where(F.col("path").like(prefix + "%"))


#: The form of an id.
UUID = r"^[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def requested_ids(requests: DataFrame, raw: str = "repo_ids", form: str = UUID) -> tuple[DataFrame, DataFrame]:
    """(request_id, repo_id of the ids that requests list; request_id, rejected: what isn't an id).  Blank parts are dropped, repeated ones kept once."""
    parts = requests.select("request_id", F.explode(tx.id_list(F.col(raw))).alias("repo_id")).distinct()
    return parts.where(F.col("repo_id").rlike(form)), parts.where(~F.col("repo_id").rlike(form)).withColumnRenamed("repo_id", "rejected")


def of_kind(symbols: DataFrame, kind: str | None) -> DataFrame:
    return symbols if kind is None else symbols.where(F.col("kind") == kind)


def name_contains(symbols: DataFrame, text: str | None) -> DataFrame:
    return symbols if text is None else symbols.where(F.col("name").ilike(f"%{text}%"))


def edges_of(edges: DataFrame, edge_type: str, source_kind: str | None = None) -> DataFrame:
    out = edges.where(F.col("edge_type") == edge_type)
    return out if source_kind is None else out.where(F.col("source_kind") == source_kind)


def branch(requested: Column, default: Column) -> Column:
    """The requested branch, or the default where none or an empty one was asked for."""
    return F.coalesce(F.nullif(requested, F.lit("")), default)


def chunks_per_repository(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_chunks"))
