"""Bounded context for an external answerer: history, retrieved chunks, distinct evidence, packed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.operators import assembly
from codetables.plans import search
from codetables.sources import tables


def evidence(queries: DataFrame, messages: DataFrame, chunks: DataFrame, encoder, k: int = 6, most: int = 8) -> DataFrame:
    """conv_id, history (roles and texts in order), evidence.

    queries: conv_id, query_id, position, text; messages: conv_id, turn, role, text; chunks: chunk_id, vector and citation columns.
    """
    # vectors are made once, however many blocks of queries pass over them; small tables are joined without guesses of their size
    vectors = tables.stored(chunks.select("chunk_id", "vector"), "vectors")
    hits = search.search(queries, vectors, encoder, k).join(queries.select("query_id", "conv_id", "position").hint("merge"), "query_id")
    seen = hits.select("conv_id", "chunk_id", (F.col("position") * 100 + F.col("rank")).alias("position"))
    kept = assembly.distinct_evidence(seen, most).join(chunks.drop("vector").hint("merge"), "chunk_id").withColumnRenamed("conv_id", "query_id")
    packed = assembly.evidence_pack(queries.select(F.col("conv_id").alias("query_id")).distinct(), kept).withColumnRenamed("query_id", "conv_id")
    turns = assembly.history(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    return packed.join(turns, "conv_id", "left")
