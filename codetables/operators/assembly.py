"""Text assembled over grouped rows: evidence, cards, file text, chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codetables.functions import text as tx


def history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """The last two messages per turn of each conversation, then without the blank ones."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * turns)
    return last.where(F.trim(F.coalesce("text", F.lit(""))) != "").drop("n")


def distinct_evidence(hits: DataFrame, n: int = 8) -> DataFrame:
    """The first n distinct chunks of each conversation in the order they were retrieved."""
    first = hits.groupBy("conv_id", "chunk_id").agg(F.min("position").alias("position"))
    order = Window.partitionBy("conv_id").orderBy("position", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def evidence_pack(queries: DataFrame, hits: DataFrame, each: int = 1500) -> DataFrame:
    """query_id, evidence: labelled, clipped blocks by rank; a query without hits says so.

    hits: query_id, rank, path, kind, name, start_line, end_line, content.
    """
    label = tx.citation(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("kind"), F.col("name"))
    blocks = hits.select("query_id", F.struct("rank", F.concat(label, F.lit("\n"), tx.clip(F.col("content"), each)).alias("block")).alias("b"))
    joined = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n---\n\n").alias("evidence"))
    return queries.join(joined, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("Nothing in the index matches.")))


def uncovered(chunks: DataFrame) -> DataFrame:
    """repo_id, path, start_line, content of chunks without the lines that an earlier chunk of the file holds; what is left of none goes.

    Earlier is what begins before, of equal beginnings the longer; one sweep over the chunks of a file in that order.
    """
    lines = F.split("content", "\n")
    rows = chunks.select("repo_id", "path", F.col("start_line").cast("int").alias("start_line"), lines.alias("lines")).withColumn("end_line", F.col("start_line") + F.size("lines") - 1)
    before = Window.partitionBy("repo_id", "path").orderBy("start_line", F.desc("end_line"), "lines").rowsBetween(Window.unboundedPreceding, -1)
    drop = F.greatest(F.coalesce(F.max("end_line").over(before) - F.col("start_line") + 1, F.lit(0)), F.lit(0))
    left = rows.withColumn("drop", drop).where(F.col("drop") < F.size("lines"))
    return left.select("repo_id", "path", (F.col("start_line") + F.col("drop")).alias("start_line"), F.array_join(F.slice("lines", F.col("drop") + 1, F.size("lines")), "\n").alias("content"))


def file_text(chunks: DataFrame) -> DataFrame:
    """repo_id, path, content from chunks in line order; lines that several chunks hold come once."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    return uncovered(chunks).groupBy("repo_id", "path").agg(F.array_join(F.transform(ordered, lambda c: c["content"]), "\n").alias("content"))


def file_cards(requests: DataFrame, files: DataFrame, n: int = 6000) -> DataFrame:
    """request_id, card: header and clipped text of the resolved path (request_id, repo_id, path)."""
    return requests.join(files, ["repo_id", "path"], "left").select("request_id", F.when(F.col("content").isNotNull(), F.concat(F.lit("# "), F.col("path"), F.lit("\n"), tx.clip(F.col("content"), n))).otherwise(F.concat(F.lit("No file "), F.coalesce("path", F.lit("")))).alias("card"))


def symbol_cards(found: DataFrame, chunks: DataFrame, n: int = 2000) -> DataFrame:
    """request_id, card: header and clipped body of each symbol found, by rank; the body is the symbol's first chunk."""
    body = chunks.groupBy("repo_id", "path", "name").agg(F.min_by("content", "start_line").alias("content"))
    head = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(" — "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    blocks = found.join(body, ["repo_id", "path", "name"], "left").select("request_id", F.struct("rank", F.concat(head, F.lit("\n"), tx.clip(F.col("content"), n)).alias("block")).alias("b"))
    return blocks.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("card"))


def dependency_cards(neighbours: DataFrame) -> DataFrame:
    """id, card: what a file imports and what imports it, or that it has no edges."""
    line = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(F.col(c).cast("array<string>"), ", ")))
    card = F.concat_ws("\n", line("imports: ", "imports"), line("imported by: ", "imported_by"))
    return neighbours.select("id", F.when(card == "", F.lit("no import edges")).otherwise(card).alias("card"))


def change_context(reports: DataFrame, changes: DataFrame, hunks: DataFrame) -> DataFrame:
    """change_id, context: title, body, files with their first hunks, symbols, importers and tests, within fixed budgets."""
    shown = Window.partitionBy("change_id", "path").orderBy("hunk")
    lines = hunks.groupBy("change_id", "path", "hunk").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "line"))), 1, 40), lambda x: x["line"]), "\n").alias("body"))
    lines = lines.withColumn("n", F.row_number().over(shown)).where("n <= 2").groupBy("change_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n").alias("body"))
    files = lines.groupBy("change_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("path", "body"))), 1, 20), lambda x: F.concat(F.lit("## "), x["path"], F.lit("\n"), x["body"])), "\n").alias("files_text"))
    names = lambda c, n, f: F.array_join(F.transform(F.slice(F.coalesce(F.col(c)), 1, n), f), "\n")
    out = reports.join(changes.select("change_id", "title", "body"), "change_id").join(files, "change_id", "left")
    parts = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.substring(F.coalesce("body", F.lit("")), 1, 800), F.col("files_text"), names("symbols", 30, lambda s: F.concat(s["kind"], F.lit(" "), s["name"])), names("affected", 30, lambda a: a["path"]), names("tests", 20, lambda t: t["path"]))
    return out.select("change_id", F.substring(parts, 1, 8000).alias("context"))
