"""Chunking files into exactly cited line spans: top-level symbols, overlapping windows, headings, packed paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetables.functions import text as tx
from codetables.sources import tables

#: Spans of more lines than MAX_LINES are cut to windows of WINDOW lines, STRIDE apart; chunks kept per file.
MAX_LINES, WINDOW, STRIDE = 120, 100, 80
_FILE = ["repo_id", "path"]


def lines_table(files: DataFrame, text_col: str = "content") -> DataFrame:
    """repo_id, path, line_no (from 1), line."""
    return files.select(*_FILE, F.posexplode(tx.lines(F.col(text_col))).alias("pos", "line")).select(*_FILE, (F.col("pos") + 1).alias("line_no"), "line")


def top_level(symbols: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Symbols not strictly inside another span of their file; equal spans are siblings; exact repetitions go.

    One sort per file and one reading of the symbols: of what stands before a span (by start and, of equal starts, longest first) the farthest end,
    of equal ends the one that begins first, holds the span if any does; the span itself, met before, holds nothing.
    """
    keys = keys or _FILE
    before = Window.partitionBy(*keys).orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    rows = symbols.dropna(subset=[*keys, "start_line", "end_line"]).withColumn("outer", F.max(F.struct("end_line", (-F.col("start_line")).alias("before"))).over(before))
    same = (F.col("outer.end_line") == F.col("end_line")) & (F.col("outer.before") == -F.col("start_line"))
    return rows.where(F.col("outer").isNull() | (F.col("outer.end_line") < F.col("end_line")) | same).drop("outer").dropDuplicates([*keys, "kind", "name", "start_line", "end_line"])


def windows(start: Column, end: Column) -> Column:
    """The span itself, or overlapping windows that cover it without a gap."""
    n = end - start + 1
    last = F.ceil((n - WINDOW) / STRIDE).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda k: F.struct((start + k * STRIDE).cast("int").alias("start_line"), F.least(start + k * STRIDE + WINDOW - 1, end).cast("int").alias("end_line")),
    )
    whole = F.array(F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line")))
    return F.when(n > MAX_LINES, cut).otherwise(whole)


def heading_sections(lines: DataFrame, include_preamble: bool = False) -> DataFrame:
    """repo_id, path, start_line, end_line: from each heading to the line before the next.

    A heading is ``#`` to ``######`` and a space, or a line underlined by = or -.  Text before the first heading
    is left out unless ``include_preamble``.
    """
    order = Window.partitionBy(*_FILE).orderBy("line_no")
    under = F.lead("line").over(order).rlike(r"^\s{0,3}(=+|-+)\s*$") & (F.trim("line") != "") & ~F.col("line").rlike(r"^\s{0,3}(=+|-+)\s*$")
    marked = lines.withColumn("heading", F.col("line").rlike(r"^#{1,6}\s") | F.coalesce(under, F.lit(False)))
    marked = marked.withColumn("total", F.max("line_no").over(Window.partitionBy(*_FILE)))
    if include_preamble:
        marked = marked.withColumn("heading", F.col("heading") | (F.col("line_no") == 1))
    heads = marked.where("heading").withColumn("end_line", F.coalesce(F.lead("line_no").over(order) - 1, F.col("total")))
    return heads.select(*_FILE, F.col("line_no").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


def paragraph_blocks(lines: DataFrame) -> DataFrame:
    """repo_id, path, start_line, end_line: runs of lines that aren't blank."""
    order = Window.partitionBy(*_FILE).orderBy("line_no")
    runs = lines.where(F.col("line").rlike(r"\S")).withColumn("run", F.col("line_no") - F.row_number().over(order))
    return runs.groupBy(*_FILE, "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("run")


def packed(blocks: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """Neighbouring blocks of a file joined as long as the span from first to last stays within ``most`` lines.

    A fold over the blocks as they stream by in the order of files and lines; it carries one span, so a file may have any number of blocks.
    """
    rows = blocks.select(*(F.col(c).cast("string").alias(c) for c in _FILE), *(F.col(c).cast("int").alias(c) for c in ("start_line", "end_line")))
    ordered = rows.repartition(*_FILE).sortWithinPartitions(*_FILE, "start_line", "end_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            out = []
            for repo, path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] == repo and now[1] == path and end - now[2] + 1 <= most:
                    now = (repo, path, now[2], end)
                else:
                    if now:
                        out.append(now)
                    now = (repo, path, start, end)
            yield _spans(out)
        if now:
            yield _spans([now])

    return ordered.mapInArrow(run, "repo_id string, path string, start_line int, end_line int")


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*_FILE, "start_line", "end_line"])


def _split(files: DataFrame, text_col: str = "content") -> DataFrame:
    """repo_id, path, all_lines of files that have lines."""
    return files.where(F.col(text_col) != "").select(*_FILE, tx.lines(F.col(text_col)).alias("all_lines"))


def _content(spans: DataFrame) -> DataFrame:
    """``cut_content`` of spans that carry their file's all_lines."""
    lo, hi = F.greatest(F.col("start_line"), F.lit(1)), F.least(F.col("end_line"), F.size("all_lines"))
    s = spans.withColumns({"start_line": lo.cast("int"), "end_line": hi.cast("int")}).where("start_line <= end_line")
    s = s.withColumn("part", F.slice("all_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)).drop("all_lines")
    # a generator of one row: the marks are found once, not again for each use
    marks = F.transform("part", lambda x, i: F.when(x.rlike(r"\S"), i))
    first, last = F.array_min("marks"), F.array_max("marks")
    s = s.select("*", F.explode(F.array(marks)).alias("marks")).withColumns({"first": first, "last": last}).where("first IS NOT NULL")
    content = F.array_join(F.slice("part", F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n")
    return s.withColumns({"content": content, "end_line": (F.col("start_line") + F.col("last")).cast("int")}).withColumn("start_line", (F.col("start_line") + F.col("first")).cast("int")).drop("part", "marks", "first", "last")


def cut_content(spans: DataFrame, files: DataFrame, text_col: str = "content") -> DataFrame:
    """Spans clamped to their file and trimmed of blank edge lines, with their content; blank spans go.

    start_line and end_line stay exact: content is those lines of the file, joined by line feeds.
    """
    return _content(spans.join(_split(files, text_col).hint("merge"), _FILE))


def _cut(spans: DataFrame) -> DataFrame:
    """Spans replaced by their windows; equal windows of a symbol once."""
    rest = [c for c in spans.columns if c not in ("start_line", "end_line")]
    return spans.select(*rest, F.inline(windows(F.col("start_line"), F.col("end_line")))).dropDuplicates([*_FILE, "start_line", "end_line", "kind", "name"])


def chunk_files(files: DataFrame, symbols: DataFrame, per_file: int | None = None, include_preamble: bool = False) -> DataFrame:
    """repo_id, path, language, kind, name, start_line, end_line, content, truncated.

    files: repo_id, path, language, content; symbols: repo_id, path, kind, name, start_line, end_line.  A file's
    top-level symbols if it has any with content, else for Markdown its sections, else its packed
    paragraphs.  All chunks of a file stay, or the first ``per_file`` (200 is the usual number); truncated tells that there were more.
    """
    cut = _cut(top_level(symbols))
    span = ("kind", "name", "start_line", "end_line")
    listed = cut.groupBy(*_FILE).agg(F.collect_list(F.struct(*span)).alias("spans"))
    # every file once with its spans, written: what it has decides which chunks it gets, and no text is shuffled again for named ones
    filled = lambda s: F.array_join(F.slice("all_lines", F.greatest(s["start_line"], F.lit(1)), F.greatest(s["end_line"] - F.greatest(s["start_line"], F.lit(1)) + 1, F.lit(0))), "\n").rlike(r"\S")
    whole = files.where("repo_id IS NOT NULL AND path IS NOT NULL AND content <> ''").select(*_FILE, "language", tx.lines(F.col("content")).alias("all_lines"))
    whole = whole.join(listed.hint("merge"), _FILE, "left").withColumn("is_named", F.coalesce(F.exists("spans", filled), F.lit(False)))
    whole = tables.stored(whole, "files-and-spans")
    columns = [*_FILE, "language", *span, "content"]
    named = _content(whole.where("is_named").select(*_FILE, "language", "all_lines", F.inline("spans"))).select(*columns)
    bare = whole.where("NOT is_named").select(*_FILE, "language", "all_lines")
    lines = bare.select(*_FILE, "language", F.posexplode("all_lines").alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")
    marked = lines.where("language = 'Markdown'")
    sections = tables.stored(heading_sections(marked.drop("language"), include_preamble), "sections")
    plain = marked.drop("language").join(sections.select(*_FILE).distinct().hint("merge"), _FILE, "left_anti").unionByName(lines.where("language IS NULL OR language <> 'Markdown'").drop("language"))
    spans = _cut(sections.unionByName(packed(paragraph_blocks(plain))).select("*", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name")))
    free = _content(spans.join(bare.hint("merge"), _FILE)).select(*columns)
    order = Window.partitionBy(*_FILE).orderBy("start_line", "end_line", "kind", "name")
    found = named.unionByName(free).withColumn("truncated", F.lit(False))
    if per_file is not None:
        found = found.withColumn("n", F.row_number().over(order)).withColumn("truncated", F.max("n").over(Window.partitionBy(*_FILE)) > per_file).where(F.col("n") <= per_file).drop("n")
    return found.select(*_FILE, *span, "content", "truncated", "language")
