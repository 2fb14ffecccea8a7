"""Unified diffs as rows: hunks, new-file line numbers, changed line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the hunk header of the unified diff format.
_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_KEY = ["change_id", "path"]
#: A pull request's file list as JSON.
PAYLOAD = "array<struct<filename:string,status:string,patch:string,previous_filename:string>>"


def changed_files(payloads: DataFrame) -> DataFrame:
    """change_id, path, status, patch, previous_path from change_id and a JSON payload; a file without a patch has null."""
    rows = payloads.select("change_id", F.explode(F.from_json("payload", PAYLOAD)).alias("f"))
    return rows.select("change_id", F.col("f.filename").alias("path"), F.col("f.status").alias("status"), F.col("f.patch").alias("patch"), F.col("f.previous_filename").alias("previous_path"))


def patch_lines(files: DataFrame) -> DataFrame:
    """change_id, path, pos, line of every patch line."""
    return files.where("patch IS NOT NULL").select(*_KEY, F.posexplode(F.split("patch", "\n")).alias("pos", "line"))


def hunk_lines(lines: DataFrame) -> DataFrame:
    """Lines below a hunk header with hunk, old_start, old_count, new_start, new_count; lines above the first are dropped.

    A count that a header leaves out is 1.
    """
    order = Window.partitionBy(*_KEY).orderBy("pos")
    h = lambda k: F.regexp_extract("line", _HEADER, k)
    count = lambda k: F.when(h(k) == "", 1).otherwise(h(k).cast("int"))
    head = F.struct(h(1).cast("int").alias("old_start"), count(2).alias("old_count"), h(3).cast("int").alias("new_start"), count(4).alias("new_count"))
    is_head = F.col("line").rlike(_HEADER)
    rows = lines.withColumn("hunk", F.sum(is_head.cast("int")).over(order)).withColumn("head", F.last(F.when(is_head, head), ignorenulls=True).over(order))
    return rows.where((F.col("hunk") > 0) & ~is_head).select(*_KEY, "hunk", "pos", "line", "head.*")


def numbered(hunks: DataFrame) -> DataFrame:
    """Hunk lines with new_line, the line's number in the new file; ``\\ No newline`` remarks count for nothing."""
    order = Window.partitionBy(*_KEY, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    real = hunks.where(~F.col("line").startswith("\\"))
    kept = (~F.col("line").startswith("-")).cast("int")
    return real.withColumn("new_line", (F.col("new_start") + F.coalesce(F.sum(kept).over(order), F.lit(0))).cast("int"))


def ranges_per_file(files: DataFrame) -> DataFrame:
    """change_id, path, ranges: the changed ranges of all hunks of a file in order, not merged over hunks.

    files: change_id, path, patch and ``pos``, the place in the change's list: a path that is listed again counts with its last entry alone.
    """
    last = files.groupBy(*_KEY).agg(F.max_by("patch", "pos").alias("patch"))
    spans = changed_ranges(last).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("hunk", "start_line", "end_line"))).alias("spans"))
    return spans.select(*_KEY, F.transform("spans", lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"))).alias("ranges"))


def changed_ranges(files: DataFrame) -> DataFrame:
    """change_id, path, hunk, start_line, end_line: runs of added lines; a hunk that only deletes has none."""
    # of lines that aren't headers only the mark counts, so no text goes through the sorts
    line = F.when(F.col("line").rlike(_HEADER), F.regexp_extract("line", _HEADER, 0)).otherwise(F.substring("line", 1, 1))
    added = numbered(hunk_lines(patch_lines(files).withColumn("line", line))).where(F.col("line").startswith("+"))
    order = Window.partitionBy(*_KEY, "hunk").orderBy("new_line")
    runs = added.withColumn("run", F.col("new_line") - F.row_number().over(order))
    return runs.groupBy(*_KEY, "hunk", "run").agg(F.min("new_line").alias("start_line"), F.max("new_line").alias("end_line")).drop("run")
