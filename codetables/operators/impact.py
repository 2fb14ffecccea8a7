"""Change impact over whole sets of changes: symbols hit, one-hop importers, related tests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.functions import paths
from codetables.operators import intervals, substring

#: LIKE patterns of related tests, from a path's directory and stem.
TEST_PATTERNS = ("{dir}/test_%", "{dir}/%_test", "tests/{dir}/%", "%{stem}%test%")


def changed_symbols(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """change_id, path, kind, name, start_line, end_line, changed_lines: symbols whose span meets a changed range.

    The overlaps are found by bins of lines, so a file of many spans and many ranges is no product of the two.
    """
    r = ranges.select("change_id", "path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    hit = intervals.overlapping(r, symbols.select("path", "kind", "name", "start_line", "end_line"), ["path"])
    lines = F.sequence(F.greatest("lo", "start_line"), F.least("hi", "end_line"))
    return hit.groupBy("change_id", "path", "kind", "name", "start_line", "end_line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lines)))).alias("changed_lines"))


def importers(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """change_id, path, via_path: files that import a changed file, each once, via the smallest changed path.

    changed: change_id, path; edges: source_path, target_path of import edges.
    """
    hit = changed.select("change_id", F.col("path").alias("target_path")).distinct().join(edges, "target_path")
    return hit.groupBy("change_id", F.col("source_path").alias("path")).agg(F.min("target_path").alias("via_path"))


def importers_by_group(changed: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``importers`` where every source of a group imports every target of it: the edges are never listed, a group is met by its smallest changed path.

    changed: change_id, path; sources: the group's columns, source_path; targets: these columns, target_path.
    """
    group = [c for c in targets.columns if c != "target_path"]
    hit = changed.select("change_id", F.col("path").alias("target_path")).distinct().join(targets.hint("merge"), "target_path")
    first = hit.groupBy("change_id", *group).agg(F.min("target_path").alias("via_path"))
    return first.join(sources.hint("merge"), group).groupBy("change_id", F.col("source_path").alias("path")).agg(F.min("via_path").alias("via_path"))


def related_tests(relevant: DataFrame, files: DataFrame, patterns: tuple[str, ...] = TEST_PATTERNS) -> DataFrame:
    """change_id, path of files that a pattern of a relevant path names, within the repository.

    relevant: change_id, repo_id, path.  Patterns meet paths through the trigrams that both hold.
    """
    where, stem = paths.directory(F.col("path")), paths.stem(F.col("path"))
    made = F.array(*(F.regexp_replace(F.regexp_replace(F.lit(p), F.lit(r"\{dir\}"), F.regexp_replace(where, r"([\\$])", r"\\$1")), F.lit(r"\{stem\}"), F.regexp_replace(stem, r"([\\$])", r"\\$1")) for p in patterns))
    asked = relevant.select("change_id", "repo_id", F.explode(made).alias("pattern")).distinct()
    named = files.select("repo_id", "path")
    if all("test" in p for p in patterns):
        named = named.where(F.col("path").contains("test"))
    found = substring.like_pairs(asked, named, "repo_id")
    return asked.join(found.hint("merge"), ["repo_id", "pattern"]).select("change_id", "path").distinct()


def report(changes: DataFrame, files: DataFrame, symbols: DataFrame, affected: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per change: four counts and the nested lists; a change without effect has zeros and empty lists."""
    def nested(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name), F.count(F.lit(1)).cast("int").alias(f"n_{name}"))

    out = changes.select("change_id").distinct()
    parts = [nested(files.select("change_id", "path").distinct(), "files", "path"), nested(symbols, "symbols", "path", "start_line", "end_line", "kind", "name", "changed_lines"), nested(affected, "affected", "path", "via_path"), nested(tests, "tests", "path")]
    for part in parts:
        out = out.join(part, "change_id", "left")
    lists = ("files", "symbols", "affected", "tests")
    return out.select("change_id", *(F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in lists), *lists)
