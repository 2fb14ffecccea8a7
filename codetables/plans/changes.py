"""Change impact of all change sets in one job: payload to ranges, symbols, importers, tests, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.operators import diffs, impact
from codetables.sources import tables


def analyze_changes(files_changed: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """One nested report row per change.

    files_changed: change_id, repo_id, path, patch; files, symbols, edges: an index of the same repositories, whose paths are
    joined within the repository.  Edges are repo_id, source_path, target_path, or two tables, sources and targets, with columns of a group beside
    repo_id: then each source of a group imports each of its targets.
    """
    # a change belongs to one repository; its paths carry the repository's id while they meet the index
    key = lambda c: F.concat_ws("\u0001", "repo_id", c)
    changed = files_changed.select("change_id", key("path").alias("path"), "patch")
    own = symbols.select(key("path").alias("path"), "kind", "name", "start_line", "end_line")
    short = lambda df, *cs: df.withColumns({c: F.substring_index(c, "\u0001", -1) for c in cs})
    hit = tables.stored(impact.changed_symbols(diffs.changed_ranges(changed), own), "hit")
    if isinstance(edges, tuple):
        affected = impact.importers_by_group(hit, *(e.withColumn(c, key(c)) for e, c in zip(edges, ("source_path", "target_path"), strict=True)))
    else:
        affected = impact.importers(hit, edges.select(key("source_path").alias("source_path"), key("target_path").alias("target_path")))
    affected = tables.stored(affected, "affected")
    repo = files_changed.select("change_id", "repo_id").distinct()
    near = short(hit.select("change_id", "path").unionByName(affected.select("change_id", "path")), "path").distinct().join(repo, "change_id")
    tests = impact.related_tests(near, files)
    return impact.report(files_changed, files_changed, short(hit, "path"), short(affected, "path", "via_path"), tests)
