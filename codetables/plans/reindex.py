"""Incremental re-indexing: from an index and two snapshots of the trees to the index of the later one.

Only added and changed files are scanned again.  An import of an untouched file can change its target only if one of the paths it may mean
came or went, so the reverse index (candidate path to import) is joined with those paths, and only the imports it names are resolved
again.  All steps are equi-joins over whole tables; many repositories go in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.operators import resolve, structure
from codetables.sources import tables
from codetables.sources import tree as trees
from codetables.streaming import live

_FILE = ["repo_id", "path"]
#: Tables of an index: asked is the reverse index, imports carry what they resolve to.
TABLES = ("files", "symbols", "imports", "asked", "edges")


def _edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    return resolve.import_edges(imports, files)


def _scanned(tree: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """Tables of the files in ``tree`` that don't depend on other files, each written once under its name and ``prefix``."""
    files = trees.readable(trees.source_files(tree))
    code = tables.stored(structure.statements(files), "statements")
    imports = tables.stored(structure.imports_of(code), f"{prefix}imports")
    found = files.join(structure.parse_errors(code).hint("merge"), _FILE, "left").select(*_FILE, "language", "line_count", "parse_error")
    out = {"files": found, "symbols": structure.symbols_of(code), "asked": resolve.asked_paths(imports)}
    return {"imports": imports} | {k: tables.stored(v, prefix + k) for k, v in out.items()}


def full_index(tree: DataFrame) -> dict[str, DataFrame]:
    """The tables of TABLES for all repositories of ``tree`` (repo_id, path, content), each written once."""
    out = _scanned(tree)
    hits = resolve.first_present(out["asked"], tree)
    out["imports"] = tables.stored(out["imports"].join(hits.hint("merge"), resolve.IMPORT, "left"), "imports")
    out["edges"] = tables.stored(_edges(out["imports"], out["files"]), "edges")
    return out


def reindex(index: dict[str, DataFrame], before: DataFrame, after: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(tables of ``after``, counts of files scanned, imports resolved again and rows of files kept).

    index is that of ``before``, from full_index or reindex.  An unchanged file keeps its rows; empty snapshots on either side are fine;
    repositories may come and go.
    """
    delta = tables.stored(live.snapshot_diff(before, after), "delta")
    touched = delta.select(*_FILE)
    fresh = delta.where("change <> 'removed'").select(*_FILE)
    new = _scanned(after.join(fresh.hint("merge"), _FILE, "left_semi"), "new-")
    kept = {k: index[k].join(touched.hint("merge"), _FILE, "left_anti") for k in ("files", "symbols", "imports", "asked")}

    moved = delta.where("change <> 'changed'").select("repo_id", F.col("path").alias("candidate"))
    # of all asked paths few are met; that their imports are of kept files is looked up for these
    concerned = index["asked"].join(moved.hint("merge"), ["repo_id", "candidate"], "left_semi").select(*resolve.IMPORT).distinct()
    concerned = concerned.join(touched.hint("merge"), _FILE, "left_anti")
    concerned = tables.stored(concerned.unionByName(new["imports"].select(*resolve.IMPORT)).distinct(), "concerned")
    asked = kept["asked"].unionByName(new["asked"])
    asked = tables.stored(asked, "asked")
    hits = resolve.first_present(asked.join(concerned.hint("merge"), resolve.IMPORT, "left_semi"), after)
    again = kept["imports"].drop("resolved_path").join(concerned.hint("merge"), resolve.IMPORT, "left_semi").unionByName(new["imports"])
    imports = kept["imports"].join(concerned.hint("merge"), resolve.IMPORT, "left_anti").unionByName(again.join(hits.hint("merge"), resolve.IMPORT, "left"))
    out = {"asked": asked, "imports": tables.stored(imports, "imports")}
    for k in ("files", "symbols"):
        out[k] = tables.stored(kept[k].unionByName(new[k]), k)
    out["edges"] = tables.stored(_edges(out["imports"], out["files"]), "edges")
    report = {"files_scanned": new["files"].count(), "imports_resolved": concerned.count(), "files": out["files"].count(), "imports": out["imports"].count()}
    return {k: out[k] for k in TABLES}, report
