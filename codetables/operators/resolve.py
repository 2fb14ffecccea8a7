"""Import resolution: candidate paths by priority, joined to the manifest of a repository's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetables.functions import paths

# Suffixes and index files tried in this order.
JS_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
JS_INDEXES = ["index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs"]
C_SUFFIXES = [".h", ".hpp", ".c", ".cc", ".cpp", ".cxx"]
DOTTED = {"java": [".java"], "kotlin": [".kt", ".kts"], "scala": [".scala"]}


def _under(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def _with(stem: Column, suffixes: list[str], indexes: list[str] = ()) -> Column:
    return F.array(*(F.concat(stem, F.lit(s)) for s in suffixes), *(F.concat(stem, F.lit(f"/{i}")) for i in indexes))


def candidates(grammar: Column, path: Column, module: Column) -> Column:
    """Paths to try, best first; null where the grammar or the module gives none."""
    where = paths.directory(path)
    parts = F.when(where == "", F.array().cast("array<string>")).otherwise(F.split(where, "/"))
    # python: n dots climb n - 1 directories; an absolute module is tried below every directory above the file, deepest first
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.replace(F.regexp_replace(module, r"^\.+|\.+$", ""), F.lit("."), F.lit("/"))
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    relative = F.concat(F.when(rest != "", _with(_under(base, rest), [".py"], ["__init__.py"])).otherwise(F.array().cast("array<string>")), F.array(_under(base, F.lit("__init__.py"))))
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    absolute = F.flatten(F.transform(above, lambda b: _with(_under(b, rest), [".py"], ["__init__.py"])))
    python = F.when(module.startswith("."), relative).otherwise(absolute)
    # javascript family: only relative, rooted and @/ specifiers
    js_base = F.when(module.startswith("@/"), F.regexp_replace(module, "^@/", "")).when(module.startswith("/"), F.regexp_replace(module, "^/+", "")).when(module.startswith("."), _under(where, module))
    js_path = paths.normalised(F.when(js_base.endswith("/") | js_base.rlike(r"(^|/)\.$"), F.concat(js_base, F.lit("/index"))).otherwise(js_base))
    js = _with(js_path, JS_SUFFIXES, JS_INDEXES)
    c_near, c_root = paths.normalised(_under(where, module)), paths.normalised(module)
    c = F.concat(F.array(c_near), _with(c_near, C_SUFFIXES), F.array(c_root), _with(c_root, C_SUFFIXES))
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    ruby = F.concat(_with(paths.normalised(_under(where, module)), [".rb"]), _with(module, [".rb"]))
    rust = F.regexp_replace(F.replace(module, F.lit("::"), F.lit("/")), "^crate/", "")
    out = F.when(grammar == "python", python).when(grammar.isin("javascript", "typescript", "tsx"), js).when(grammar.isin("c", "cpp"), c)
    for name, suffixes in DOTTED.items():
        out = out.when(grammar == name, _with(slashed, suffixes))
    out = out.when(grammar == "go", _with(module, [".go"])).when((grammar == "rust") & module.startswith("crate::"), _with(rust, [".rs"], ["mod.rs"]))
    return out.when(grammar == "ruby", ruby).when(grammar == "php", _with(F.replace(module, F.lit("\\"), F.lit("/")), [".php"]))


def best(asked: DataFrame, manifest: DataFrame, keys: list[str], options: str = "candidates") -> DataFrame:
    """``asked`` with resolved_path: the first of its candidate paths that the repository's manifest holds, else null.

    One row per candidate, an equi-join on (repo_id, path), the best by a partial aggregate; nothing is probed.
    """
    rows = asked.select(*keys, "repo_id", F.posexplode(options).alias("prio", "path"))
    hits = rows.join(manifest.select("repo_id", "path").distinct().hint("merge"), ["repo_id", "path"]).groupBy(*keys).agg(F.min_by("path", "prio").alias("resolved_path"))
    return asked.join(hits.hint("merge"), keys, "left")


#: What names an import.
IMPORT = ["repo_id", "path", "module", "is_relative"]


def asked_paths(imports: DataFrame) -> DataFrame:
    """The columns of IMPORT, candidate, prio: a row per path that an import (a row of ``imports``) may mean.

    Read by candidate this is the reverse index: which imports a path's coming or going can concern.
    """
    options = candidates(F.col("grammar"), F.col("path"), F.col("module"))
    rows = imports.select(*IMPORT, F.posexplode(F.array_distinct(F.array_compact(options))).alias("prio", "candidate"))
    return rows.select(*IMPORT, "candidate", "prio")


def first_present(asked: DataFrame, manifest: DataFrame) -> DataFrame:
    """The columns of IMPORT, resolved_path: of each import's asked paths the first that its repository holds; imports without one have no row."""
    there = manifest.select("repo_id", F.col("path").alias("candidate")).distinct().hint("merge")
    return asked.join(there, ["repo_id", "candidate"], "left_semi").groupBy(*IMPORT).agg(F.min_by("candidate", "prio").alias("resolved_path"))


def resolve(imports: DataFrame, manifest: DataFrame) -> DataFrame:
    """imports (repo_id, path, grammar, module, is_relative) with resolved_path, null where nothing in the repository fits."""
    return imports.join(first_present(asked_paths(imports), manifest).hint("merge"), IMPORT, "left")


def import_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, source_path, target_path: an edge per import that resolves to an indexed file."""
    targets = files.select("repo_id", F.col("path").alias("target_path")).distinct()
    return resolved.where("resolved_path IS NOT NULL").select("repo_id", F.col("path").alias("source_path"), F.col("resolved_path").alias("target_path")).join(targets, ["repo_id", "target_path"], "left_semi")


def belongs_to_edges(symbols: DataFrame) -> DataFrame:
    """repo_id, symbol_id, path: an edge from each symbol to its file."""
    symbol_id = F.sha2(F.concat_ws("\u0001", "repo_id", "path", "kind", "name", F.col("start_line").cast("string"), F.col("end_line").cast("string")), 256)
    return symbols.select("repo_id", symbol_id.alias("symbol_id"), "path")
