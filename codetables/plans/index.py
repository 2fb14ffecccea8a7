"""Index many repositories in one job: files, symbols, imports, edges, chunks, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.operators import chunks, resolve, structure
from codetables.sources import tables
from codetables.sources import tree as trees


def index_repos(tree: DataFrame, store: bool = False) -> dict[str, DataFrame]:
    """Tables of all repositories in ``tree`` (repo_id, path, content).

    Of these only the chunks' files and sections are written at once; with ``store`` statements and symbols, which most tables need, are written once too.
    files has parse_error: where a file leaves a string, comment or bracket open, else null.
    """
    found = trees.source_files(tree)
    files = trees.readable(found)
    code = tables.stored(structure.statements(files), "statements") if store else structure.statements(files)
    symbols = tables.stored(structure.symbols_of(code), "symbols") if store else structure.symbols_of(code)
    imports = resolve.resolve(structure.imports_of(code), tree)
    files = files.join(structure.parse_errors(code).hint("merge"), ["repo_id", "path"], "left")
    edges = resolve.import_edges(imports, files).select("repo_id", F.lit("imports").alias("edge_type"), "source_path", "target_path")
    pieces = chunks.chunk_files(files, symbols.select("repo_id", "path", "kind", "name", "start_line", "end_line"))
    n = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    counters = trees.scanned(tree)
    for df, name in ((found, "files_indexed"), (symbols, "symbols_indexed"), (pieces, "chunks_indexed")):
        counters = counters.join(n(df, name), "repo_id", "left")
    counters = counters.fillna(0, ["files_indexed", "symbols_indexed", "chunks_indexed"])
    return {"files": files, "symbols": symbols, "imports": imports, "edges": edges, "chunks": pieces, "counters": counters}
