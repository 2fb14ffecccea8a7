"""Explorer queries: histograms, directory roll-ups, listings, edges, nested results, ownership, maintenance of dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codetables.functions import paths
from codetables.operators import substring


def language_histogram(files: DataFrame) -> DataFrame:
    """repo_id, language, files, share of the repository, part of its largest language."""
    n = files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"))
    repo = Window.partitionBy("repo_id")
    return n.withColumns({"share": F.round(F.col("files") / F.sum("files").over(repo), 6), "of_largest": F.round(F.col("files") / F.max("files").over(repo), 6)})


def language_map(files: DataFrame) -> DataFrame:
    """repo_id, languages MAP<language, files>."""
    n = files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))


def directory_rollup(files: DataFrame) -> DataFrame:
    """repo_id, dir, depth, direct_files, total_files, total_lines of every directory, the root ('') included."""
    own = paths.directory(F.col("path"))
    rows = files.select("repo_id", "line_count", own.alias("own"), F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return rows.groupBy("repo_id", "dir").agg(
        F.count_if(F.col("own") == F.col("dir")).alias("direct_files"), F.count(F.lit(1)).alias("total_files"), F.sum("line_count").cast("long").alias("total_lines")
    ).withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))))


def tree_entries(files: DataFrame, parent: str = "") -> DataFrame:
    """name, is_file of what lies directly in a directory, directories first, then by name."""
    below = files.where(F.lit(True) if parent == "" else F.col("path").startswith(parent + "/"))
    rest = F.substring("path", len(parent) + 2, 1 << 30) if parent else F.col("path")
    parts = F.split(rest, "/")
    return below.select(parts[0].alias("name"), (F.size(parts) == 1).alias("is_file")).distinct().orderBy("is_file", "name")


def directory_listing(requests: DataFrame, files: DataFrame, n: int = 30) -> DataFrame:
    """request_id, path, rank: the first n files by path below each requested directory."""
    asked = requests.select("request_id", "repo_id", paths.listing_prefix(F.col("dir")).alias("dir"))
    below = files.select("repo_id", "path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    order = Window.partitionBy("repo_id", "dir").orderBy("path")
    first = below.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return asked.join(first.hint("merge"), ["repo_id", "dir"]).select("request_id", "path", "rank")


def resolve_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, path: the file of that very path, else one that ends with it: the shortest, then the first by name."""
    asked, held = requests.select("request_id", "repo_id", "wanted"), files.select("repo_id", "path")
    # with a slash the last segment is a whole name; else through the trigrams that name and path share
    named = asked.where("contains(wanted, '/')").withColumn("name", paths.name(F.col("wanted")))
    named = named.join(held.withColumn("name", paths.name(F.col("path"))).hint("merge"), ["repo_id", "name"]).where("endswith(path, wanted)")
    bare = asked.where("NOT contains(wanted, '/')")
    ends = substring.pairs(bare, held, "repo_id", "wanted", "path", "endswith(path, wanted)", like=False)
    both = named.select("request_id", "wanted", "path").unionByName(bare.join(ends.hint("merge"), ["repo_id", "wanted"]).select("request_id", "wanted", "path"))
    order = F.struct(F.col("path") != F.col("wanted"), F.length("path"), F.col("path"))
    return both.groupBy("request_id").agg(F.min_by("path", order).alias("path"))


def edge_list(edges: DataFrame, nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Edges with the names of both ends; nodes: id, name."""
    s, t = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    out = edges.join(s, "source_id").join(t, "target_id")
    return out if n is None else out.orderBy("source_name", "target_name", "source_id", "target_id").limit(min(n, 2000))


def neighbours(edges: DataFrame) -> DataFrame:
    """id, imports, imported_by: sorted neighbours both ways."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("imports"))
    back = edges.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set("source_id")).alias("imported_by"))
    none = F.array().cast(out.schema["imports"].dataType)
    return out.join(back, "id", "full").select("id", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """Parents with a sorted array of structs of their children; none gives an empty array."""
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def symbol_lookup(requests: DataFrame, symbols: DataFrame, n: int = 5) -> DataFrame:
    """The first n symbols by kind and name that contain each requested text, whatever its case."""
    asked = requests.withColumn("pattern", F.concat(F.lit("%"), "wanted", F.lit("%")))
    found = substring.like_pairs(asked, symbols, "repo_id", text="name", fold=True)
    hit = asked.join(found.hint("merge"), ["repo_id", "pattern"]).drop("pattern").join(symbols.hint("merge"), ["repo_id", "name"])
    order = Window.partitionBy("request_id").orderBy("kind", "name", "path", "start_line")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, 1000))


def in_scope(requested: DataFrame, owned: DataFrame) -> DataFrame:
    """user_id, repo_id each user may search: requested and owned; a user who asks for none gets all owned."""
    silent = owned.join(requested.select("user_id").distinct(), "user_id", "left_anti")
    return owned.join(requested, ["user_id", "repo_id"], "left_semi").unionByName(silent)


def not_indexed(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    return repos.join(chunks, "repo_id", "left_anti")


def by_name(repos: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return repos if not q else repos.where(F.lower("full_name").contains(q))


def upsert_missing(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """target and those incoming rows whose key it lacks, each key once (the smallest row)."""
    new = incoming.join(target, key, "left_anti").groupBy(key).agg(F.min(F.struct(*incoming.columns)).alias("r")).select("r.*")
    return target.unionByName(new)


def append_rows(dimension: DataFrame, incoming: DataFrame, key: list[str], created: str = "created_at") -> DataFrame:
    """dimension and the incoming rows of new keys, each key once (its smallest row), with the time they came; a null key is one like others.

    incoming has the dimension's columns but ``created``.
    """
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    new = incoming.alias("i").join(dimension.select(*key).distinct().hint("merge").alias("d"), same, "left_anti")
    once = new.groupBy(*key).agg(F.min(F.struct(*incoming.columns)).alias("r")).select("r.*")
    return dimension.unionByName(once.withColumn(created, F.current_timestamp()))


def patch_non_null(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the patch's values where these aren't null."""
    columns = [c for c in patch.columns if c != key]
    p = patch.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    return base.join(p, key, "left").select(*(F.coalesce(f"_p_{c}", c).alias(c) if c in columns else c for c in base.columns))


def cascade_delete(removed: DataFrame, tables: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Tables without the rows of removed keys: each table names the column that refers to the keys."""
    key = removed.columns[0]
    return [t.join(removed.select(F.col(key).alias(c)), c, "left_anti") for t, c in tables]
