"""Cards, imports and their resolution, listings and texts for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.functions import paths
from codetables.functions import text as tx
from codetables.operators import assembly, chunks, explore, observe, resolve, scope, structure
from codetables.plans import reindex
from codetables.queries import adapters as a
from codetables.queries.graphs import _spans
from codetables.queries.trees import _COUNT, _PARTS, _nested
from codetables.sources import tables
from codetables.sources import tree as trees

QUERIES, ORACLE_SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@register(f"WITH {a.EDGES} SELECT source_id, target_id, s.p_name AS source_name, t.p_name AS target_name FROM edges JOIN part s ON s.p_partkey = source_id JOIN part t ON t.p_partkey = target_id")
def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return explore.edge_list(a.edges(spark, sf_dir), nodes).select("source_id", "target_id", "source_name", "target_name")


@register(f"""WITH {a.EDGES}, o AS (SELECT source_id AS id, string_agg(CAST(target_id AS VARCHAR), ', ' ORDER BY target_id) AS s FROM edges GROUP BY 1),
i AS (SELECT target_id AS id, string_agg(CAST(source_id AS VARCHAR), ', ' ORDER BY source_id) AS s FROM edges GROUP BY 1)
SELECT coalesce(o.id, i.id) AS id, concat_ws(chr(10), 'imports: ' || o.s, 'imported by: ' || i.s) AS card FROM o FULL JOIN i ON o.id = i.id""")
def dependency_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.dependency_cards(explore.neighbours(a.edges(spark, sf_dir)))


@register(f"""WITH {a.FILES}, r AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN path || 'x' ELSE path END AS wanted FROM files)
SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 OR content IS NULL OR path IS NULL OR repo_id IS NULL THEN 'No file ' || coalesce(wanted, '')
ELSE '# ' || path || chr(10) || CASE WHEN length(content) <= 600 THEN content ELSE substr(content, 1, 600) || chr(10) || '[' || (length(content) - 600) || ' characters left out]' END END AS card FROM r""")
def file_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per requested file; a third of the requests name files that don't exist."""
    f = a.files(spark, sf_dir)
    wanted = F.when(F.expr("doc_id % 3 = 0"), F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    return assembly.file_cards(f.select(F.col("doc_id").alias("request_id"), "repo_id", wanted.alias("path")), f.select("repo_id", "path", "content"), 600)


@register(f"""WITH {a.FILES}, {_PARTS}, n AS (SELECT repo_id, language, count(*) AS n FROM kept WHERE NOT excluded GROUP BY ALL)
SELECT repo_id, string_agg(language || ':' || n, ',' ORDER BY language) AS languages FROM n GROUP BY repo_id""")
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explore.language_map(trees.source_files(a.files(spark, sf_dir)))
    entries = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return found.select("repo_id", F.array_join(entries, ",").alias("languages"))


@register(f"WITH {a.FILES} SELECT DISTINCT split_part(substr(path, 8), '/', 1) AS name, strpos(substr(path, 8), '/') = 0 AS is_file FROM files WHERE starts_with(path, 'en/src/')")
def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.tree_entries(a.files(spark, sf_dir), "en/src")


@register(f"WITH {a.FILES} SELECT repo_id, path FROM files ORDER BY path NULLS FIRST, doc_id NULLS FIRST LIMIT 200 OFFSET 10")
def page_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.page(a.files(spark, sf_dir).select("repo_id", "path", "doc_id"), ["path", "doc_id"], 10, 200).select("repo_id", "path")


@register("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 50 = 7")
def chunks_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.in_file(a.chunks(spark, sf_dir), "f7").select("chunk_id")


@register(f"""WITH {a.FILES}, s AS (SELECT repo_id, path, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS name FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name, path) AS rank FROM s WHERE name ILIKE '%C_1%' AND repo_id IS NOT NULL)
SELECT repo_id AS request_id, path, name, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5""")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five symbols of every repository whose name holds a text, whatever its case."""
    f = a.files(spark, sf_dir)
    symbols = f.select("repo_id", "path", F.lit("function").alias("kind"), paths.stem(F.col("path")).alias("name"), F.lit(1).alias("start_line"))
    asked = f.select("repo_id").distinct().select(F.col("repo_id").alias("request_id"), "repo_id", F.lit("C_1").alias("wanted"))
    return explore.symbol_lookup(asked, symbols).select("request_id", "path", "name", "rank")


@register(f"""WITH {a.FILES}, n AS (SELECT *, CAST({_COUNT.format('content')} AS INTEGER) AS n FROM files)
SELECT doc_id, '# file: ' || path || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '# symbol: function f' || doc_id || ' (lines 1-' || n || ')' ELSE '# section: lines 1-' || n END || chr(10) || chr(10) || content AS embedding_text FROM n""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and text of each file: every other one is a named symbol."""
    name = F.when(F.expr("doc_id % 2 = 0"), F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    body = tx.embedding_text(F.col("path"), F.lit("function"), name, F.lit(1), tx.line_count(F.col("content")), F.col("content"))
    return a.files(spark, sf_dir).select("doc_id", body.alias("embedding_text"))


@register(f"WITH {a.FILES}, {a.LINES} SELECT repo_id, path, string_agg(line, chr(10) ORDER BY line_no, line) AS content FROM lines GROUP BY repo_id, path")
def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from chunks of one line."""
    return assembly.file_text(a.lines(spark, sf_dir).select("repo_id", "path", F.col("line_no").alias("start_line"), F.col("line").alias("content")))


@register(f"WITH {a.FILES}, {a.LINES} SELECT repo_id, path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM lines GROUP BY repo_id, path")
def overlapping_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from chunks of five lines, three lines apart, and one of all but the last line."""
    f = a.files(spark, sf_dir).select("repo_id", "path", tx.lines(F.col("content")).alias("lines")).where(F.size("lines") > 0)
    windows = f.select("repo_id", "path", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"), F.lit(3))).alias("start_line")).withColumn("content", F.array_join(F.slice("lines", F.col("start_line"), F.lit(5)), "\n"))
    most = f.where(F.size("lines") > 1).select("repo_id", "path", F.lit(1).alias("start_line"), F.array_join(F.slice("lines", F.lit(1), F.size("lines") - 1), "\n").alias("content"))
    return assembly.file_text(windows.select(*most.columns).unionByName(most))


@register(f"""WITH {a.FILES}, {a.LINES}, b AS (SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') || '.py' AS path, line_no, (line_no - 1) * 10 AS o FROM lines WHERE doc_id % 2 = 0 AND line_no < 10)
SELECT repo_id || ' ' || line_no AS request_id, string_agg('class K_' || line_no || ' — ' || path || ':' || (o + 1) || '-' || (o + 9) || chr(10) || 'class K_' || line_no || ':' || chr(10) || '   ', chr(10) || chr(10) ORDER BY path) AS card
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, line_no ORDER BY path) AS n FROM b) WHERE n <= 5 GROUP BY 1""")
def symbol_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the classes that bear a name in each repository, five at most; of a class's text the first 14 characters."""
    made = _nested(spark, sf_dir).withColumn("path", F.regexp_replace("path", "node_modules", "modules")).where("path LIKE '%.py'")
    f = trees.source_files(tables.stored(made, "made"))  # read several times, made and scanned once
    symbols = tables.stored(structure.symbols(f).where("kind = 'class' AND length(name) = 3"), "symbols")
    pieces = chunks.chunk_files(f, symbols.select("repo_id", "path", "kind", "name", "start_line", "end_line"))
    asked = f.select("repo_id").distinct().select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: k.cast("string"))).alias("k"))
    asked = asked.select(F.concat("repo_id", F.lit(" "), "k").alias("request_id"), "repo_id", F.concat(F.lit("K_"), "k").alias("wanted"))
    found = explore.symbol_lookup(asked, symbols).withColumn("path", F.regexp_replace("path", "/modules/", "/node_modules/"))
    bodies = pieces.select("repo_id", F.regexp_replace("path", "/modules/", "/node_modules/").alias("path"), "name", "start_line", F.substring("content", 1, 14).alias("content"))
    return assembly.symbol_cards(found, bodies, 100)


@register(f"WITH {a.PROJECT} SELECT repo_id, path, module, is_relative, resolved_path FROM resolved")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, rooted and foreign imports of modules made of the documents' ids, behind a docstring that holds one too."""
    p = a.project(spark, sf_dir)
    return resolve.resolve(structure.imports(p), p).select("repo_id", "path", "module", "is_relative", "resolved_path")


@register(f"WITH {a.PROJECT} SELECT repo_id, path AS source_path, resolved_path AS target_path FROM resolved WHERE resolved_path IS NOT NULL AND target_id % 3 <> 0")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per import that resolves to an indexed file; every third file isn't indexed."""
    p = a.project(spark, sf_dir)
    return resolve.import_edges(resolve.resolve(structure.imports(p), p), p.where("doc_id % 3 <> 0")).select("repo_id", "source_path", "target_path")


@register(f"""WITH {a.PROJECT}, kept AS (SELECT * FROM resolved WHERE doc_id % 7 <> 0)
SELECT repo_id, path, module, is_relative, CASE WHEN target_id % 7 <> 0 THEN resolved_path END AS resolved_path FROM kept WHERE doc_id % 7 <> 2 OR module = 'os'""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports after a delta: of the modules every seventh comes, another goes, a third loses all imports but one; only what these concern is worked on again."""
    p = a.project(spark, sf_dir)
    before = p.where("doc_id % 7 <> 1").drop("doc_id")
    after = p.where("doc_id % 7 <> 0").select("repo_id", "path", F.when(F.expr("doc_id % 7 = 2"), "import os\n").otherwise(F.col("content")).alias("content"))
    index, _ = reindex.reindex(reindex.full_index(before), before, after)
    return index["imports"].select("repo_id", "path", "module", "is_relative", "resolved_path")


@register(f"WITH {a.FILES}, {a.LINES} SELECT repo_id, path, sha256(concat_ws(chr(1), repo_id, path, 'function', 's' || line_no, line_no, line_no + 14)) AS symbol_id FROM lines WHERE line_no % 10 = 1")
def belongs_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.belongs_to_edges(_spans(spark, sf_dir)).select("repo_id", "path", "symbol_id")


@register("""WITH n AS (SELECT event_id, CASE event_id % 3 WHEN 1 THEN coalesce(CAST(floor(value * 100) AS BIGINT), 0) WHEN 2 THEN 3 ELSE 0 END AS input_tokens, CASE event_id % 3 WHEN 1 THEN coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) ELSE 0 END AS output_tokens FROM events)
SELECT event_id, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens FROM n WHERE input_tokens + output_tokens > 0""")
def reported_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from the first struct that reports them; a third of the rows reports none."""
    counts = F.struct(F.floor(F.col("value") * 100).alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))
    second = F.struct(F.lit(3).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    rows = a.table(spark, sf_dir, "events").select("event_id", F.when(F.expr("event_id % 3 = 1"), counts).alias("usage_metadata"), F.when(F.expr("event_id % 3 = 2"), second).alias("token_usage"))
    return observe.reported_tokens(rows).select("event_id", "input_tokens", "output_tokens")


@register("SELECT o_orderkey AS repo_id, coalesce(nullif(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_orderpriority END, ''), o_orderstatus) AS branch FROM orders")
def repository_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.expr("o_orderkey % 3 = 0"), "").when(F.expr("o_orderkey % 3 = 1"), F.col("o_orderpriority"))
    return a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo_id"), scope.branch(asked, F.col("o_orderstatus")).alias("branch"))
