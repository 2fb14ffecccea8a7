"""Tree, path, chunking and structure queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.functions import languages, paths
from codetables.functions import text as tx
from codetables.operators import chunks, explore, resolve, scope, structure
from codetables.queries import adapters as a
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


_DIRS = ", ".join(f"'{d}'" for d in paths.IGNORED_DIRS)
_BINARY = ", ".join(f"'{s}'" for s in paths.BINARY_SUFFIXES)
_NAMES = ", ".join(f"'{s}'" for s in [*paths.IGNORED_FILES, *paths.LOCKFILES])
_PARTS = f"""parts AS (
  SELECT *, string_split(path, '/')[-1] AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1) AS suffix FROM files
), kept AS (
  SELECT *, CASE suffix WHEN '.py' THEN 'Python' WHEN '.ts' THEN 'TypeScript' WHEN '.md' THEN 'Markdown' WHEN '.txt' THEN 'Text' ELSE 'Other' END AS language,
    list_has_any(string_split(dir, '/'), [{_DIRS}]) OR lower(name) IN ({_NAMES}) OR regexp_matches(lower(name), '\\.min\\.(js|css)$') OR lower(suffix) IN ({_BINARY}) AS excluded FROM parts
)"""


@register(f"WITH {a.FILES}, {_PARTS} SELECT repo_id, path, name, dir, suffix, language, excluded FROM kept")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return a.files(spark, sf_dir).select("repo_id", "path", paths.name(p).alias("name"), paths.directory(p).alias("dir"), paths.suffix(p).alias("suffix"), languages.language(p).alias("language"), paths.is_excluded(p).alias("excluded"))


@register(f"""WITH {a.FILES}, {_PARTS}, n AS (SELECT repo_id, language, count(*) AS files FROM kept WHERE NOT excluded GROUP BY ALL)
SELECT repo_id, language, files, round(files / sum(files) OVER (PARTITION BY repo_id), 6) AS share, round(files / max(files) OVER (PARTITION BY repo_id), 6) AS of_largest FROM n""")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.language_histogram(trees.source_files(a.files(spark, sf_dir)))


@register(f"WITH {a.FILES}, {_PARTS} SELECT repo_id, count(*) AS files_scanned, count(*) FILTER (NOT excluded) AS files_indexed FROM kept GROUP BY repo_id")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = a.files(spark, sf_dir)
    kept = trees.source_files(tree).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_indexed"))
    return trees.scanned(tree).join(kept, "repo_id", "left").select("repo_id", "files_scanned", F.coalesce("files_indexed", F.lit(0)).alias("files_indexed"))


_COUNT = "CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({0}, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r')) END"


@register(f"SELECT doc_id, CAST({_COUNT.format('text')} AS INTEGER) AS line_count FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "documents").select("doc_id", tx.line_count(F.col("text")).alias("line_count"))


@register(f"""WITH {a.FILES}, n AS (SELECT repo_id, path, {_COUNT.format('content')} AS line_count, string_split(path, '/') AS p FROM files),
up AS (SELECT repo_id, path, line_count, array_to_string(p[1:-2], '/') AS own, unnest(list_transform(range(0, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS dir FROM n)
SELECT repo_id, dir, count(*) FILTER (own = dir) AS direct_files, count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS INTEGER) AS depth FROM up GROUP BY repo_id, dir""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.files(spark, sf_dir)
    return explore.directory_rollup(f.select("repo_id", "path", tx.line_count(F.col("content")).alias("line_count")))


@register(f"""WITH {a.FILES}, r AS (SELECT DISTINCT repo_id || ':' || regexp_extract(path, '^(.*)/[^/]*$', 1) AS request_id, repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix FROM files),
n AS (SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY path) AS rank FROM r JOIN files USING (repo_id) WHERE starts_with(path, prefix || '/')) SELECT request_id, path, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 30""")
def directory_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.files(spark, sf_dir)
    own = paths.directory(F.col("path"))
    asked = f.select(F.concat("repo_id", F.lit(":"), own).alias("request_id"), "repo_id", F.concat(F.lit("./"), own, F.lit("/")).alias("dir")).distinct()
    return explore.directory_listing(asked, f)


@register(f"""WITH {a.FILES}, r AS (SELECT doc_id AS request_id, repo_id, CASE WHEN doc_id % 2 = 0 THEN path ELSE '/' || string_split(path, '/')[-1] END AS wanted FROM files),
n AS (SELECT request_id, f.path, row_number() OVER (PARTITION BY request_id ORDER BY f.path <> wanted, length(f.path), f.path) AS k FROM r JOIN files f USING (repo_id) WHERE suffix(f.path, wanted)) SELECT request_id, path FROM n WHERE k = 1""")
def path_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.files(spark, sf_dir)
    wanted = F.when(F.expr("doc_id % 2 = 0"), F.col("path")).otherwise(F.concat(F.lit("/"), paths.name(F.col("path"))))
    return explore.resolve_paths(f.select(F.col("doc_id").alias("request_id"), "repo_id", wanted.alias("wanted")), f)


@register(f"""WITH {a.FILES}, {a.LINES}, n AS (SELECT repo_id, path, CAST(max(line_no) AS INTEGER) AS n FROM lines GROUP BY ALL)
SELECT repo_id, path, CAST(CASE WHEN n * 40 > 120 THEN 1 + k * 80 ELSE 1 END AS INTEGER) AS start_line, CAST(CASE WHEN n * 40 > 120 THEN least(100 + k * 80, n * 40) ELSE n * 40 END AS INTEGER) AS end_line
FROM n, LATERAL (SELECT unnest(range(0, CASE WHEN n * 40 > 120 THEN CAST(ceil((n * 40 - 100) / 80) AS BIGINT) + 1 ELSE 1 END)) AS k)""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over spans 40 times as long as the files, so that most are cut."""
    n = a.lines(spark, sf_dir).groupBy("repo_id", "path").agg(F.max("line_no").alias("n"))
    return n.select("repo_id", "path", F.inline(chunks.windows(F.lit(1), F.col("n") * 40)))


@register(f"""WITH {a.FILES}, {a.LINES}, r AS (SELECT *, line_no - row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) AS run FROM lines WHERE regexp_matches(line, '\\S'))
SELECT repo_id, path, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line FROM r GROUP BY repo_id, path, run""")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.paragraph_blocks(a.lines(spark, sf_dir))


@register(f"""WITH {a.FILES}, {a.LINES}, h AS (SELECT *, line_no % 7 = 3 AS heading, max(line_no) OVER (PARTITION BY repo_id, path) AS total FROM lines)
SELECT repo_id, path, CAST(line_no AS INTEGER) AS start_line, CAST(coalesce(lead(line_no) OVER (PARTITION BY repo_id, path ORDER BY line_no) - 1, total) AS INTEGER) AS end_line FROM h WHERE heading""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents with a heading mark on every seventh line, their own marks and underlines escaped."""
    line = F.when(F.expr("line_no % 7 = 3"), F.concat(F.lit("## "), "line")).otherwise(F.concat(F.lit("> "), "line"))
    return chunks.heading_sections(a.lines(spark, sf_dir).withColumn("line", line))


@register("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey AS start_line, l_partkey + CAST(l_quantity AS BIGINT) AS end_line FROM lineitem)
SELECT x.l_suppkey AS file_id, x.start_line, x.end_line FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.l_suppkey = x.l_suppkey AND y.start_line <= x.start_line AND y.end_line >= x.end_line AND (y.start_line < x.start_line OR y.end_line > x.end_line))""")
def top_level_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = a.table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_suppkey").alias("file_id"), F.lit("k").alias("kind"), F.lit("n").alias("name"), F.col("l_partkey").alias("start_line"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end_line"))
    return chunks.top_level(s, ["file_id"]).select("file_id", "start_line", "end_line")


@register()
def chunked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents: sections of Markdown files, packed paragraphs of the others."""
    files = trees.source_files(a.files(spark, sf_dir))
    none = files.select("repo_id", "path", F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")).where("false")
    return chunks.chunk_files(files, none)


_HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@register(f"SELECT DISTINCT page_id, unnest({_HREF}) AS link FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).distinct()


@register(f"""WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS repo_id, unnest({_HREF}) AS link FROM pages),
m AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]*)', 1) AS repo_id, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT page_id, repo_id, link, 0 AS prio, link AS path FROM l UNION ALL SELECT page_id, repo_id, link, 1, '/en' || link FROM l UNION ALL SELECT page_id, repo_id, link, 2, path FROM (SELECT l.*, '/en/' || page_id AS path FROM l)),
b AS (SELECT page_id, link, arg_min(c.path, prio) AS resolved_path FROM c JOIN m USING (repo_id, path) GROUP BY page_id, link)
SELECT l.page_id, l.link, b.resolved_path FROM l LEFT JOIN b USING (page_id, link)""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved against the pages of the same host, the best of three candidates each."""
    host, path = F.regexp_extract("url", r"^https?://([^/]*)", 1), F.regexp_extract("url", r"^https?://[^/]*([^?#]*)", 1)
    p = a.table(spark, sf_dir, "pages")
    links = p.select("page_id", host.alias("repo_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).distinct()
    asked = links.withColumn("candidates", F.array("link", F.concat(F.lit("/en"), "link"), F.concat(F.lit("/en/"), F.col("page_id").cast("string"))))
    return resolve.best(asked, p.select(host.alias("repo_id"), path.alias("path")), ["page_id", "link"]).select("page_id", "link", "resolved_path")


def _made(spark: SparkSession, sf_dir: str, suffix: Column, line: Callable[[Column, Column], Column]) -> DataFrame:
    """Source files whose text is made of the documents' lines, by (line, its number as text); files without a line have none."""
    made = F.transform(tx.lines(F.col("content")), lambda x, i: line(x, (i + 1).cast("string")))
    f = a.files(spark, sf_dir).where("content <> ''")
    return f.select("repo_id", F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), suffix).alias("path"), F.array_join(made, "\n").alias("content"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files made of the documents' lines: a function begins on every fifth line, its body are the next four."""

    def line(x: Column, n: Column) -> Column:
        w = F.regexp_replace(F.substring(F.lower(x), 1, 12), "[^a-z]", "")
        return F.when((n.cast("int") - 1) % 5 == 0, F.concat(F.lit("def f_"), w, F.lit("_"), n, F.lit("():"))).otherwise(F.concat(F.lit("    pass  # "), w))

    return _made(spark, sf_dir, F.lit(".py"), line)


@register(f"""WITH {a.FILES}, {a.LINES}, n AS (SELECT *, max(line_no) OVER (PARTITION BY repo_id, path) AS total FROM lines)
SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') || '.py' AS path, 'function' AS kind, 'f_' || regexp_replace(substr(lower(line), 1, 12), '[^a-z]', '', 'g') || '_' || line_no AS name,
CAST(line_no AS INTEGER) AS start_line, CAST(least(line_no + 4, total) AS INTEGER) AS end_line FROM n WHERE (line_no - 1) % 5 = 0""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.symbols(_code(spark, sf_dir)).select("repo_id", "path", "kind", "name", "start_line", "end_line")


@register(f"WITH {a.FILES} SELECT repo_id, path FROM files WHERE path LIKE 'en/s_c%' AND repo_id IN ('src0', 'src3', 'src7')")
def files_below_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.in_repositories(scope.below_prefix(a.files(spark, sf_dir), "en/s_c"), repo_ids=["src0", "src3", "src7"]).select("repo_id", "path")


@register(f"""WITH {a.FILES}, {a.LINES}, s AS (SELECT repo_id, path, 'f_' || regexp_replace(substr(lower(line), 1, 12), '[^a-z]', '', 'g') || '_' || line_no AS name FROM lines WHERE (line_no - 1) % 5 = 0)
SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') || '.py' AS path, name FROM s WHERE name ILIKE '%THE%'""")
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.name_contains(scope.of_kind(structure.symbols(_code(spark, sf_dir)), "function"), "THE").select("repo_id", "path", "name")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources made of the documents' lines: a block of ten lines for each, a class whose method has its head on several lines.

    Python files carry a line's words in a docstring beside a definition that is none, TypeScript files in a comment and a template beside braces that are none.
    """
    is_python = F.expr("doc_id % 2 = 0")

    def line(x: Column, n: Column) -> Column:
        words = F.trim(F.regexp_replace(F.substring(x, 1, 40), "[^A-Za-z ]", ""))
        python = F.concat(F.lit("class K_"), n, F.lit(":\n    \"\"\""), words, F.lit("\ndef hidden(): {\n    \"\"\"\n    def m_"), n, F.lit("(\n        self,\n        x=\")\",  # ("), words, F.lit("\n    ):\n        return \"}\"\n"))
        script = F.concat(F.lit("class K_"), n, F.lit(" {\n  // } "), words, F.lit("\n  m_"), n, F.lit("(a: string,\n    b = \"{\") {\n    return `} {\n "), words, F.lit("`;\n  }\n  /* { */\n}\n"))
        return F.when(is_python, python).otherwise(script)

    return _made(spark, sf_dir, F.when(is_python, ".py").otherwise(".ts"), line)


@register(f"""WITH {a.FILES}, {a.LINES}, b AS (SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS path, line_no, (line_no - 1) * 10 AS o, doc_id % 2 = 0 AS py FROM lines)
SELECT repo_id, path, 'class' AS kind, 'K_' || line_no AS name, CAST(o + 1 AS INTEGER) AS start_line, CAST(o + 9 AS INTEGER) AS end_line FROM b
UNION ALL SELECT repo_id, path, 'method', 'm_' || line_no, CAST(CASE WHEN py THEN o + 5 ELSE o + 3 END AS INTEGER), CAST(CASE WHEN py THEN o + 9 ELSE o + 7 END AS INTEGER) FROM b""")
def nested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and methods behind heads of several lines, strings and comments, in two grammars."""
    return structure.symbols(_nested(spark, sf_dir)).select("repo_id", "path", "kind", "name", "start_line", "end_line")


@register(f"""WITH {a.FILES} SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') || '.java' AS path, CASE doc_id % 4 WHEN 0 THEN 'line 1: {{ without an end' WHEN 1 THEN 'line 4: unexpected )' ELSE 'line 3: comment without an end' END AS parse_error
FROM files WHERE doc_id % 4 < 3""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end in an open block or comment, or close a bracket too many; every fourth is in order."""
    body = F.expr("CASE doc_id % 4 WHEN 0 THEN 'class A {{\n  void f() {{\n  // }}\n}}\n' WHEN 1 THEN 'class A {{\n  void f() {{\n  }}\n)\n}}\n' WHEN 2 THEN 'class A {{\n}}\n/* }}\n' ELSE 'class A {{ char c = \"{{\"; }}\n' END".replace("{{", "{").replace("}}", "}").replace("\n", "\\n"))
    f = a.files(spark, sf_dir).select("repo_id", F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit(".java")).alias("path"), body.alias("content"))
    return structure.parse_errors(structure.statements(f))


@register(f"""WITH {a.FILES}, {a.LINES}, r AS (SELECT *, line_no - row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) AS run FROM lines WHERE regexp_matches(line, '\\S') AND line_no % 3 <> 0),
b AS (SELECT repo_id, path, min(line_no) AS s, max(line_no) AS e FROM r GROUP BY repo_id, path, run),
l AS (SELECT repo_id, path, list([{{'s': s, 'e': e}}] ORDER BY s) AS blocks FROM b GROUP BY repo_id, path),
p AS (SELECT repo_id, path, unnest(list_reduce(blocks, lambda acc, x: CASE WHEN x[1].e - acc[-1].s + 1 <= 6 THEN acc[:-2] || [{{'s': acc[-1].s, 'e': x[1].e}}] ELSE acc || x END)) AS span FROM l)
SELECT repo_id, path, CAST(span.s AS INTEGER) AS start_line, CAST(span.e AS INTEGER) AS end_line FROM p""")
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents, every third line taken as blank, packed to spans of at most six lines."""
    rows = a.lines(spark, sf_dir).withColumn("line", F.when(F.expr("line_no % 3 = 0"), "").otherwise(F.col("line")))
    return chunks.packed(chunks.paragraph_blocks(rows), 6)


@register(f"""WITH {a.FILES}, {a.LINES}, b AS (SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS path, (line_no - 1) * 10 AS o, line_no, line FROM lines)
SELECT repo_id, path, 'class' AS kind, 'K_' || line_no AS name, CAST(o + 1 AS INTEGER) AS start_line, CAST(o + 9 AS INTEGER) AS end_line, 9 AS n_lines FROM b""")
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of sources with symbols: their top-level classes, methods inside them not again."""
    made = _nested(spark, sf_dir).withColumn("path", F.regexp_replace("path", "node_modules", "modules"))
    f = trees.source_files(tables.stored(made, "made"))  # read several times, made once
    found = chunks.chunk_files(f, structure.symbols(f).select("repo_id", "path", "kind", "name", "start_line", "end_line"))
    n = F.size(F.split("content", "\n"))
    return found.select("repo_id", F.regexp_replace("path", "/modules/", "/node_modules/").alias("path"), "kind", "name", "start_line", "end_line", n.alias("n_lines"))
