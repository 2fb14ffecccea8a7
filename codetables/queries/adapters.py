"""The driver's tables in the shapes of the library; the same expressions as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, *values: str):
    out = F.when(F.expr(key) == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.expr(key) == k, v)
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, content, doc_id of a derived tree: one repository per source."""
    path = F.concat(F.col("lang"), F.lit("/"), _pick("doc_id % 5", "tests", "node_modules", "src", "src/app", "docs"), F.lit("/"), F.when(F.expr("doc_id % 7") == 0, "test_").otherwise(""), F.lit("doc_"), F.col("doc_id").cast("string"), _pick("doc_id % 6", ".py", ".ts", ".md", ".lock", ".png", ".txt"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), path.alias("path"), F.col("text").alias("content"), "doc_id")


FILES = """files AS (
  SELECT source AS repo_id,
    lang || '/' || CASE doc_id % 5 WHEN 0 THEN 'tests' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'src' WHEN 3 THEN 'src/app' ELSE 'docs' END || '/'
    || CASE WHEN doc_id % 7 = 0 THEN 'test_' ELSE '' END || 'doc_' || doc_id
    || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.lock' WHEN 4 THEN '.png' ELSE '.txt' END AS path,
    text AS content, doc_id FROM documents
)"""

LINES = """lines AS (
  SELECT repo_id, path, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM (
    SELECT repo_id, path, doc_id, regexp_split_to_array(regexp_replace(content, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS parts
    FROM files WHERE coalesce(content, '') <> '')
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codetables.operators import chunks

    return chunks.lines_table(files(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, vector, language, path."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("language"), F.concat(F.lit("f"), (F.col("vec_id") % 50).cast("string")).alias("path"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    c = chunks(spark, sf_dir)
    return c.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem")
    return e.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")).distinct()


EDGES = "edges AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id FROM lineitem)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs: status by order status, times and counters from the lines of an order."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("files_indexed"), F.max("l_shipdate").alias("finished_at"), F.sum("l_linenumber").alias("symbols_indexed"), F.countDistinct("l_partkey").alias("chunks_indexed"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("repo_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), "finished_at", F.col("o_orderdate").alias("created_at"), "files_indexed", "symbols_indexed", "chunks_indexed", F.col("o_orderpriority").alias("mode"))


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS repo_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
    o_orderdate AS started_at, n.finished_at, o_orderdate AS created_at, n.files_indexed, n.symbols_indexed, n.chunks_indexed, o_orderpriority AS mode
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS files_indexed, max(l_shipdate) AS finished_at, sum(l_linenumber) AS symbols_indexed, count(DISTINCT l_partkey) AS chunks_indexed FROM lineitem GROUP BY l_orderkey) n ON l_orderkey = o_orderkey
)"""

#: model, price of a million input and output tokens, for the derived usage table; one model has no price.
PRICES = [("click", 0.15, 0.6), ("view", 0.075, 0.3), ("purchase", 2.5, 10.0), ("signup", 0.8, 4.0)]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("model"), F.col("user_id"), F.floor(F.col("value") * 100).alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"), F.col("user_id").cast("double").alias("latency_ms"), F.col("ts").cast("timestamp").alias("ts"))


USAGE = """usage AS (
  SELECT event_type AS model, user_id, CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens, CAST(user_id AS DOUBLE) AS latency_ms, ts FROM events
), prices(model, input_price, output_price) AS (VALUES """ + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES) + """
), priced AS (
  SELECT u.*, round((input_tokens / 1e6) * coalesce(input_price, 0.0) + (output_tokens / 1e6) * coalesce(output_price, 0.0), 6) AS cost_usd FROM usage u LEFT JOIN prices p ON p.model = u.model
)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, repo_id, path, patch: each file's lines marked as added, removed or kept, a header every 20 lines."""
    from codetables.functions import text as tx

    def marked(line, at):
        n = at + 1
        header = F.concat(F.lit("@@ -"), n.cast("string"), F.lit(",20 +"), n.cast("string"), F.lit(",20 @@\n"))
        kind = (F.col("doc_id") + n) % 5
        return F.concat(F.when(at % 20 == 0, header).otherwise(""), F.when(kind.isin(0, 3), "+").when(kind == 1, "-").otherwise(" "), line)

    f = files(spark, sf_dir).where("repo_id IS NOT NULL AND path IS NOT NULL AND content <> ''")
    patch = F.array_join(F.transform(tx.lines(F.col("content")), marked), "\n")
    return f.select(F.concat(F.col("repo_id"), F.lit("#"), F.substring("path", 1, 2)).alias("change_id"), "repo_id", "path", patch.alias("patch"))


RANGES = """marks AS (
  SELECT repo_id, path, repo_id || '#' || substr(path, 1, 2) AS change_id, (line_no - 1) // 20 + 1 AS hunk, line_no, (doc_id + line_no) % 5 AS m FROM lines
), numbered AS (
  SELECT *, (hunk - 1) * 20 + 1 + coalesce(sum(CASE WHEN m <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY change_id, path, hunk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_line FROM marks
), added AS (
  SELECT *, new_line - row_number() OVER (PARTITION BY change_id, path, hunk ORDER BY new_line) AS run FROM numbered WHERE m IN (0, 3)
), ranges AS (
  SELECT change_id, repo_id, path, CAST(hunk AS BIGINT) AS hunk, CAST(min(new_line) AS INTEGER) AS start_line, CAST(max(new_line) AS INTEGER) AS end_line FROM added GROUP BY change_id, repo_id, path, hunk, run
)"""


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, content, doc_id of Python modules whose imports name other modules of their repository.

    A document is the module ``<lang>/p<id % 5>/m<id>.py``; it imports the next one of its folder relatively, the next one of its repository from
    the root, the next one of the folder beside it by two dots, and one module from elsewhere.  The table is made once and written: its
    windows sort ids only, so what follows them in the same stage would be a task or two.
    """
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    near = Window.partitionBy("source", "lang", F.expr("doc_id % 5")).orderBy("doc_id")
    far = Window.partitionBy("source").orderBy("doc_id")
    d = d.select("source", "lang", "doc_id", F.lead("doc_id").over(near).alias("near"), F.lead(F.struct("lang", "doc_id")).over(far).alias("far"))
    number = lambda c: F.col(c).cast("string")
    package = lambda c: (F.col(c) % 5).cast("string")
    own = F.when(F.col("near").isNotNull(), F.concat(F.lit("from .m"), number("near"), F.lit(" import (\n    x,\n)\n"))).otherwise("from .gone import x\n")
    root = F.when(F.col("far").isNotNull(), F.concat(F.lit("import "), F.col("far.lang"), F.lit(".p"), package("far.doc_id"), F.lit(".m"), number("far.doc_id"), F.lit("\n"))).otherwise("")
    beside = F.when(F.col("far.lang") == F.col("lang"), F.concat(F.lit("from ..p"), package("far.doc_id"), F.lit(".m"), number("far.doc_id"), F.lit(" import y\n"))).otherwise("")
    d = tables.spread(d, "source", "doc_id")
    path = F.concat("lang", F.lit("/p"), package("doc_id"), F.lit("/m"), number("doc_id"), F.lit(".py"))
    code = F.concat(F.lit('"""\nimport hidden\n"""\nimport os\n'), own, root, beside, F.lit("\n\ndef f():\n    pass\n"))
    return tables.stored(d.select(F.col("source").alias("repo_id"), path.alias("path"), code.alias("content"), "doc_id"), "project")


PROJECT = """d AS (
  SELECT source, lang, doc_id, lead(doc_id) OVER (PARTITION BY source, lang, doc_id % 5 ORDER BY doc_id) AS near, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS far, lead(lang) OVER (PARTITION BY source ORDER BY doc_id) AS far_lang
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
), asked AS (
  SELECT source AS repo_id, lang || '/p' || doc_id % 5 || '/m' || doc_id || '.py' AS path, doc_id, unnest([
    {'m': 'os', 'r': false, 't': NULL, 'id': NULL},
    CASE WHEN near IS NULL THEN {'m': '.gone', 'r': true, 't': NULL, 'id': NULL} ELSE {'m': '.m' || near, 'r': true, 't': lang || '/p' || near % 5 || '/m' || near || '.py', 'id': near} END,
    CASE WHEN far IS NOT NULL THEN {'m': far_lang || '.p' || far % 5 || '.m' || far, 'r': false, 't': far_lang || '/p' || far % 5 || '/m' || far || '.py', 'id': far} END,
    CASE WHEN far_lang = lang THEN {'m': '..p' || far % 5 || '.m' || far, 'r': true, 't': lang || '/p' || far % 5 || '/m' || far || '.py', 'id': far} END]) AS i FROM d
), resolved AS (
  SELECT DISTINCT repo_id, path, i.m AS module, i.r AS is_relative, i.t AS resolved_path, doc_id, i.id AS target_id FROM asked WHERE i IS NOT NULL
)"""
