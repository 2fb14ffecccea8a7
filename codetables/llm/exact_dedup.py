"""Operator 4: exact duplicates by a 128-bit content hash, with the bytes compared inside each group.

Only DataFrame functions.  One pass makes a narrow row per document (hash, digest, length); groups are
counted and their best row found by partial aggregates, so a group that holds a third of all rows shuffles
one row per task.  The bytes are compared as min(text) = max(text) per group, again a partial aggregate,
over the documents of groups with two rows or more; these are fetched by id, which no key makes uneven.  Large groups get their result by a broadcast of their few keys, the others by a join.
A group whose texts differ (a collision) is split by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm.common import Scratch, documents, join_groups, written

#: ASCII white space, which the comparison ignores.
SPACE = " \t\n\x0b\x0c\r"


def content(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, raw (a hash of the text as it is): one row per row of ``df``.

    Texts are equal when identical without ASCII white space; null counts as empty.  Of equal texts the
    one with the most code points stays, then the smallest id, a null id last; of repeated rows exactly one.
    ``content_hash`` may be any function of the text: a weak one costs time, not correctness.  Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    body = content(F.col("text"))
    rows = docs.select("doc_id", content_hash(body).alias("h"), F.sha2(body, 256).alias("text_sha256"), F.length("text").alias("len"), F.xxhash64("text").alias("raw"))
    scratch = Scratch(df.sparkSession)
    rows = scratch.written(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")

    repeated = scratch.written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup-repeated")
    ids = join_groups(rows.select("h", "doc_id"), repeated, ["h"], "n").select(F.col("doc_id").alias("dup_id")).distinct()
    texts = docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("dup_id")), "left_semi")
    texts = texts.select("doc_id", content_hash(body).alias("h"), F.length("text").alias("len"), F.xxhash64("text").alias("raw"), body.alias("body"))
    collided = texts.groupBy("h").agg(F.min("body").alias("first"), F.max("body").alias("last")).where("first <> last").select("h")

    variant = F.lit("")
    key = ["h", "variant"]
    if not collided.isEmpty():
        split = texts.join(collided, "h", "left_semi").select("doc_id", "h", "len", "raw", F.col("body").alias("variant")).distinct()
        same_id = rows["doc_id"].eqNullSafe(split["doc_id"])
        rows = rows.join(split, (rows["h"] == split["h"]) & same_id & (rows["len"] == split["len"]) & (rows["raw"] == split["raw"]), "left").select(rows["*"], F.coalesce(split["variant"], F.lit("")).alias("variant"))
    else:
        rows = rows.withColumn("variant", variant)
    best = F.min(F.struct(-F.col("len"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    groups = scratch.written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best), "dedup-groups")
    marks = join_groups(rows, groups, key, "group_size").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "raw"
    )
    out = written(marks, "dedup-marks")
    scratch.clear()
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``mark`` keeps, all columns; of repeated rows one stays."""
    marks = mark(df, id_col, text_col)
    repeats = marks.groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    keep = repeats.where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("raw").alias("_keep_raw"))
    raw = F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit("")))
    kept = df.join(keep.hint("shuffle_hash"), df[id_col].eqNullSafe(keep["_keep_id"]) & (raw == keep["_keep_raw"]), "left_semi")
    return kept if repeats.where("n > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(documents(spark, sf_dir)).drop("raw")


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS body FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY length(t) DESC, doc_id)
"""
