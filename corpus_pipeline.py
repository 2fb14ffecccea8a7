"""The corpus pipeline: toxicity, language, exact and near duplicates, packing; each stage is one operator of codetables.llm.

All stages take whole texts of any length, keep every column whatever its name, treat rows with null or repeated ids like
others, and return an empty table of the same columns for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm import exact_dedup, jaccard_join, langid, packing, toxicity
from codetables.llm.common import documents, shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a document that scores 0.5 or more goes.

    A null text scores as an empty one does; repeated rows and equal texts share their fate.  Rows of ``labels`` with a
    null id or mark teach nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accept(docs, toxicity.train(docs, labels))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a document without letters, or in no clear language, goes.

    So null and empty texts go; repeated rows and equal texts share their fate.  Rows with a null language teach nothing.
    """
    return langid.accept(docs, langid.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of texts that are equal but for white space, the longest stays.

    Of equally long ones the smallest id stays, a null id last, and of rows equal in id and text one.  Null, empty and
    blank texts are equal, so one of them stays.
    """
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of documents that 5-word Jaccard links of 0.8 or more connect, the one of smallest id stays.

    A null id comes last.  Null, empty and blank texts link with nothing and stay; of rows equal in id and text one stays, these included.
    """
    marks = jaccard_join.mark(docs, n=5, num=80, den=100)
    keep = marks.where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("raw").alias("_keep_raw"))
    raw = F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["_keep_id"]) & (raw == keep["_keep_raw"]), "left_semi")
    repeats = marks.where("kept").groupBy("doc_id", "raw").count().where("count > 1")
    return kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of documents in sequences of 4096 ids along the Hilbert curve.

    A null or empty text is its end id alone; null and repeated ids and equal rows each keep their own pieces.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language", with_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("packing", packed),
]

#: No stage but the third is SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
