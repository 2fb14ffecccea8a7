"""Text search and its evaluation: an encoder fitted on chunks, queries in the same space, ranked hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.operators import retrieval

DIMENSION = 768


class HashEncoder:
    """The default encoder: hashed word counts, inverse document frequencies, unit length; all in Spark ML."""

    def __init__(self, dimension: int = DIMENSION, text_col: str = "text"):
        self.dimension, self.text_col, self.model = dimension, text_col, None

    def fit(self, df: DataFrame) -> HashEncoder:
        steps = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"), HashingTF(numFeatures=self.dimension, inputCol="_words", outputCol="_tf"), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit")]
        self.model: PipelineModel = Pipeline(stages=steps).fit(self._text(df))
        return self

    def _text(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_text", F.coalesce(F.col(self.text_col), F.lit("")))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with vector ARRAY<FLOAT>."""
        out = self.model.transform(self._text(df)).withColumn("vector", vector_to_array("_unit", "float32"))
        return out.drop("_text", "_words", "_tf", "_idf", "_unit")


def encode_with(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text", batch: int = 16, most_chars: int | None = None) -> DataFrame:
    """df with vector from any model: ``load`` runs once per task, and gives a function from texts to vectors."""
    at, given = df.columns.index(text_col), [*df.columns, "vector"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in rows:
            texts = [(t or "")[:most_chars] for t in b.column(at).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pa.record_batch([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], given)

    from pyspark.sql.types import ArrayType, FloatType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("vector", ArrayType(FloatType())))


def search(queries: DataFrame, chunks: DataFrame, encoder, k: int = 10, same: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank; blank queries are dropped.  chunks have vectors of the same encoder."""
    asked = encoder.transform(queries.where(F.trim(F.coalesce("text", F.lit(""))) != ""))
    return retrieval.knn_join(asked, chunks, k, same)


def evaluate(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5, 10 and mean reciprocal rank, over all questions."""
    return retrieval.metrics(retrieval.first_hits(hits, questions))
