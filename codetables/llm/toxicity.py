"""Operator 10: toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (with word ends) and itself; a document is the average
of its words' vectors; two linear outputs and a softmax give the score.  Unseen misspellings share n-grams
and therefore vectors with the words they come from.  Because everything after the embedding is linear,
scoring needs one number per n-gram: its embedding times the difference of the two outputs.

Words that carry the class are few in a long text, so averages are taken over runs of ``WINDOW`` words (the last run
is the last ``WINDOW`` words) and a document scores as its highest run: training picks, in each epoch, the run that the present model rates highest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm import chunks
from codetables.llm.common import batches_of, crc_mod, documents, with_columns

#: Labelled rows of each class that training takes at most, in the order of a hash of their ids, and bytes of the longest text among them.
TRAIN_ROWS, TRAIN_BYTES = 2000, 1 << 15
BUCKETS, DIM, GRAMS, WINDOW, EPOCHS, SEED = 1 << 18, 8, (3, 4, 5, 6), 8, 16, 7
#: Words whose n-grams a worker remembers.
WORDS = 300_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, number of the word they belong to) of each word itself and of its n-grams of UTF-8 bytes, in order of the words."""
    marked = [b"<%s>" % w.encode("utf-8", "surrogatepass") for w in words]
    of_byte = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    buckets, of = [np.array([zlib.crc32(w) for w in marked], np.uint64)], [np.arange(len(words))]
    for n in GRAMS:
        m = len(text) - n + 1
        if m < 1:
            continue
        inside = of_byte[:m] == of_byte[n - 1 :]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k : k + m]
        h = h[inside]
        h ^= h >> np.uint64(29)
        buckets.append(h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20))
        of.append(of_byte[:m][inside])
    buckets, of = np.concatenate(buckets) % np.uint64(BUCKETS), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return buckets[order].astype(np.int64), of[order]


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of WINDOW words that together cover all n."""
    if n <= WINDOW:
        return np.array([0]), np.array([n])
    starts = np.append(np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW)
    return starts, starts + WINDOW


def averages(values: np.ndarray) -> np.ndarray:
    starts, ends = windows(len(values))
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return (sums[ends] - sums[starts]) / (ends - starts)


class Model:
    """``value``: for each bucket its part of the logit; ``bias``."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.known = value, bias, {}

    def __reduce__(self):
        return Model, (self.value, self.bias)

    def learn(self, words: list[str]) -> None:
        buckets, of = subwords(words)
        sums = np.bincount(of, self.value[buckets], len(words)) / np.bincount(of, minlength=len(words))
        self.known.update(zip(words, zip(range(len(self.known), len(self.known) + len(words)), sums.tolist(), strict=True), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        """Probability of the class; a text without words has that of the bias."""
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        best = np.zeros(len(texts))
        for i, words in enumerate(split):
            if words:
                word, v = zip(*map(self.known.__getitem__, words), strict=True)
                word = np.array(word)
                best[i] = averages(np.array(v)[np.append(True, word[1:] != word[:-1])]).max()  # a word repeated at once counts once
        return (1 / (1 + np.exp(-np.clip(best + self.bias, -40, 40)))).tolist()


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Embeddings and outputs trained together by Adam on the softmax loss, classes weighted equally."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    docs = [d[np.append(True, d[1:] != d[:-1])] if len(d) else d for d in docs]
    words, parts, counts = list(vocabulary), [], []
    for i in range(0, len(words), 20_000):  # a part at a time: there are some thirty n-grams to a word
        buckets, of_word = subwords(words[i : i + 20_000])
        parts.append(buckets.astype(np.int32))
        counts.append(np.bincount(of_word, minlength=len(words[i : i + 20_000])))
    flat, ends = np.concatenate(parts or [np.zeros(0, np.int32)]), np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))
    del parts, words, vocabulary
    begins = np.append(0, ends[:-1]).astype(np.int64)
    y = np.array(labels, np.int64)
    docs, y = [d for d in docs if len(d)], y[[i for i, d in enumerate(docs) if len(d)]]
    if not docs or len(set(y.tolist())) < 2:
        share = float(np.clip(np.mean(labels) if labels else 0.5, 0.01, 0.99))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        value = (params[0] @ (params[1][:, 1] - params[1][:, 0])).astype(np.float32)
        per_word = np.add.reduceat(value[flat], begins) / (ends - begins)
        picked = []
        for d in docs:
            starts, stops = windows(len(d))
            k = int(np.argmax(averages(per_word[d])))
            picked.append(d[starts[k] : stops[k]])
        for rows in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 32)):
            words = np.concatenate([picked[r] for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(picked[r]) for r in rows])
            counts = ends[words] - begins[words]
            total = int(counts.sum())
            at = np.repeat(begins[words] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
            size = np.bincount(of, minlength=len(rows))
            part = np.repeat(1 / (counts * size[of]), counts)
            doc = np.repeat(of, counts)
            keys, inverse = np.unique(flat[at], return_inverse=True)
            share = np.bincount(doc * len(keys) + inverse, part, len(rows) * len(keys)).reshape(len(rows), len(keys))
            vectors = share @ params[0][keys]
            logits = vectors @ params[1] + params[2]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            grads = [share.T @ (p @ params[1].T), vectors.T @ p, p.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                where = keys if k == 0 else slice(None)
                m, v = moments[k]
                m[where] = 0.9 * m[where] + 0.1 * g
                v[where] = 0.99 * v[where] + 0.01 * g * g
                params[k][where] -= 0.05 * (m[where] / (1 - 0.9**step)) / (np.sqrt(v[where] / (1 - 0.99**step)) + 1e-8)
    difference = params[1][:, 1] - params[1][:, 0]
    return Model((params[0] @ difference).astype(np.float32), float(params[2][1] - params[2][0]))


def training_rows(docs: DataFrame, labels: DataFrame, fold: int | None = 5, per_class: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, text, toxic of at most ``per_class`` rows of each class, the first by a hash of the id.

    Rows whose crc32(id) modulo ``fold`` is 0 are left out.  Rows with a null id or label, or a text of more than ``max_bytes``, are no
    examples; an id that is labelled twice counts with its higher label, one of several texts with the first of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if fold:
        known = known.where(crc_mod("doc_id", fold) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows of two numbers at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    return texts.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row to an id, however often it is repeated


def train(docs: DataFrame, labels: DataFrame, fold: int | None = 5, per_class: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model of ``training_rows``: at most 2 * per_class texts of max_bytes come to the driver (131 MB as set here)."""
    rows = sorted(training_rows(docs, labels, fold, per_class, max_bytes).collect(), key=lambda r: (r.doc_id, r.text))  # the bounded sample
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every whole text, without a shuffle; null counts as empty.

    An empty text scores as the model's bias.  Repeated rows and null ids stay; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            s = np.array([p for run in chunks.groups(texts, len, 1 << 20) for p in m.scores(run)])
            return pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return batches_of(rows, make)

    small = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small.mapInArrow(run, "doc_id long, score double, predicted int")


def accept(df: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below ``limit``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[pa.Array]:
        return [pa.array([p for run in chunks.groups([t or "" for t in texts], len, 1 << 20) for p in shared.value.scores(run)], pa.float64())]

    scored, (name,) = with_columns(df, text_col, ["toxicity"], ["double"], make)
    return scored.where(F.col(name) < limit).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
