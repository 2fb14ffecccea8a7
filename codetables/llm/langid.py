"""Operator 7: language identification by bit-sliced Bloom filters over n-grams of bytes.

One table of slots holds a bitmask of languages per slot, of as many 64-bit words as there are languages for: bit k of a slot belongs
to the Bloom filter of language k, so ANDing the slots that the hash functions name gives, in one lookup, all languages that contain an n-gram.
A language's filter holds the n-grams that are typical of it: seen in several of its training texts, and
at least a given share as often as in the language that uses them most.  For a text, hits per language are
popcounts over its n-grams; a filter that is filled to the share f answers an unseen n-gram with probability
f**hashes, and the share of hits is corrected for that; the highest corrected share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm.common import batches_of, crc_mod, documents, join_groups, texts_of, with_columns, written

#: Labelled rows of each language that training takes at most, in the order of a hash of their ids, and bytes of the longest text among them.
TRAIN_ROWS, TRAIN_BYTES = 400, 1 << 16
#: log2 of the slots, hash functions, texts that must hold an n-gram, share of the highest rate.
SLOT_BITS, HASHES, LEAST_TEXTS, LEAST_SHARE = 17, 2, 2, 0.25

#: Part of all corrected shares below which a text has no clear language.
LEAST_SCORE = 0.3

#: ASCII letters become lower case, other ASCII a space; bytes of other characters stay.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def grams(text: bytes) -> np.ndarray:
    """Windows of four bytes, as numbers, of the folded text; runs of spaces count as one."""
    b = np.frombuffer(b" %s " % text.translate(_FOLD), np.uint8)
    space = b == 32
    b = b[~(space & np.append(False, space[:-1]))].astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


class Model:
    """slots: language bitmasks, a row per 64 languages; names: bit -> language; wrong: false positive rate per language."""

    def __init__(self, names: list[str], slots: np.ndarray, wrong: np.ndarray):
        self.names, self.slots, self.wrong = names, slots, wrong
        self.narrow = len(names) <= 8

    def masks(self, g: np.ndarray) -> np.ndarray:
        h = g.astype(np.uint64)
        out = None
        for m in _MULTIPLIERS[:HASHES]:
            s = self.slots[:, (h * np.uint64(m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            out = s if out is None else out & s
        return out

    def hits(self, g: np.ndarray) -> np.ndarray:
        """How many of the n-grams the filter of each language answers to: its popcount over the masks."""
        masks, out = self.masks(g), []
        for k, word in enumerate(masks):
            if self.narrow:
                kinds, n = np.arange(256, dtype=np.uint64), np.bincount(word.astype(np.uint8), minlength=256)
            else:
                kinds, n = np.unique(word, return_counts=True)
            bits = (kinds[:, None] >> np.arange(min(64, len(self.names) - 64 * k), dtype=np.uint64)) & np.uint64(1)
            out.append(n @ bits.astype(np.float64))
        return np.concatenate(out)

    def shares(self, text: bytes) -> np.ndarray:
        """Share of the text's n-grams that each language contains, corrected for the answers that are wrong."""
        g = grams(text)
        if not len(g):
            return np.zeros(len(self.names))
        return np.clip((self.hits(g) / len(g) - self.wrong) / (1 - self.wrong), 0, 1)

    def predict(self, text: bytes) -> tuple[str, float]:
        """(language, its part of all corrected shares); ``und`` and 0 where no letter or no model is.

        A text of which no language has an n-gram gets the language with most training rows, with score 0.
        """
        if not self.names or not has_letter(text):
            return "und", 0.0
        share = self.shares(text)
        total = share.sum()
        k = int(np.argmax(share))  # of equal shares, the language with more training rows
        return self.names[k], float(share[k] / total) if total > 0 else 0.0


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that several of a language's texts hold (of few texts, any), and the share of texts that hold each."""
    g, n = np.unique(np.concatenate([np.unique(grams(t)) for t in texts]), return_counts=True)
    often = n >= min(LEAST_TEXTS, len(texts))
    return g[often], n[often] / len(texts)


def fit(languages: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """languages: name -> number of training rows, and what ``counted`` makes of them."""
    names = sorted(languages, key=lambda x: (-languages[x][0], x))
    slots = np.zeros((max(1, -(-len(names) // 64)), 1 << SLOT_BITS), np.uint64)
    every = np.unique(np.concatenate([np.zeros(0, np.uint32), *(languages[x][1] for x in names)]))
    most = np.zeros(len(every))
    for _, g, rate in languages.values():
        at = np.searchsorted(every, g)
        most[at] = np.maximum(most[at], rate)
    filled = np.zeros(len(names))
    for k, name in enumerate(names):
        _, g, rate = languages[name]
        own = g[rate >= LEAST_SHARE * most[np.searchsorted(every, g)]].astype(np.uint64)
        at = np.unique(np.concatenate([(own * np.uint64(m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]))
        slots[k // 64, at] |= np.uint64(1 << k % 64)
        filled[k] = len(at) / (1 << SLOT_BITS)
    return Model(names, slots.astype(np.uint8) if len(names) <= 8 else slots, filled**HASHES)


def train(df: DataFrame, fold: tuple[int, int] | None = (4, 2), per_language: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of a bounded sample: of each language the first ids by a hash, one row to an id; any number of languages.

    Rows whose crc32(id) modulo fold[0] is fold[1], rows without id, language or text, and texts of more than ``max_bytes`` are not
    used.  What comes to the driver is the counts of n-grams per language, made by one task for each.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(F.octet_length("text") <= max_bytes)
    if fold:
        rows = rows.where(crc_mod("doc_id", fold[0]) != fold[1])
    # the ids whose hash is low enough that about twice as many as are wanted stay, so that no task sorts a whole language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    low = join_groups(rows.select("doc_id", "lang"), sizes, ["lang"], "n").where(place <= F.lit(2 * per_language << 20) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    few = low.select("doc_id", "lang").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    few = written(few.select("doc_id", "lang"), "language-sample")
    sample = rows.join(few.hint("merge") if few.count() > 100_000 else F.broadcast(few), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def count(table: pa.Table) -> pa.Table:
        g, rate = counted(texts_of(table.column("text").combine_chunks()))
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": [table.num_rows], "grams": [g.astype("<u4").tobytes()], "rate": [rate.tobytes()]})

    got = sample.groupBy("lang").applyInArrow(count, "lang string, n long, grams binary, rate binary").collect()
    return fit({r.lang: (r.n, np.frombuffer(r.grams, "<u4"), np.frombuffer(r.rate, np.float64)) for r in got})


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every whole text, without a shuffle.

    A null, empty or letterless text is ``und`` with score 0.  Repeated rows and null ids stay; other
    columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # one table of fixed size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [m.predict(t) for t in texts_of(batch.column(1))]
            return pa.record_batch([batch.column(0), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], ["doc_id", "lang_pred", "score"])

        return batches_of(rows, make)

    small = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(df: DataFrame, model: Model, limit: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language that scores at least ``limit``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[pa.Array]:
        got = [shared.value.predict((t or "").encode("utf-8")) for t in texts]
        return [pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())]

    named, (lang, score) = with_columns(df, text_col, ["language", "language_score"], ["string", "double"], make)
    return named.where((F.col(lang) != "und") & (F.col(score) >= limit)).drop(lang, score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
