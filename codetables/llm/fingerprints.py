"""Operator 13: document fingerprints by locally consistent parsing.

Level 0 of a text is its code points.  Each level names runs of equal symbols, then cuts the sequence where labels, won from neighbours by
deterministic coin tossing, have a local maximum, and names each block by a hash of its symbols; these names are the next level's symbols.
A name is the same for the same content everywhere, so no dictionary is kept; a cut depends on a few symbols around it only, so
equal substrings have equal phrases inside, wherever they stand.  All texts of a block are parsed together, as arrays.

A fingerprint is a sketch of the bag of names from level LOW on (of the top level, for texts that don't reach it): SLOTS slots, in each a byte
of the least name that falls there, an empty slot borrowing from the next filled one.  The likeness of two fingerprints estimates
the Jaccard similarity of the two bags.

For its following text, each document needs the next one in the order of ids: documents are range-partitioned once and streamed in order; a range's
last document, with the first of the next range, is written and treated after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm import chunks
from codetables.llm.common import documents, parallelism, written

#: First level whose names count; slots of a fingerprint; code points that are parsed together (one text at least).
LOW, SLOTS, BLOCK = 1, 128, 1 << 18
#: From this level on a name counts as often as it occurs in a text, so that repeated lines keep their weight.
COUNTED = 2
#: Rounds of coin tossing after the first: 64-bit names to labels below 128, then below 14 and 8.
ROUNDS = 2
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)  # fixed values of a 64-bit finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def _toss_table() -> np.ndarray:
    """Label of a symbol b after a symbol a, both below 128: twice the lowest bit in which they differ, and b's bit there."""
    a, b = np.divmod(np.arange(1 << 14), 128)
    low = np.bitwise_count(((a ^ b) & -(a ^ b)) - 1)
    return np.where(a == b, 0, 2 * low + (b >> low & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels of symbols that differ from their neighbours, so that neighbours' labels differ too; ``first`` are the beginnings of texts."""
    differ = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
    differ[first] = 1  # as if the lowest bit differed: the label is that bit
    differ &= -differ
    label = np.bitwise_count(differ - np.uint64(1))
    label <<= 1
    label |= (x & differ) != 0
    pair = np.empty(len(x), np.uint16)
    for _ in range(ROUNDS):
        np.left_shift(label[:-1], 7, out=pair[1:], dtype=np.uint16)
        pair[1:] |= label[1:]
        pair[first] = (label[first] & 1 ^ 1).astype(np.uint16) << 7 | (label[first] & 1)
        label = _TOSS[pair]
    return label


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


_BASE = int(_STEP)
_POWER: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _names(x: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Names of the blocks that begin at ``at``: a polynomial of the symbols, from differences of one running sum; a block of one symbol keeps its name."""
    if len(_POWER[0]) < len(x):
        size = 1 << len(x).bit_length()
        _POWER[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    sums = np.cumsum(x * _POWER[0][: len(x)])
    ends = np.append(at[1:], len(x))
    n = ends - at
    value = (sums[ends - 1] - sums[at] + x[at] * _POWER[0][at]) * _POWER[1][at]
    names = mix(value + (n + (level << 32)).astype(np.uint64) * _M2)
    alone = np.flatnonzero(n == 1)
    names[alone] = x[at[alone]]
    return names


def levels(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, names, their first code points, borders of the texts among them) from level 1 up to where each text is one phrase.

    A text that is one phrase stays as it is in further levels.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, start, level = mix(points.astype(np.uint64) + np.uint64(1)), np.arange(len(points)), 0
    while len(x):
        level += 1
        cut = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=cut[1:])
        cut[borders[:-1][borders[:-1] < borders[1:]]] = True
        at = np.flatnonzero(cut)
        if len(at) < len(x):  # runs of equal symbols
            n = np.append(at[1:], len(x)) - at
            x, start, borders = x[at], start[at], np.searchsorted(at, borders)
            run = np.flatnonzero(n > 1)
            x[run] = mix(x[run] + n[run].astype(np.uint64) * _STEP)
        some = borders[:-1] < borders[1:]
        first, last = borders[:-1][some], borders[1:][some] - 1
        label = _labels(x, first)
        cut = np.zeros(len(x), bool)
        rises = label[1:] > label[:-1]
        cut[1:-1] = rises[:-1] & ~rises[1:]  # a local maximum begins a block
        cut[last] = False
        cut[np.minimum(first + 1, last)] = False  # every block but a text's only one has two symbols at least
        cut[first] = True
        at = np.flatnonzero(cut)
        x, start, borders = _names(x, at, level), start[at], np.searchsorted(at, borders)
        yield level, x, start, borders
        if np.diff(borders).max() <= 1:
            return


def _occurrence(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many equal names of the same text are counted before each."""
    key = mix(name ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ordered = key[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.empty(0, np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(begin, np.diff(begin, append=len(key)))
    return out


def sketches(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts as rows of SLOTS bytes; a text without any code point has zeros."""
    k = len(texts)
    least = np.full(k * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    done = np.zeros(k, bool)
    for level, x, _, borders in levels(texts):
        n = np.diff(borders)
        of = np.repeat(np.arange(k), n)
        use = np.ones(k, bool) if level >= LOW else n == 1  # a text that is one phrase before LOW has that one
        use &= ~done
        done |= n == 1  # one phrase: counted now, and the same in all further levels
        pick = use[of]
        name, doc = x[pick], of[pick]
        if level >= COUNTED:
            name = name + _occurrence(name, doc).astype(np.uint64) * _M2
        name = mix(name ^ _STEP)
        np.minimum.at(least, doc * SLOTS + (name >> np.uint64(57)).astype(np.int64) % SLOTS, name << np.uint64(7))
    least = least.reshape(k, SLOTS)
    filled = least != np.iinfo(np.uint64).max
    out = (mix(least) & np.uint64(255)).astype(np.uint8)
    some = np.flatnonzero(filled.any(1) & ~filled.all(1))
    if len(some):  # the next filled slot, and how far it is
        ahead = np.concatenate([filled[some], filled[some]], 1)
        at = np.where(ahead, np.arange(2 * SLOTS), 4 * SLOTS)
        at = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :SLOTS]
        lent = np.take_along_axis(least[some], at % SLOTS, 1) + (at - np.arange(SLOTS)).astype(np.uint64) * _STEP
        out[some] = np.where(filled[some], out[some], (mix(lent) & np.uint64(255)).astype(np.uint8))
    out[~filled.any(1)] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 per pair of rows: the share of equal slots, less what chance makes equal."""
    by_chance = 1 / 256
    return np.clip(((a == b).mean(1) - by_chance) / (1 - by_chance), 0.0, 1.0)


def fingerprint_of(text: str) -> str:
    return sketches([text])[0].tobytes().hex()


def edited(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its last quarter (rounded down) replaced by as many code points from the beginning of the following text, or all of them."""
    return [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]


def _compared(ids: pa.Array, texts: list[str], following: list[str], next_marks: np.ndarray | None, marks: np.ndarray | None) -> list[pa.Array]:
    changed = edited(texts, following)
    marks = sketches(texts) if marks is None else marks
    next_marks = sketches(following) if next_marks is None else next_marks
    changed_marks = np.concatenate([sketches(g) for g in chunks.groups(changed, len, BLOCK)])
    return [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([m.tobytes().hex() for m in marks]),
        pa.array([m.tobytes().hex() for m in changed_marks]), pa.array(likeness(marks, changed_marks)), pa.array(likeness(marks, next_marks)),
    ]


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_OUT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: documents with the one after them; of each range also its first text (kind 1) and its last document (kind 2), to be joined."""

    def emit(columns: list[pa.Array], kind: int, text: str | None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.record_batch([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), *columns, pa.array([text] * n, pa.string())], ["kind", "part", *_OUT, "text"])

    held, part = None, None  # one document waits for the next
    for batch in batches:
        texts, at = batch.column(2).to_pylist(), 0
        for group in chunks.groups(texts, len, BLOCK):
            ids, marks = batch.column(1).slice(at, len(group)), sketches(group)
            at += len(group)
            if held is None:
                part = batch.column(0)[0].as_py()
                yield emit([ids.slice(0, 1), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], 1, group[0])
            else:
                ids, group, marks = pa.concat_arrays([held[0], ids]), [held[1], *group], np.concatenate([held[2], marks])
            if len(group) > 1:
                yield emit(_compared(ids.slice(0, len(group) - 1), group[:-1], group[1:], marks[1:], marks[:-1]), 0, None)
            held = ids.slice(len(group) - 1, 1), group[-1], marks[-1:]
    if held is not None:
        yield emit([held[0], *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], 2, held[1])


def _last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, text, following = batch.column(0).slice(k, 1), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            yield pa.record_batch(_compared(ids, [text], [following], None, None), _OUT)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document.

    The next document is that of the next id, after the last the first; null ids come first, equal ids are ordered by a hash of the text and
    then the text, so repeated rows are neighbours.  A null text is empty; an empty text has the fingerprint of zeros, equal only to
    another empty one.  Texts of any length are parsed whole; other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parallelism(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    found = written(ordered.mapInArrow(_range_rows, f"kind int, part int, {_OUT_SCHEMA}, text string"), "fingerprints")
    in_order = Window.orderBy("part")  # one row per range
    firsts = found.where("kind = 1").select("part", F.col("text").alias("following"))
    lasts = found.where("kind = 2").select("part", "doc_id", "text")
    after = firsts.select("part").withColumns({"next": F.lead("part").over(in_order), "first": F.min("part").over(Window.partitionBy())}).select("part", F.coalesce("next", "first").alias("next"))
    pairs = lasts.join(F.broadcast(after), "part").join(firsts.withColumnRenamed("part", "next").hint("merge"), "next").select("doc_id", "text", "following")
    return found.where("kind = 0").select(*_OUT).unionByName(pairs.mapInArrow(_last_rows, _OUT_SCHEMA))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in chunks.groups(batch.column(1).to_pylist(), len, BLOCK):
                yield pa.record_batch([batch.column(0).slice(at, len(group)), pa.array([len(t) for t in group], pa.int64()), pa.array([m.tobytes().hex() for m in sketches(group)])], ["doc_id", "n_chars", "fingerprint"])
                at += len(group)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def phrases(df: DataFrame, low: int = LOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, level, start, length (code points), name of every phrase from level ``low`` on: equal names are equal substrings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in chunks.groups(batch.column(1).to_pylist(), len, BLOCK):
                ids = batch.column(0).slice(at, len(group))
                at += len(group)
                before = np.cumsum([0, *(len(t) for t in group)])
                for level, x, start, borders in levels(group):
                    if level >= low:
                        of = np.repeat(np.arange(len(group)), np.diff(borders))
                        length = np.append(start[1:], before[-1]) - start
                        yield pa.record_batch([ids.take(pa.array(of)), pa.array(np.full(len(x), level, np.int32)), pa.array(start - before[of]), pa.array(length), pa.array(x.view(np.int64))], ["doc_id", "level", "start", "length", "name"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, level int, start long, length long, name long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
