"""Operator 11: alignment of two tokenizers' ids of one text, by divide and conquer at shared cuts.

Both tokenizations of a text cover the same bytes.  An interval of both begins and ends at a shared cut; a common end
near its middle is found by bisecting one side's ends for the other's, back and forth, and both halves are divided in turn; an
interval without a cut inside is a leaf, a group.  All open intervals of a block of documents take each step together, as arrays.

No text is shuffled.  A task aligns blocks of about BLOCK characters and writes, for each block, the distinct linked id pairs with
their counts and, for each document, places in that list.  The pairs of all blocks are summed over the corpus, and each block
gets back the totals of its own pairs, so what is joined grows with distinct pairs per block, not with links.  Pairs of very
many blocks are joined by a broadcast of few keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm import chunks
from codetables.llm.common import Scratch, by_key, documents, join_groups, parallelism, written

#: Characters of text that one block holds (one document at least).
BLOCK = 1 << 20
_PER_DOC = ["n_a", "n_b", "n_groups", "n_links"]
_STORED = "block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, idx binary, cnt binary"


class ByteEncoder(chunks.ChunkEncoder):
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str, cache: int = chunks.CACHE):
        super().__init__(path, False, cache)
        self.tokenizer.encode_special_tokens, self.added = True, []
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # a letter per byte


class PieceEncoder(chunks.ChunkEncoder):
    """A sentencepiece vocabulary that puts a space before a text.

    Texts are cut as for byte-level vocabularies, where no piece of the vocabulary may cross (else they are encoded whole).  A piece of text
    whose bytes are not those of its ids (its normalisation changes it) has no ids, so its text is shorter than its bytes.
    """

    def __init__(self, path: str, cache: int = chunks.CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        shown = [self.model.id_to_piece(i) for i in range(n)]
        byte = [self.model.is_byte(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(shown, byte, strict=True)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.limit, self.recent, self.before = cache, {}, {}
        plain = [p for p, b in zip(shown, byte, strict=True) if not b]
        self.safe = not any(chunks.re.search(rf"[^▁]▁|\n|[{chunks._L}][{chunks._P}]", p) for p in plain)
        self.added = [c for c in "\t\r" if any(c in p for p in plain)]  # a text that holds one is encoded whole

    def _learn(self, pieces: set[str]) -> None:
        found = list(pieces)
        # the library's own space stands for a piece's first; before others stand a space and a line feed, which join nothing
        asked = [x[1:] if x.startswith(" ") else "\n" + x for x in found]
        for x, ids in zip(found, self.model.encode(asked, num_threads=1), strict=True):
            if x == " ":
                ids = self.model.encode("\n \n", num_threads=1)[2:-1]  # an empty text has no ids
            elif not x.startswith(" "):
                ids = ids[2:]
            same = b"".join(map(self.bytes.__getitem__, ids)) == x.encode()
            self.recent[x] = np.array(ids if same else [], self.dtype).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        """Texts here begin with the space that the library adds."""
        out = []
        for t in texts:
            ids = self.model.encode(t[1:], num_threads=1)
            out.append(np.array(ids if b"".join(map(self.bytes.__getitem__, ids)) == t.encode() else [], self.dtype).tobytes())
        return out

    def can_cut(self, text: str) -> bool:
        """Whether the pieces of a byte-level vocabulary are cut where no piece of this one crosses."""
        return self.safe and not any(x in text for x in self.added)


_ENCODERS: dict = {}


def _encoder(kind: type, path: str):
    """One per Python worker and file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def _meet(x: np.ndarray, y: np.ndarray, at: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices (in x, in y) of the nearest value common to both, from x[at] on to the right or the left.

    Each step bisects one array for the other's value, so stretches of ends without a partner are jumped over.
    """
    i, j = at.copy(), np.empty_like(at)
    open_ = np.arange(len(at))
    step = 0 if side == "left" else -1
    while len(open_):
        v = x[i[open_]]
        k = np.searchsorted(y, v, side) + step
        j[open_] = k
        w = y[k]
        rest = w != v
        open_ = open_[rest]
        i[open_] = np.searchsorted(x, w[rest], side) + step
    return i, j


def shared_cuts(x: np.ndarray, y: np.ndarray, x_docs: np.ndarray, y_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends of all groups, in order; x and y are ends with a leading 0, *_docs the indices of document borders."""
    x0, x1, y0, y1 = x_docs[:-1], x_docs[1:], y_docs[:-1], y_docs[1:]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(x0):
        leaf = (x1 - x0 <= 1) | (y1 - y0 <= 1)
        leaves.append((x1[leaf], y1[leaf]))
        x0, x1, y0, y1 = (v[~leaf] for v in (x0, x1, y0, y1))
        middle = (x0 + x1) >> 1
        i, j = _meet(x, y, middle, "left")  # rightwards; the interval's own end is common at the latest
        none = i >= x1
        if none.any():
            at = np.flatnonzero(none)
            i[at], j[at] = _meet(x, y, middle[at] - 1, "right")  # leftwards; the interval's own begin at the latest
        cut = i > x0
        leaves.append((x1[none], y1[none]))  # without a cut in the right half, what lies right of the cut is a leaf, or all of it
        right = cut & ~none
        x0, y0, x1, y1 = (np.concatenate(v) for v in ((x0[cut], i[right]), (y0[cut], j[right]), (i[cut], x1[right]), (j[cut], y1[right])))
    return tuple(np.sort(np.concatenate([v[k] for v in leaves])) if leaves else np.empty(0, np.int64) for k in (0, 1))


def linked(x: np.ndarray, y: np.ndarray, y_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of x, tokens of y) whose bytes overlap: one link per end inside a group and one for its end."""
    inner = np.ones(len(y) - 1, bool)
    inner[y_cuts - 1] = False  # the end of a group is an end of both, counted with x
    inner = np.flatnonzero(inner)
    own = np.arange(len(x) - 1)
    return np.concatenate([own, np.searchsorted(x, y[inner + 1], "left") - 1]), np.concatenate([np.searchsorted(y, x[1:], "left") - 1, inner])


def _written_groups(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, digits: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text of all groups as bytes, its length after each group): ``a1,a2|b1;``."""
    table, n = digits
    a_sizes, b_sizes = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    places_a = np.arange(len(a)) + np.repeat(b_cuts - b_sizes, a_sizes)
    places_b = np.arange(len(b)) + np.repeat(a_cuts, b_sizes)
    rows = np.empty(len(a) + len(b), np.int64)
    rows[places_a], rows[places_b] = a, b
    rows[places_a[a_cuts - 1]] += n  # the last id of a side has another sign behind it
    rows[places_b[b_cuts - 1]] += 2 * n
    shown = table[rows]
    used = shown != 0
    return shown[used], np.cumsum(used.sum(1))[a_cuts + b_cuts - 1]


def _digits(n: int) -> tuple[np.ndarray, int]:
    """Rows of digits and a sign: id, id + n and id + 2n for the signs , | and ; with zero bytes for none."""
    width = len(str(n))
    table = np.zeros((3 * n, width + 1), np.uint8)
    ids = np.arange(n)
    for k in range(width):
        digit = (ids // 10**k % 10 + ord("0")).astype(np.uint8)
        digit[(ids < 10**k) & (k > 0)] = 0
        table[:, width - 1 - k] = np.tile(digit, 3)
    table[:, width] = np.repeat(np.frombuffer(b",|;", np.uint8), n)
    return table, n


def _per_doc(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of values between borders."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[borders])


def align_block(texts: list[str], enc_a: ByteEncoder, enc_b: PieceEncoder, digits, keep_groups: bool) -> dict:
    """Per text n_a, n_b, n_groups, n_links, groups (text or digest), places in ``pairs`` and counts there; the block's pairs and counts."""
    full = [f" {t}" if t else "" for t in texts]
    cut = [enc_a._cut(t) for t in full]
    got_a, got_b = enc_a.encode_cut(full, cut), enc_b.encode_cut(full, [c if c is not None and enc_b.can_cut(t) else None for t, c in zip(full, cut, strict=True)])
    size = np.array([len(t.encode()) for t in full], np.int64)
    ids = []
    for got, enc in ((got_a, enc_a), (got_b, enc_b)):
        n = np.array([len(x) // enc.dtype.itemsize for x in got], np.int64)
        flat = np.frombuffer(b"".join(got), enc.dtype).astype(np.int64)
        ids.append((flat, n, _per_doc(enc.lengths[flat], np.concatenate([[0], np.cumsum(n)])) == size))
    good = ids[0][2] & ids[1][2]
    (a, n_a, _), (b, n_b, _) = ((f[np.repeat(good, n)], np.where(good, n, 0), 0) for f, n, _ in ids)
    docs_a, docs_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    x, y = (np.concatenate([[0], np.cumsum(e.lengths[v])]) for e, v in ((enc_a, a), (enc_b, b)))
    some = n_a > 0
    cuts_a, cuts_b = shared_cuts(x, y, np.concatenate([[0], docs_a[1:][some]]), np.concatenate([[0], docs_b[1:][some]]))
    group_borders = np.searchsorted(cuts_a, docs_a, "right")
    la, lb = linked(x, y, cuts_b)
    key = a[la] << 32 | b[lb]
    pairs, place = np.unique(key, return_inverse=True)
    doc = np.searchsorted(docs_a, la, "right") - 1
    both, times = np.unique(doc * max(len(pairs), 1) + place, return_counts=True)
    of, place = np.divmod(both, max(len(pairs), 1))
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    shown, lengths = _written_groups(a, b, cuts_a, cuts_b, digits)
    till = np.concatenate([[0], lengths])[group_borders].tolist()
    raw = shown.tobytes()
    groups = ["" if j == i else raw[i : j - 1].decode() if keep_groups else hashlib.sha256(raw[i : j - 1]).hexdigest() for i, j in zip(till, till[1:], strict=False)]
    place, times, ends = place.astype("<u4"), times.astype("<u4"), ends.tolist()
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(group_borders), "n_links": np.bincount(doc, minlength=len(texts)), "groups": groups,
        "idx": [place[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], "cnt": [times[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)],
        "pairs": pairs.astype("<i8").tobytes(), "counts": np.bincount(place, times, minlength=len(pairs)).astype("<i8").tobytes(),
    }


def align(df: DataFrame, byte_vocab: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Blocks of aligned documents (kind 1) and of their distinct pairs (kind 0), as ``scores`` and ``pair_counts`` read them.

    groups is the text ``a1,a2|b1;a3|b2,b3`` with ``keep_groups``, else its SHA-256 in hex.  A text that is null, empty, or not the bytes of either
    side's ids has no tokens: zeros and ''.  Null and repeated ids and equal rows each keep a row; a text of any length is one block at
    most; other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc_a, enc_b = _encoder(ByteEncoder, byte_vocab), _encoder(PieceEncoder, piece_model)
        digits = _digits(max(len(enc_a.lengths), len(enc_b.lengths)))
        n = 0
        for batch in batches:
            ids, texts, at = batch.column(1), batch.column(2).to_pylist(), 0
            for part in chunks.groups(texts, len, BLOCK):
                block = (batch.column(0)[0].as_py() << 32) + n
                got = align_block(part, enc_a, enc_b, digits, keep_groups)
                m = len(part)
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([
                    pa.array([block] * (m + 1)), pa.array([0] + [1] * m, pa.int32()), pa.concat_arrays([none, ids.slice(at, m)]),
                    *(pa.concat_arrays([none, pa.array(got[k], pa.int64())]) for k in _PER_DOC), pa.array([None, *got["groups"]], pa.string()),
                    pa.array([got["pairs"], *got["idx"]], pa.binary()), pa.array([got["counts"], *got["cnt"]], pa.binary()),
                ], ["block", "kind", "doc_id", *_PER_DOC, "groups", "idx", "cnt"])
                n, at = n + 1, at + m

    return rows.mapInArrow(run, _STORED)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """block, pos, pair, n: the distinct pairs (a << 32 | b) of each block in the order of the documents' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, c = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                yield pa.record_batch([pa.array(np.full(len(p), block)), pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p), pa.array(c)], ["block", "pos", "pair", "n"])

    return aligned.where("kind = 0").select("block", "idx", "cnt").mapInArrow(run, "block long, pos int, pair long, n long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, total (links of the whole corpus), n_blocks, best: whether no pair of the same b has more."""
    totals = block_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_blocks"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))  # at most one row per id of a
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def scores(aligned: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups per document of a written ``align``."""
    spark = aligned.sparkSession
    totals = scratch.written(pair_counts(aligned), "align-pairs")
    known = join_groups(block_pairs(aligned).select("block", "pos", "pair"), totals, ["pair"], "n_blocks").select("block", "pos", "total", "best")
    docs = aligned.where("kind = 1").select("block", F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "doc_id", *_PER_DOC, "groups", "idx", "cnt")
    both = docs.unionByName(known, allowMissingColumns=True).repartition(parallelism(spark), "block").sortWithinPartitions("block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            pos = rows["pos"].to_numpy()
            of_docs = int(np.searchsorted(pos, 0))
            docs = rows.slice(0, of_docs).combine_chunks()
            total, best = (rows[k].slice(of_docs).to_numpy() for k in ("total", "best"))
            idx, cnt = (docs[k].to_pylist() for k in ("idx", "cnt"))
            borders = np.concatenate([[0], np.cumsum([len(x) // 4 for x in idx])]).astype(np.int64)
            place, times = (np.frombuffer(b"".join(v), "<u4").astype(np.int64) for v in (idx, cnt))
            sums = [_per_doc(times * v.astype(np.int64)[place], borders) if len(place) else np.zeros(of_docs, np.int64) for v in (best, total)]
            columns = [docs[k].combine_chunks() if isinstance(docs[k], pa.ChunkedArray) else docs[k] for k in ("doc_id", *_PER_DOC, "groups")]
            yield pa.RecordBatch.from_arrays([*columns[:5], *(pa.array(s, pa.int64()) for s in sums), columns[5]], ["doc_id", *_PER_DOC, "n_best", "count_sum", "groups"])

    return both.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark)
    aligned = scratch.written(align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    out = written(scores(aligned, scratch), "align-scores").withColumnRenamed("groups", "groups_sha256")
    scratch.clear()
    return out
