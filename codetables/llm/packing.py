"""Operator 2: pack documents into sequences along a Hilbert curve through hashed document vectors.

A document's ids are counted into hash buckets, weighted by 1 + log(count) and brought to unit length; fixed random
directions project this vector to a few dimensions.  Each dimension is centred on the mean of all documents and scaled to their
spread, so that the documents fill the grid whose cells have a Hilbert index.  Documents
are range-sorted by that index (then by a hash and by id, so that copies and ties spread over partitions),
and follow each other along the curve as one stream of ids.  A piece's place is the prefix sum of all
tokens before it: totals per partition give the bases.  Sequences are consecutive runs of ``length`` ids,
so only the very last one is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm import chunks
from codetables.llm.common import batches_of, documents, parallelism, prefix_bases, written

DIMS, BITS, BUCKETS, SEED = 3, 10, 256, 20240601
#: Standard deviations from the mean to the end of the grid; what lies beyond is in its outermost cells.
REACH = 3.0


def directions(dims: int = DIMS, buckets: int = BUCKETS, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns: fixed random directions in the space of hash buckets."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, dims)))[0]


def bucket_table(vocabulary: int, buckets: int = BUCKETS) -> np.ndarray:
    """Hash bucket of each token id."""
    x = np.arange(vocabulary, dtype=np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(buckets)).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of integer coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[dims - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(ids: list[np.ndarray], table: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """A row of coordinates per document; a document without ids lies in the origin."""
    vectors = np.zeros((len(ids), len(axes)))
    for row, x in zip(vectors, ids, strict=True):
        row += np.log1p(np.bincount(table[x], minlength=len(axes)))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm == 0, 1, norm)) @ axes


def curve_keys(at: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each row of coordinates, on a grid that reaches REACH spreads from the mean."""
    off = (at - mean) / np.where(spread > 0, spread, 1)
    return hilbert(np.clip((off / REACH + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def pack(df: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids BINARY (little-endian, 16 or 32 bits).

    Each document is encoded whole (null as empty), followed by ``end_id``, and cut only where a sequence
    is full.  Null and repeated ids, repeated rows and ties each keep their own pieces; an empty table gives
    no pieces; columns other than the two are ignored.
    """
    return _pieces(df, tokenizer, end_id, length, id_col, text_col, drops_space, pa.binary(), lambda ids, _: ids)


def _pieces(df: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str, text_col: str, drops_space: bool, kind: pa.DataType, value: Callable[[bytes, int], object]) -> DataFrame:
    """The pieces, with ``value`` of a piece's ids and the bytes of an id in the last column."""
    spark = df.sparkSession
    spots = [f"p{k}" for k in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunks.encoder(tokenizer, drops_space)
        axes, table, end = directions(), bucket_table(enc.tokenizer.get_vocab_size()), np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            at = 0
            for texts in chunks.groups([t or "" for t in batch.column(1).to_pylist()], len, 1 << 20):
                got = enc.encode(texts)
                places = projections([np.frombuffer(x, enc.dtype) for x in got], table, axes)
                tie = [zlib.crc32(x) for x in got]
                yield pa.record_batch([batch.column(0).slice(at, len(got)), *(pa.array(c) for c in places.T.copy()), pa.array(tie, pa.int64()), pa.array([len(x) // enc.dtype.itemsize + 1 for x in got], pa.int64()), pa.array([x + end for x in got], pa.binary())], ["doc_id", *spots, "tie", "doc_tokens", "ids"])
                at += len(got)

    small = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = small.mapInArrow(run, f"doc_id long, {', '.join(f'{p} double' for p in spots)}, tie long, doc_tokens long, ids binary").withColumn("row", F.monotonically_increasing_id())
    encoded = written(encoded, "encoded")  # fixes the row numbers

    facts = encoded.agg(*(F.avg(p) for p in spots), *(F.stddev_pop(p) for p in spots)).first()
    mean, spread = (np.array([x or 0.0 for x in part]) for part in (facts[:DIMS], facts[DIMS:]))

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(batches, lambda b: pa.record_batch([pa.array(curve_keys(np.stack([c.to_numpy() for c in b.columns[:DIMS]], 1), mean, spread)), *b.columns[DIMS:]], [*order, "doc_tokens"]), 1 << 16)

    order = ["curve", "tie", "doc_id", "row"]
    keyed = encoded.select(*spots, *order[1:], "doc_tokens").mapInArrow(curve, "curve long, tie long, doc_id long, row long, doc_tokens long")
    ranged = keyed.repartitionByRange(parallelism(spark), *order)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "curve-order")
    bases = prefix_bases(ranged, "part", {"base": F.col("doc_tokens")})
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("doc_tokens").over(along), F.lit(0))).join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("inside")).alias("position"))

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks.groups(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), lambda r: len(r[2]), 4 << 20):
                out: list[tuple] = []
                for doc, n, ids, position in rows:
                    width, at = len(ids) // n, 0
                    while at < n:
                        sequence, offset = divmod(position + at, length)
                        take = min(length - offset, n - at)
                        out.append((doc, at, take, n, sequence, offset, value(ids[at * width : (at + take) * width], width)))
                        at += take
                yield pa.record_batch([pa.array(c, kind if k == 6 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    both = encoded.select("row", "doc_id", "doc_tokens", "ids").join(placed.hint("shuffle_hash"), "row").select("doc_id", "doc_tokens", "ids", "position")
    return both.mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids {'binary' if kind == pa.binary() else 'long'}")


def _crc(ids: bytes, width: int) -> int:
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    """The production parameters, sequences of 4096 ids and end id 2, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    # the digest is made where the pieces are cut, so that their ids don't pass to Python once more
    pieces = _pieces(docs, path, 2, 4096, "doc_id", "text", True, pa.int64(), _crc)
    return pieces.select("doc_id", "start", "length", F.col("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
