"""Operator 3: exact Jaccard join of word n-gram sets as a metric-space join.

The distance of two sets is 1 - |x & y| / |x | y|, a metric; documents link when it is at most eps = 1 - num / den.

Pivots.  A sampled pivot can't divide a text corpus: nearly all documents share nothing with it, so nearly all distances
are 1 and no triangle inequality excludes anybody.  So documents elect their pivots.  All documents order their n-grams
by how many documents hold them, rarest first; the first |x| - ceil(t * |x|) + 1 of a set are its prefix, and of two sets that
link, the prefixes share an n-gram.  Each n-gram that several prefixes hold elects the smallest of their documents as a pivot:
a document at a distance below 1 from all others that elected it.  A pivot's region holds the documents that elected it.
A document whose rare n-grams outnumber its prefix elects nobody and leaves here; most do.  Two documents that link have a pivot in common.

Regions.  A region small enough for one task is joined exactly there: one product of its incidence matrix gives all intersections.
A larger one is divided recursively.  Some of its members become pivots; a member goes to the Voronoi cell of its
nearest pivot and, by the triangle inequality, to every other cell whose pivot is at most 2 * eps farther, so linked members
share a cell.  All distances that this computes are exact, and those within eps are links.  A region that pivots can't divide
(its cells would hold most members several times) is compared in blocks of pairs, a task at a time holding two blocks.

Only components are asked for, so a region whose members are one component already is done, and members of one component
are not compared in blocks.  Documents of equal sets are one node.  The result is exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm import chunks
from codetables.llm.common import Scratch, by_key, documents, join_groups, parallelism, texts_of, written
from codetables.llm.components import components

#: Members, and n-grams of all members together, that one task joins at once; words whose hashes a worker remembers.
BLOCK, WEIGHT, WORDS = 512, 4_000_000, 400_000
#: Pivots by which a large region is divided, rounds of that, and copies of a member that cells may hold on average.
PIVOTS, ROUNDS, COPIES = 8, 2, 2.0
#: Bits at most of the filter by which texts are chosen to be read again: 4 MB are broadcast.
FILTER_BITS = 1 << 25

_U = np.uint64
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of all words where they are fewer."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_WORDS) > WORDS:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = _mix(out + h[k : k + m])
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Number below ``parts`` from the upper half of 64-bit hashes."""
    return ((h.view(np.uint64) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _packed(part: np.ndarray, node: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) per part: the nodes in order, in one byte how many entries each has (a node with more than 255 comes again), and the columns of the entries."""
    if not len(part):
        return
    order = np.lexsort((node, part))
    part, node, columns = part[order], node[order], [c[order] for c in columns]
    new = np.append(True, (part[1:] != part[:-1]) | (node[1:] != node[:-1]))
    begin = np.flatnonzero(new)
    place = np.arange(len(part)) - np.repeat(begin, np.diff(begin, append=len(part)))
    new |= place % 255 == 0
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for b, e in zip(cuts, cuts[1:], strict=False):
        first = np.flatnonzero(new[b:e])
        times = np.diff(np.append(first, e - b)).astype(np.uint8)
        yield int(part[b]), b"".join((np.array([len(first)], "<u4").tobytes(), node[b:e][first].astype("<i8").tobytes(), times.tobytes(), *(c[b:e].tobytes() for c in columns)))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The nodes of the entries and their columns."""
    (n,) = np.frombuffer(data, "<u4", 1)
    times = np.frombuffer(data, np.uint8, n, 4 + 8 * n)
    out, at, total = [np.repeat(np.frombuffer(data, "<i8", n, 4), times)], 4 + 9 * n, int(times.sum())
    for kind in kinds:
        out.append(np.frombuffer(data, kind, total, at))
        at += total * np.dtype(kind).itemsize
    return out


DOCS = [("doc_id", pa.int64()), ("raw", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("n_keys", pa.int64())]
KEYED = pa.schema([("part", pa.int64()), *DOCS, ("cells", pa.binary())])
KEYED_DDL = "part long, doc_id long, raw long, node long, n_shingles long, n_keys long, cells binary"


def _batch(size: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in KEYED], schema=KEYED)


def _cells(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """One pass over the texts: a row per document, and per part of the n-grams' hashes a row that packs the n-grams of many documents."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = 0
            for texts in chunks.groups(texts_of(batch.column(2)), len, 8 << 20):
                nodes, sizes, sets = [], [], []
                for text in texts:
                    s = shingle_set(text, n)
                    sizes.append(len(s))
                    nodes.append(node_of(s) if len(s) else None)
                    if len(s):
                        sets.append(s)
                keys = [np.unique((s >> _U(32)) * _U(parts) >> _U(32) << _U(32) | s & _U(0xFFFFFFFF)) for s in sets]
                n_keys = iter(map(len, keys))
                node = pa.array(nodes, pa.int64())
                spread = pa.array(_part(_mix(np.array([x or 0 for x in nodes], np.int64).view(np.uint64)), parts))
                yield _batch(len(texts), part=spread, doc_id=batch.column(0).slice(at, len(texts)), raw=batch.column(1).slice(at, len(texts)), node=node, n_shingles=pa.array(sizes, pa.int64()), n_keys=pa.array([next(n_keys) if x is not None else 0 for x in nodes], pa.int64()))
                at += len(texts)
                if keys:
                    held = np.repeat(np.array([x for x in nodes if x is not None], np.int64), [len(k) for k in keys])
                    flat = np.concatenate(keys)
                    cells = list(_packed((flat >> _U(32)).astype(np.int64), held, (flat & _U(0xFFFFFFFF)).astype("<u4")))
                    yield _batch(len(cells), part=pa.array([p for p, _ in cells], pa.int64()), cells=pa.array([c for _, c in cells], pa.binary()))

    return docs.mapInArrow(run, KEYED_DDL)


def _shared(cells: DataFrame, parts: int) -> DataFrame:
    """The documents' rows, and per part of the nodes' hashes rows that pack n-grams which several nodes hold, with a class of how many do."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in by_key(rows):
            docs = table.filter(pa.compute.is_null(table.column("cells"))).combine_chunks()
            for b in docs.to_batches():
                target = _part(b.column(3).fill_null(0).to_numpy(), parts)
                yield pa.record_batch([pa.array(target), *b.columns[1:]], schema=KEYED)
            blobs = [c for c in table.column("cells").to_pylist() if c is not None]
            del table, docs
            for low, high in _ranges(sum(map(len, blobs))):
                node, key = [], []
                for c in blobs:
                    a, b = _unpacked(c, "<u4")
                    if high - low < 1 << 32:
                        inside = (b >= low) & (b < high)
                        a, b = a[inside], b[inside]
                    node.append(a)
                    key.append(b)
                node, key = np.concatenate(node) if node else np.zeros(0, np.int64), np.concatenate(key) if key else np.zeros(0, np.uint32)
                order = np.argsort(key, kind="stable")
                node, key = node[order], key[order]
                same = np.append(key[1:] == key[:-1], False)
                again = same | np.append(False, same[:-1])
                node, key = node[again], key[again]
                if not len(key):
                    continue
                order = np.lexsort((node, key))
                node, key = node[order], key[order]
                new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
                node, key = node[new], key[new]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                often = np.diff(np.append(first, len(key)))
                # eight classes to a doubling: the order needs a number that is the same for all holders, not the exact count
                kind = np.repeat(np.minimum(255, 8 * np.log2(often)).astype(np.uint8), often)
                many = np.repeat(often > 1, often)
                node, key, kind = node[many], key[many], kind[many]
                if len(node):
                    found = list(_packed(_part(node, parts), node, np.full(len(node), part, "<u4"), key.astype("<u4"), kind))
                    yield _batch(len(found), part=pa.array([p for p, _ in found], pa.int64()), cells=pa.array([c for _, c in found], pa.binary()))

    return cells.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, KEYED_DDL)


def _ranges(size: int, most: int = 48 << 20) -> list[tuple[int, int]]:
    """Ranges of 32-bit keys that hold at most about ``most`` of ``size`` bytes each."""
    n = -(-size // most)
    ends = [(1 << 32) * i // max(1, n) for i in range(n + 1)]
    return list(zip(ends, ends[1:], strict=False))


def prefix(size, num: int, den: int):
    """Length of the prefix of a set: two sets that link share an element of their prefixes, in any order that both follow."""
    return size - -(-num * size // den) + 1


def _votes(shared: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """gram, node, n_shingles: the n-grams of each node's prefix that other nodes hold as well."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(rows):
            blobs = [_unpacked(c, "<u4", "<u4", "u1") for c in table.column("cells").to_pylist() if c is not None]
            docs = table.filter(pa.compute.is_valid(table.column("node")))
            if not blobs or not docs.num_rows:
                continue
            node, at = np.unique(docs.column("node").to_numpy(), return_index=True)
            size, keys = (docs.column(k).to_numpy()[at] for k in ("n_shingles", "n_keys"))
            of, part, key, kind = (np.concatenate(c) for c in zip(*blobs, strict=True))
            where = np.searchsorted(node, of)
            # n-grams that no other node holds come first in the order
            room = (prefix(size, num, den) - (keys - np.bincount(where, minlength=len(node))))[where]
            inside = room > 0
            where, part, key, kind, room = where[inside], part[inside], key[inside], kind[inside], room[inside]
            order = np.lexsort((key, part, kind, where))
            where, part, key, room = where[order], part[order], key[order], room[order]
            first = np.append(True, where[1:] != where[:-1])
            rank = np.arange(len(where)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(where) else where
            chosen = rank < room
            where, gram = where[chosen], (part[chosen].astype(np.int64) << 32) | key[chosen].astype(np.int64)
            for i in range(0, len(gram), 100_000):
                yield pa.record_batch([pa.array(x) for x in (gram[i : i + 100_000], node[where[i : i + 100_000]], size[where[i : i + 100_000]])], ["gram", "node", "n_shingles"])

    dealt = shared.select("part", "node", "n_shingles", "n_keys", "cells").where("node IS NOT NULL OR cells IS NOT NULL")
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "gram long, node long, n_shingles long")


def _sized(regions: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """region, node, n_shingles with members and weight: the number of members and of their n-grams; regions of one member go."""
    regions = scratch.written(regions.distinct(), name)
    sizes = scratch.written(regions.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight")).where("members > 1"), f"{name}-sizes")
    return scratch.written(join_groups(regions, sizes, ["region"], "members"), f"{name}-sized")


def _filter(wanted: DataFrame, bits: int) -> np.ndarray:
    """64-bit words in which the bit of each wanted doc_id is set; of a fixed number at most, as are the rows that come to the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}L) & 63L AS int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy()
    return out


def _sets(docs: DataFrame, rows: DataFrame, members: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """node, elements BINARY of the members, made again from the text of one document each; dealt by node, so a join by node shuffles no set again.

    Texts are chosen by a filter of bounded size, without a shuffle: it may let more pass, which the callers' joins leave out.
    """
    needed = scratch.written(members.select("node").distinct(), "needed")
    wanted = scratch.written(rows.join(needed.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "wanted")
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    words = docs.sparkSession.sparkContext.broadcast(_filter(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            chosen = (words.value[at >> 6] >> (at & 63)) & 1 == 1
            found = batch.column(1).filter(pa.array(chosen))
            for texts in chunks.groups(texts_of(found), len, 8 << 20):
                got = [s for s in (shingle_set(t, n) for t in texts) if len(s)]
                yield pa.record_batch([pa.array([node_of(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["node", "elements"])

    # an id of several rows brings all their sets
    found = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"), "text").mapInArrow(run, "node long, elements binary")
    return found.dropDuplicates(["node"])


def _intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, or of all with each other."""
    sets = left if right is None else left + right
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets), kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        return np.array([[shared]]) if right is not None else np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    column = np.cumsum(several) - 1
    keep = several[at]
    of, at = of[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    split = len(left)
    out = np.zeros((split, split if right is None else len(right)))
    width = max(1, (1 << 21) // len(sets))
    for low in range(0, int(several.sum()), width):
        b, e = np.searchsorted(at, (low, low + width))
        hit = np.zeros((len(sets), width), np.float32)
        hit[of[b:e], at[b:e] - low] = 1
        out += hit[:split] @ (hit if right is None else hit[split:]).T
    out = out.astype(np.int64)
    if right is None:  # elements that only one member has
        out[np.arange(split), np.arange(split)] = [len(s) for s in left]
    return out


def _elements(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _lengths(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([len(s) for s in sets], np.int64)


def _star(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links of each node that has one to the smallest node of its component here, which says as much as all links do."""
    big = np.iinfo(np.int64).max
    ll, lr = left.copy(), right.copy()
    while True:
        nr = np.minimum(lr, np.where(linked, ll[:, None], big).min(0, initial=big))
        nl = np.minimum(ll, np.where(linked, nr, big).min(1, initial=big))
        if (nr == lr).all() and (nl == ll).all():
            break
        ll, lr = nl, nr
    a, b = np.concatenate((ll, lr)), np.concatenate((left, right))
    real = a != b
    return a[real], b[real]


def _leaf_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links that connect what is connected within each region; a region is in one task's memory."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(rows):
            if table.num_rows < 2:
                continue
            node, got = table.column(1).to_numpy(), _elements(table.column(2))
            size, both = _lengths(got), _intersections(got)
            linked = den * both >= num * (size[:, None] + size - both)
            np.fill_diagonal(linked, False)
            if linked.any():
                a, b = _star(linked, node, node)
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = members.select("region", "node").join(sets.hint("merge"), "node").select("region", "node", "elements")
    return dealt.repartition(parallelism(sets.sparkSession), "region").sortWithinPartitions("region", "node").mapInArrow(run, "a long, b long").distinct()


def _chunked(members: DataFrame, block: int) -> DataFrame:
    """With chunks, the number of a region's chunks, and chunk, the one of the member: about ``block`` members and WEIGHT n-grams each."""
    chunks_of = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("weight") / F.lit(WEIGHT))).cast("int")
    return members.withColumn("chunks", chunks_of).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _to_chunks(per_region: DataFrame) -> DataFrame:
    """A row per region and chunk of rows per region."""
    return per_region.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


def _unresolved(hot: DataFrame) -> DataFrame:
    """Members of chunked regions of several labels, with top, the region's most frequent label, and n_open, its members of other labels."""
    by = hot.groupBy("region", "chunks", "label").agg(F.count(F.lit(1)).alias("many"))
    most = by.groupBy("region", "chunks").agg(F.max(F.struct("many", "label")).alias("most"), F.sum("many").alias("all")).where(F.col("all") > F.col("most.many"))
    top = _to_chunks(most.select("region", "chunks", F.col("most.label").alias("top"), (F.col("all") - F.col("most.many")).alias("n_open")))
    return hot.join(top.drop("chunks").hint("merge"), ["region", "chunk"])


def _divided(hot: DataFrame, sets: DataFrame, num: int, den: int, salt: int) -> DataFrame:
    """a, b: links with pivots; or region, parent, node, n_shingles: a member of a Voronoi cell of an unresolved chunked region.

    PIVOTS members of each region are its pivots, the first by a hash; each chunk of the region gets their sets.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(rows):
            pivot = table.column("is_pivot").to_numpy()
            ours = table.filter(pa.array(pivot))
            pivots, name = _elements(ours.column("elements")), ours.column("node").to_numpy()
            others = table.filter(pa.array(~pivot))
            for at in range(0, others.num_rows, BLOCK):
                some = others.slice(at, BLOCK)
                node, got = some.column("node").to_numpy(), _elements(some.column("elements"))
                both = _intersections(got, pivots)
                union = _lengths(got)[:, None] + _lengths(pivots) - both
                linked = (den * both >= num * union) & (node[:, None] != name)
                i, j = np.nonzero(linked)
                yield _split(len(i), a=pa.array(np.minimum(node[i], name[j])), b=pa.array(np.maximum(node[i], name[j])))
                # distances as fractions: a cell is entered where d <= nearest + 2 * eps, with room for rounding
                far = 1 - both / union
                i, j = np.nonzero(far <= far.min(1, keepdims=True) + 2 * (den - num) / den + 1e-9)
                parent = some.column("region").to_numpy()[i]
                cell = _mix(_mix(parent.view(np.uint64)) + name[j].view(np.uint64)).view(np.int64)
                yield _split(len(i), region=pa.array(cell), parent=pa.array(parent), node=pa.array(node[i]), n_shingles=pa.array(_lengths(got)[i]))

    unresolved = _unresolved(hot)
    first = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(salt)), "node")
    pivots = unresolved.select("region", "chunks", "node").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PIVOTS)
    pivots = _to_chunks(pivots).select("region", "chunk", "node", F.lit(True).alias("is_pivot"))
    rows = unresolved.select("region", "chunk", "node", F.lit(False).alias("is_pivot")).unionByName(pivots)
    rows = rows.join(sets.hint("merge"), "node").select(F.xxhash64("region", "chunk").alias("key"), "region", "node", "is_pivot", "elements")
    return rows.repartition(parallelism(sets.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(run, SPLIT_DDL)


SPLIT = pa.schema([(k, pa.int64()) for k in ("a", "b", "region", "parent", "node", "n_shingles")])
SPLIT_DDL = "a long, b long, region long, parent long, node long, n_shingles long"


def _split(size: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in SPLIT], schema=SPLIT)


def _grid(hot: DataFrame, block: int) -> DataFrame:
    """cell, node, label, side: blocks of open members (side 0) against chunks of all (1: of the most frequent label, 2: open).

    Every two members of different labels of an unresolved region meet in a cell, which holds about two blocks at most.
    """
    unresolved = _unresolved(hot)
    # as many blocks as members and n-grams ask for
    blocks = F.least(F.ceil(F.col("n_open") / F.lit(block) + F.col("n_open") * F.col("weight") / F.col("members") / F.lit(WEIGHT)), F.col("n_open")).cast("int")
    unresolved = unresolved.withColumn("blocks", blocks)
    left = unresolved.where("label <> top").withColumn("at", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = unresolved.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("to", F.col("chunk"))
    side = F.when(F.col("label") == F.col("top"), 1).otherwise(2)
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", side))
    return rows.select(F.xxhash64("region", "at", "to").alias("cell"), "node", "label", "side")


def _block_links(hot: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """a, b: links between members of chunked regions that have different labels."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(rows):
            side = table.column("side").to_numpy()
            left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side > 0))
            if not left.num_rows or not right.num_rows:
                continue
            (a, x), (b, y) = ((t.column("node").to_numpy(), _elements(t.column("elements"))) for t in (left, right))
            both = _intersections(x, y)
            linked = den * both >= num * (_lengths(x)[:, None] + _lengths(y) - both)
            linked &= left.column("label").to_numpy()[:, None] != right.column("label").to_numpy()
            if linked.any():
                a, b = _star(linked, a, b)
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = _grid(hot, block).join(sets.hint("merge"), "node").select("cell", "node", "label", "side", "elements")
    return dealt.repartition(parallelism(sets.sparkSession), "cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a long, b long").distinct()


def _near_labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label of linked nodes: the smallest node within two links.  Nodes of one label are surely one component."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    one = scratch.written(both.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("v"), F.least("u", "v").alias("least"), "n"), "near")
    return join_groups(both, one, ["v"], "n").groupBy("u").agg(F.min("least").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label"))


def _links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, block: int, scratch: Scratch) -> DataFrame:
    """a, b: links that connect all that is connected, of the members of regions.

    Most members are in small regions only, whose sets are used once; those of large regions, which each round reads, are a table of their own.
    """
    small = (F.col("members") <= block) & (F.col("weight") <= WEIGHT)
    links = scratch.written(_leaf_links(members.where(small), sets_of(members.where(small)), num, den), "leaf-links")
    hot = members.where(~small)
    whole = None  # regions that pivots don't divide
    for salt in range(ROUNDS + 1):
        if hot.isEmpty():
            break
        if salt == 0:
            sets = scratch.written(sets_of(hot).join(hot.select("node").distinct().hint("merge"), "node", "left_semi"), "sets")
        labelled = hot.join(_near_labels(links, scratch).hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        labelled = scratch.written(_chunked(labelled, block), "hot")
        if salt == ROUNDS:
            whole = labelled if whole is None else whole.unionByName(labelled)
            break
        split = scratch.written(_divided(labelled, sets, num, den, salt), "divided")
        links = links.unionByName(split.where("a IS NOT NULL").select("a", "b"))
        cells = split.where("region IS NOT NULL")
        # a parent whose cells hold its members too often stays as it is
        held = scratch.written(cells.groupBy("parent").agg(F.count(F.lit(1)).alias("held")).withColumnRenamed("parent", "region"), "held")
        per_region = labelled.select("region", "chunks", "chunk", "members")
        stays = scratch.written(per_region.groupBy("region").agg(F.first("members").alias("members")).join(held.hint("merge"), "region").where(F.col("held") > COPIES * F.col("members")).select("region", F.col("members").alias("n")), "stays")
        kept = join_groups(labelled, stays, ["region"], "n").drop("n")
        whole = kept if whole is None else whole.unionByName(kept)
        inner = cells.join(stays.select(F.col("region").alias("parent")).hint("merge"), "parent", "left_anti").select("region", "node", "n_shingles")
        cells = _sized(inner, scratch, f"cells-{salt}")
        links = links.unionByName(scratch.written(_leaf_links(cells.where(small), sets, num, den), "cell-links"))
        hot = cells.where(~small)
    if whole is not None:
        labels = components(links, scratch)
        named = whole.drop("label").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = links.unionByName(scratch.written(_block_links(scratch.written(named, "whole"), sets, num, den, block), "block-links"))
    return links


def mark(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, raw (a hash of the text), kept: one row per row of ``df``, as ``join`` describes it.

    Of a component, the row of the smallest doc_id is kept, then of the smallest raw; a null id comes last.  Rows that are equal
    in both are all marked, so whoever filters by the two still has to leave one of them.  A document with an empty set is kept.
    """
    spark = df.sparkSession
    parts, scratch = parallelism(spark), Scratch(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = scratch.written(_shared(_cells(docs.select("doc_id", F.xxhash64("text").alias("raw"), "text"), n, parts), parts), "shared")
    rows = shared.where("cells IS NULL").select("doc_id", "raw", "node", "n_shingles")
    votes = scratch.written(_votes(shared, num, den, parts), "votes")
    pivots = scratch.written(votes.groupBy("gram").agg(F.min("node").alias("region"), F.count(F.lit(1)).alias("voters")).where("voters > 1"), "pivots")
    members = _sized(join_groups(votes, pivots, ["gram"], "voters").select("region", "node", "n_shingles"), scratch, "regions")
    links = _links(members, lambda some: _sets(docs, rows, some, n, scratch), num, den, block, scratch)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "raw")).alias("first")
    of_node = rows.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), first)
    nodes = of_node.join(components(links, scratch).hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = scratch.written(nodes, "nodes")
    groups = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.min("least").alias("component_id"), F.min("first").alias("best"))
    whole = join_groups(nodes.select("label", "node", "copies"), scratch.written(groups, "groups"), ["label"], "nodes")
    whole = scratch.written(whole.select("node", "copies", "component_id", F.col("best.doc_id").alias("best_id"), F.col("best.raw").alias("best_raw")), "components")
    kept = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("raw") == F.col("best_raw"))
    full = join_groups(rows.where("node IS NOT NULL"), whole, ["node"], "copies").select("doc_id", "n_shingles", "component_id", "raw", kept.alias("kept"))
    alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "raw", F.lit(True).alias("kept"))
    out = written(full.unionByName(alone), "components")
    scratch.clear()
    return out


def join(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``df``.

    A document's set holds its distinct runs of ``n`` words (ASCII letters in lower case, words between ASCII
    white space), the whole sequence where it has fewer; documents link when den * intersection >= num *
    union.  component_id is the smallest id that links reach.  A null, empty or blank text has an empty set
    and stays alone; a null id is reached but names nothing.  Repeated rows link with each other; other
    columns are ignored; an empty table gives an empty result.  Regions of more than ``block`` members are divided or worked
    on in pieces of about that size; the result is the same for any.
    """
    return mark(df, n, num, den, id_col, text_col, block).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), n=4, num=85)
