"""Operator 12: the trie of all prefixes of conversations, by range minima over the LCPs of their sorted order.

A conversation is the sequence of its turns' 128-bit digests; sorted, the members of a prefix are one interval.  In each range of the
sorted order a sparse table holds the minima of neighbours' common prefixes over 1, 2, 4, ... rows; each candidate prefix
(a row and a depth) finds how far it reaches by a binary search to the left and, independently, one to the right.  No stack is kept, and all
candidates of a range take each step together.

The order is cut into ranges over (sequence, conversation), so copies of one conversation or a common first turn lie in many ranges.
A prefix that reaches neither border of its range is complete there.  The others are prefixes of a range's first or last row: their
sums are added up over ranges, once the common prefix of each range with the one before it is known (one number per range).  Sums over
subtrees are sums over rows: a row brings the turns that no earlier row has, and is a leaf where no later row continues it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetables.llm.common import Scratch, crc_mod, join_groups, parallelism, written

#: Bytes of a turn's digest; turns that one range holds about.
WIDTH, RANGE = 16, 1_000_000
_FIELDS = [
    ("kind", pa.int32()), ("part", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_node", pa.binary()), ("node", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("at_left", pa.bool_()), ("at_right", pa.bool_()), ("sum_t", pa.int64()), ("brought", pa.int64()), ("t_before", pa.int64()), ("first_t", pa.int64()), ("first_len", pa.int64()), ("last_len", pa.int64()),
    ("first_key", pa.binary()), ("last_key", pa.binary()), ("first_ts", pa.binary()),
]
_NAMES = [n for n, _ in _FIELDS]
_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}
_SCHEMA = ", ".join(f"{n} {_SPARK[t]}" for n, t in _FIELDS)
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(df: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest and code points, in order) of conversations (conv_id, turn, role, text).

    Turns are ordered by ``turn``, null first, ties by digest.  Null roles and texts are empty; rows without a conv_id belong to no
    conversation; repeated rows are turns of their own; other columns are ignored.  Only 24 bytes a turn are gathered per conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    rows = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("n"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))).alias("turns"))


def rebuilt(df: DataFrame) -> DataFrame:
    """``sequences`` whose first h turns are those of conversation c - c % 100, h = crc32(c) % 6."""
    own = sequences(df).withColumns({"head": F.col("conv_id") - F.col("conv_id") % 100, "h": crc_mod("conv_id", 6).cast("int")})
    heads = sequences(df.where("conv_id % 100 = 0")).select(F.col("conv_id").alias("head"), F.slice("turns", 1, 5).alias("first"))
    both = own.join(heads.hint("merge"), "head", "left")
    first = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minimum of 2**k values from each place on."""
    table = [values]
    while (half := 1 << (len(table) - 1)) * 2 <= len(values):
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _reach_right(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row that shares ``depth`` turns with row ``at``."""
    at, n = at.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        can = np.flatnonzero(at + step < n)
        can = can[table[k][at[can] + 1] >= depth[can]]
        at[can] += step
    return at


def _reach_left(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row that shares ``depth`` turns with row ``at``."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        can = np.flatnonzero(at - step >= 0)
        can = can[table[k][at[can] - step + 1] >= depth[can]]
        at[can] -= step
    return at


def _least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of each interval, from two overlapping powers of two."""
    out, level = np.empty(len(left), np.int64), np.frexp(right - left + 1)[1] - 1
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[left[at]], row[right[at] - (1 << k) + 1])
    return out


def _common(turns: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it (the first row: 0), all rows a turn at a time."""
    lcp, at, t = np.zeros(len(length), np.int64), np.arange(1, len(length)), 0
    least = np.minimum(length[1:], length[:-1])
    while len(at := at[least[at - 1] > t]):
        at = at[(turns[off[at] + t] == turns[off[at - 1] + t]).all(1)]
        t += 1
        lcp[at] = t
    return lcp


def _node_names(key: bytes) -> list[bytes]:
    """A digest of each prefix of a sequence, from the empty one on."""
    h = hashlib.sha256()
    names = [h.digest()[:WIDTH]]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        names.append(h.copy().digest()[:WIDTH])
    return names


def _batch(n: int, **columns) -> pa.RecordBatch:
    arrays = []
    for name, kind in _FIELDS:
        x = columns.get(name)
        arrays.append(pa.nulls(n, kind) if x is None else pa.array(x, kind) if not isinstance(x, pa.Array) else x)
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def trie_of_range(part: int, convs: np.ndarray, keys: list[bytes], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of the sorted order: complete ones (kind 0), those that may go on beyond a border (1), and its first and last row (2)."""
    m = len(keys)
    length = np.array([len(k) // WIDTH for k in keys], np.int64)
    off = np.concatenate([[0], np.cumsum(length)])
    turns = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    lcp = _common(turns, off, length)
    so_far = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])

    def till(row, d):
        """Code points of the first d turns of a row."""
        return so_far[off[row] + np.maximum(d, 0)] - so_far[off[row]]

    own = np.concatenate([[-1], lcp[1:]])  # a row brings its prefixes deeper than this; the first of a range all, the root too
    start = np.concatenate([[0], np.cumsum(length - own)])
    row = np.repeat(np.arange(m), length - own)
    depth = np.arange(start[-1]) - start[row] + own[row] + 1
    table = _range_minima(lcp)
    left, right = _reach_left(table, row, depth), _reach_right(table, row, depth)
    parent = np.arange(len(row)) - 1
    heads = start[1:-1][length[1:] > lcp[1:]]  # the first candidate of a row hangs below the prefix shared with the row before
    shared = lcp[row[heads]]
    above = _reach_left(table, row[heads], shared)
    parent[heads] = start[above] + shared - own[above] - 1

    whole = till(np.arange(m), length)
    brings = np.concatenate([[0], whole[1:] - till(np.arange(1, m), lcp[1:])])
    leaf = np.concatenate([lcp[1:] < length[:-1], [False]])  # the last row's is known with the next range
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("whole", whole), ("brings", brings), ("leaf", leaf.astype(np.int64)))}
    n = right - left + 1
    least = _least(_range_minima(convs), left, right)
    sum_t, leaves = sums["whole"][right + 1] - sums["whole"][left], sums["leaf"][right + 1] - sums["leaf"][left]
    before = till(left, depth - 1)
    brought = sums["brings"][right + 1] - sums["brings"][left + 1] + np.where(left > 0, whole[left] - before, 0)
    children = np.bincount(parent[heads], minlength=len(row))
    first_len = length[left]

    run = np.flatnonzero(np.concatenate([[True], (lcp[1:] != length[1:]) | (length[1:] != length[:-1])]))  # equal rows
    run_end = np.empty(m, np.int64)
    run_end[run] = np.concatenate([run[1:], [m]])
    ends: list[str | None] = [None] * len(row)
    shown = convs.astype(str)
    for x in np.flatnonzero(first_len == depth).tolist():
        ends[x] = ",".join(shown[left[x] : run_end[left[x]]])

    edge = (left == 0) | (right == m - 1)
    names: dict[int, bytes] = {}
    of_first, of_last = _node_names(keys[0]), _node_names(keys[-1])
    for x in np.flatnonzero(edge).tolist():
        names[x] = (of_first if left[x] == 0 else of_last)[depth[x]]
    inner, outer = np.flatnonzero(~edge), np.flatnonzero(edge)
    up = parent[inner]
    yield _batch(
        len(inner), kind=np.zeros(len(inner), np.int32), part=np.full(len(inner), part, np.int32), depth=depth[inner], conv_id=least[inner],
        parent_conv_id=pa.array(least[up], mask=edge[up]), parent_node=[names.get(x) for x in up.tolist()], n_convs=n[inner], n_children=children[inner] + (first_len > depth)[inner],
        n_leaves=leaves[inner], saved_tokens=(sum_t - n * before - brought)[inner], ends=[hashlib.sha256((ends[x] or "").encode()).hexdigest() for x in inner.tolist()],
    )
    at_left, at_right = (left == 0)[outer], (right == m - 1)[outer]
    k = len(outer)
    yield _batch(
        k, kind=np.ones(k, np.int32), part=np.full(k, part, np.int32), depth=depth[outer], conv_id=least[outer], parent_node=[names[parent[x]] if depth[x] else None for x in outer.tolist()], node=[names[x] for x in outer.tolist()],
        n_convs=n[outer], n_children=children[outer], n_leaves=leaves[outer], ends=[ends[x] for x in outer.tolist()], at_left=at_left, at_right=at_right, sum_t=sum_t[outer], brought=brought[outer],
        t_before=before[outer], first_t=np.full(k, whole[0]), first_len=first_len[outer], last_len=np.full(k, length[-1]),
    )
    yield _batch(1, kind=[2], part=[part], first_key=[keys[0]], last_key=[keys[-1]], first_ts=[(so_far[: length[0] + 1]).astype("<i8").tobytes()])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows["sizes"].combine_chunks()
        sizes = sizes.chunk(0) if isinstance(sizes, pa.ChunkedArray) else sizes
        yield from trie_of_range(rows["part"][0].as_py(), rows["conv_id"].to_numpy(), rows["key"].to_pylist(), sizes.flatten().to_numpy(zero_copy_only=False))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that each range's first row shares with the row before it (the very first: -1), and their code points."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            shared = -1
            if r["prev_key"] is not None:
                a, b = (np.frombuffer(r[k], "<u8").reshape(-1, 2) for k in ("prev_key", "first_key"))
                n = min(len(a), len(b))
                differ = np.flatnonzero((a[:n] != b[:n]).any(1))
                shared = int(differ[0]) if len(differ) else n
            out.append((r["part"], shared, int(np.frombuffer(r["first_ts"], "<i8")[max(shared, 0)])))
        yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["part", "shared", "shared_t"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of several ranges, from their rows sorted by node and range; one running state and digest at a time."""
    now: dict = {}

    def done() -> pa.RecordBatch:
        saved = now["sum_t"] - now["n_convs"] * now["t_before"] - now["brought"]
        row = {**{k: now[k] for k in ("node", "parent_node", "depth", "conv_id", "n_convs", "n_children", "n_leaves")}, "saved_tokens": saved, "ends_sha256": now["sha"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("node", pa.binary()), ("parent_node", pa.binary()), *((k, pa.int64()) for k in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())]))

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            for r in batch.slice(at, 100).to_pylist():
                if not now or r["node"] != now["node"]:
                    if now:
                        yield done()
                    now = r | {"sha": hashlib.sha256(), "some": False}
                else:
                    now["conv_id"] = min(now["conv_id"], r["conv_id"])
                    for k in ("n_convs", "n_children", "n_leaves", "sum_t", "brought"):
                        now[k] += r[k]
                if r["ends"]:
                    now["sha"].update((f",{r['ends']}" if now["some"] else r["ends"]).encode())
                    now["some"] = True
    if now:
        yield done()


def trie(convs: DataFrame, scratch: Scratch, turns_a_range: int = RANGE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node of the prefix trie.

    ``convs`` has a distinct conv_id and ``turns`` as ``sequences`` makes them, possibly none.  conv_id is a node's smallest member, n_leaves the childless nodes
    of its subtree, saved_tokens the code points that prefixes shared in it save, ends_sha256 a digest of the members that end at it.
    Without conversations there is no node, not even the root.
    """
    spark = convs.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = scratch.written(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes")), "trie-sequences")
    total = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(parallelism(spark), -(-total // turns_a_range))
    ordered = rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "key", "sizes")
    found = scratch.written(ordered.mapInArrow(_nodes, _SCHEMA), "trie-nodes")

    in_order = Window.orderBy("part")  # one row per range
    borders = found.where("kind = 2").select("part", "first_key", "first_ts", F.lag("last_key").over(in_order).alias("prev_key")).mapInArrow(_borders, "part int, shared long, shared_t long")
    borders = scratch.written(borders, "trie-borders").withColumn("shared_next", F.coalesce(F.lead("shared").over(in_order), F.lit(-1)))
    known = F.when(F.col("shared") >= F.col("depth"), F.col("shared_t")).otherwise(F.col("t_before"))
    edges = found.where("kind = 1").join(F.broadcast(borders), "part").select(
        "part", "node", "parent_node", "depth", "conv_id", "n_convs", "sum_t", "t_before", "ends",
        (F.col("brought") + F.when(F.col("at_left"), F.col("first_t") - known).otherwise(0)).alias("brought"),
        (F.col("n_leaves") + F.when(F.col("at_right") & (F.col("shared_next") < F.col("last_len")), 1).otherwise(0)).alias("n_leaves"),
        (F.col("n_children") + F.when((F.col("first_len") > F.col("depth")) & ~(F.col("at_left") & (F.col("shared") > F.col("depth"))), 1).otherwise(0)).alias("n_children"),
    )
    wide = edges.repartition(parallelism(spark), "node").sortWithinPartitions("node", "part").mapInArrow(_merged, "node binary, parent_node binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    wide = scratch.written(wide, "trie-wide")

    inner = found.where("kind = 0").withColumnRenamed("ends", "ends_sha256")
    below = inner.where("parent_node IS NOT NULL").select("parent_node", *[c for c in _OUT if c != "parent_conv_id"])
    below = below.unionByName(wide.where("parent_node IS NOT NULL").select(*below.columns))
    parents = wide.where("n_children > 0").select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_below"))
    root = wide.where("parent_node IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    placed = join_groups(below, parents, ["parent_node"], "n_below").select(*_OUT)
    return placed.unionByName(inner.where("parent_node IS NULL").select(*_OUT)).unionByName(root.select(*_OUT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    out = written(trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")), scratch), "trie")
    scratch.clear()
    return out


SQL = """
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'d': digest, 'n': n} ORDER BY turn NULLS FIRST, digest) AS turns,
    list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256])),
      lambda a, o: CASE WHEN o < 256 THEN xor(a, o) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS crc FROM t GROUP BY conv_id
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS turns FROM (SELECT *, CAST(xor(crc, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM c) a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 100
), m AS (
  SELECT conv_id, d, len(turns) = d AS ends, array_to_string(list_transform(turns[1:d], lambda x: x.d), '') AS key, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM r)
), nodes AS (
  SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, d
), kids AS (
  SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), subtree AS (
  SELECT left(x.key, 32 * e) AS key, count(*) FILTER (NOT has_kids) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
  FROM (SELECT n.*, k.key IS NOT NULL AS has_kids, unnest(range(depth + 1)) AS e FROM nodes n LEFT JOIN kids k ON k.key = n.key) x GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.key = left(n.key, 32 * (n.depth - 1)) LEFT JOIN kids k ON k.key = n.key JOIN subtree s ON s.key = n.key
"""
