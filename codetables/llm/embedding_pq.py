"""Operator 5: near-duplicate embeddings by product quantisation.

A bounded sample fits coarse centroids and, on residuals, one codebook per subspace.  Every vector is then
indexed: its coarse list, its residual's codes, and how far the quantised vector is from it.  A query probes
every list that can hold a partner (distance to the centroid at most the link distance plus the list's
radius), reads distances from one table per subspace, keeps what the link distance plus the stored
quantisation error allows, and compares those exactly.  Both limits are triangle inequalities, so no linked
pair is missed.

Equal vectors of a label are one node with a weight.  A list of a label is joined in blocks of bounded size,
so a label or list that holds a third of all rows is many tasks; a block returns a count per query and a
spanning star per component of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm.common import Scratch, join_groups, written
from codetables.llm.components import components

#: Vectors that fit the index at most, in the order of a hash of their ids.
SAMPLE = 8192
#: Coarse lists at most, dimensions per subspace, codewords per subspace, rows of a block, rounds of k-means.
LISTS, SUB_DIMS, CODEWORDS, BLOCK, ROUNDS, SEED = 256, 4, 64, 2048, 8, 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances2(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and a codebook per subspace, for unit vectors of one dimension."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray], cuts: list[tuple[int, int]]):
        self.coarse, self.books, self.cuts = coarse, books, cuts

    @staticmethod
    def fit(x: np.ndarray) -> Index:
        rng = np.random.default_rng(SEED)
        coarse = kmeans(x, max(1, min(LISTS, int(len(x) ** 0.5))), rng)
        residual = x - coarse[nearest(x, coarse)]
        cuts = [(i, min(i + SUB_DIMS, x.shape[1])) for i in range(0, x.shape[1], SUB_DIMS)]
        return Index(coarse, [kmeans(residual[:, a:b], CODEWORDS, rng) for a, b in cuts], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """list, distance to its centroid, codes, distance from the quantised vector."""
        lists = nearest(x, self.coarse)
        residual = x - self.coarse[lists]
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1)
        left = residual - np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return lists, np.linalg.norm(residual, axis=1), codes.astype(np.uint8), np.linalg.norm(left, axis=1)

    def asymmetric(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the quantised vectors of one list, by table lookup."""
        residual = q - self.coarse[which]
        out = np.zeros((len(q), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += distances2(residual[:, a:b], book)[:, codes[:, m]]
        return np.sqrt(out)


def normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors; each is divided by its largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit(rows: list[bytes]) -> np.ndarray:
    return normed(np.stack([np.frombuffer(r, np.float64) for r in rows]))


def spanning(linked: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of all nodes that a link touches: label is the smallest node of the component within the block."""
    big = np.iinfo(np.int64).max
    lq, lx = q.copy(), x.copy()
    while True:
        nx = np.minimum(lx, np.where(linked, lq[:, None], big).min(0, initial=big))
        nq = np.minimum(lq, np.where(linked, nx, big).min(1, initial=big))
        if (nx == lx).all() and (nq == lq).all():
            break
        lq, lx = nq, nx
    a, b = linked.any(1), linked.any(0)
    return np.concatenate((q[a], x[b])), np.concatenate((lq[a], lx[b]))


def dedup(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``df``.

    Vectors link when their labels and dimensions are equal, the label is not null, and their cosine in double precision is at
    least ``threshold`` (greater than 0).  A vector that is null, empty, zero or holds null or non-finite components links with
    nothing.  Repeated rows link with each other.  component_id is the smallest id that links reach, null
    ids left out; other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "label IS NOT NULL AND v IS NOT NULL AND forall(v, e -> e IS NOT NULL AND e = e AND abs(e) < double('inf')) AND exists(v, e -> e <> 0)"
    rows = rows.withColumn("valid", F.coalesce(F.expr(fine), F.lit(False)))
    classes = rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("label", F.concat_ws(":", F.size("v"), "label")), "vector-classes")

    bounded = classes.orderBy(F.xxhash64("vec_id", "node"), "node").limit(SAMPLE).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in bounded:
        by_dim.setdefault(len(r.v), []).append(r.v)
    models = {d: Index.fit(normed(np.array(x))) for d, x in by_dim.items()}
    shared = spark.sparkContext.broadcast(models)  # LISTS centroids and CODEWORDS codewords for each dimension in the sample
    far = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def model_of(d: int) -> Index:
        """A dimension that the sample lacks has one list around the origin and one codeword."""
        return shared.value.get(d) or Index(np.zeros((1, d)), [np.zeros((1, d))], [(0, d)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3).to_pylist()
            dims = np.array([len(v) for v in lists])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                v = np.array([lists[i] for i in at], np.float64)
                which, rho, codes, off = model_of(d).encode(normed(v))
                few = batch.select(["node", "label", "weight"]).take(pa.array(at))
                yield pa.record_batch([*few.columns, pa.array(which.astype(np.int32)), pa.array(rho), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array([x.tobytes() for x in v], pa.binary())], [*few.schema.names, "list", "rho", "codes", "off", "vector"])

    index = scratch.written(classes.select("node", "label", "weight", "v").mapInArrow(assign, "node long, label string, weight long, list int, rho double, codes binary, off double, vector binary"), "pq-index")
    # lists of a label, their radius and size; joined by key, as labels may be many
    cells = scratch.written(index.groupBy("label", "list").agg(F.max("rho").alias("radius"), F.count(F.lit(1)).alias("n")), "pq-cells")
    radius = {(r.d, r.list): r.radius for r in cells.groupBy(F.split("label", ":", 2)[0].cast("int").alias("d"), "list").agg(F.max("radius").alias("radius")).collect()}  # LISTS per dimension

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            dims = np.array([len(v) // 8 for v in vectors], np.int64)
            for d in np.unique(dims).tolist():
                model, at = model_of(d), np.flatnonzero(dims == d)
                reach = np.array([radius.get((d, c), -far) for c in range(len(model.coarse))]) + far
                for k in range(0, len(at), 1024):
                    part = at[k : k + 1024]
                    row, which = np.nonzero(np.sqrt(distances2(unit([vectors[i] for i in part]), model.coarse)) <= reach + 1e-7)
                    rows = batch.select([0, 1]).take(pa.array(part[row]))
                    yield pa.record_batch([*rows.columns, pa.array(which.astype(np.int32))], ["node", "label", "list"])

    probes = index.select("node", "label", "vector").mapInArrow(probe, "node long, label string, list int")
    probes = scratch.written(probes.join(cells.select("label", "list").hint("merge"), ["label", "list"]), "pq-probes")
    asked = probes.groupBy("label", "list").agg(F.count(F.lit(1)).alias("asked"))
    blocks = cells.join(asked.hint("merge"), ["label", "list"]).select("label", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("nx"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("nq"))
    blocks = scratch.written(blocks, "pq-blocks")

    mine = F.xxhash64("node")
    unit_cols = ["label", "list", "bx", "bq"]
    stored = index.join(blocks.hint("merge"), ["label", "list"]).select("label", "list", F.pmod(mine, F.col("nx")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), F.lit(True).alias("is_stored"), "node", "weight", "codes", "off", "vector")
    queries = probes.join(blocks.hint("merge"), ["label", "list"]).select("label", "list", "nx", "nq", "node").join(index.select("node", "vector").hint("merge"), "node")
    queries = queries.select("label", "list", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(mine, F.col("nq")).cast("int").alias("bq"), F.lit(False).alias("is_stored"), "node", F.lit(0).cast("long").alias("weight"), F.lit(b"").alias("codes"), F.lit(0.0).alias("off"), "vector")

    def compare(block: pa.Table) -> pa.Table:
        is_stored = block.column("is_stored").to_numpy()
        node, weight, off = (block.column(k).to_numpy() for k in ("node", "weight", "off"))
        s, a = np.flatnonzero(is_stored), np.flatnonzero(~is_stored)
        out = {"node": [], "n": [], "label": []}
        if len(s) and len(a):
            vectors = block.column("vector").to_pylist()
            x, q = unit([vectors[i] for i in s]), unit([vectors[i] for i in a])
            packed = block.column("codes").to_pylist()
            codes = np.stack([np.frombuffer(packed[i], np.uint8) for i in s])
            model, which = model_of(x.shape[1]), block.column("list")[0].as_py()
            linked = np.zeros((len(a), len(s)), bool)
            for i in range(0, len(a), 256):
                near = model.asymmetric(q[i : i + 256], which, codes) <= far + off[s] + 1e-7
                r, c = np.nonzero(near & (node[a][i : i + 256, None] != node[s]))
                for k in range(0, len(r), 1 << 16):
                    rk, ck = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
                    linked[rk + i, ck] = np.einsum("ij,ij->i", q[rk + i], x[ck]) >= threshold
            n = linked @ weight[s]
            hit = np.flatnonzero(n)
            members, label = spanning(linked, node[a], node[s])
            out = {"node": np.concatenate((node[a][hit], members)), "n": np.concatenate((n[hit], np.zeros(len(members), np.int64))), "label": np.concatenate((node[a][hit], label))}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = scratch.written(stored.unionByName(queries).groupBy(*unit_cols).applyInArrow(compare, "node long, n long, label long"), "pq-found")
    named = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), scratch)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    whole = classes.select("node", "vec_id", "weight").join(named.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = scratch.written(whole, "pq-labels")
    least = scratch.written(whole.groupBy("label").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "pq-least")
    whole = join_groups(whole, least, ["label"], "members").join(counts.hint("merge"), "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    whole = scratch.written(classes.select("node", F.expr("substring(label, instr(label, ':') + 1)").alias("label"), "v", "weight").join(whole.hint("merge"), "node"), "vector-results")

    # copies of one vector get its result in many tasks
    alike = join_groups(rows.where("valid").select("vec_id", "label", "v"), whole, ["label", "v"], "weight").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()).alias("kept"))
    alone = rows.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = written(alike.unionByName(alone), "vector-links")
    scratch.clear()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: For DuckDB: the same links by brute force; components by repeated spreading of the smallest id.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = e.vec_id
"""
