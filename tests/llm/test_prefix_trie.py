"""Operator 12 against a plain trie, over few and many ranges."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from codetables.llm import common, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the conversations (conv_id, turn, role, text), each found by walking."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, prefix_digest(role, text), role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in convs.items()}
    members = collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def prefix_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def made(n, turns, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rnd.random()
        length = 3 if kind < 0.4 else rnd.randint(1, turns)
        for t in range(length):
            text = f"same {t}" if kind < 0.4 or (kind < 0.7 and t < 2) else rnd.choice(["a", "bb", "ccc", "Größe 🙂", "", None])
            rows.append((c * rnd.choice([1, 1, 1, 3]) if kind > 0.9 else c, t, rnd.choice(["user", "user", "x", None]) if kind > 0.8 else "user", text))
    rows += [(n, 0, "user", "same 0"), (n, None, "user", "first"), (n, 1, "user", "same 1"), (n, 1, "user", "same 1"), (None, 0, "user", "nobody"), (7, 99, None, None)]
    rows += [(100 * n + 1, 0, "user", "far"), (100 * n + 7, 0, "user", "far"), (100 * n + 7, 1, "user", "farther")]
    return rows


def schema(rows, spark):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, b"n") for r in rows], "conv_id long, turn long, role string, text string, key string, part int, node binary").repartition(7)


@pytest.mark.parametrize(("n", "turns", "a_range"), [(400, 6, 10**6), (400, 6, 40), (60, 3, 1), (300, 40, 100), (1, 2, 10)])
def test_trie(spark, n, turns, a_range):
    rows = made(n, turns, n + a_range)
    scratch = common.Scratch(spark)
    got = prefix_trie.trie(prefix_trie.rebuilt(schema(rows, spark)), scratch, a_range).select(*COLUMNS).collect()
    scratch.clear()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_copies_in_all_ranges_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 6000, 100) for t in range(5)]
    rows += [(100 * k + 1, 0, "user", "only") for k in range(100, 160)]  # some lose their only turn, and no base gives them one
    scratch = common.Scratch(spark)
    got = prefix_trie.trie(prefix_trie.rebuilt(schema(rows, spark)), scratch, 3).collect()
    scratch.clear()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert any(r.depth == 0 and r.ends_sha256 != hashlib.sha256(b"").hexdigest() for r in got)


def test_none(spark):
    rows = made(3, 2, 1)
    scratch = common.Scratch(spark)
    assert prefix_trie.trie(prefix_trie.rebuilt(schema(rows, spark).where("false")), scratch).count() == 0
    alone = prefix_trie.trie(prefix_trie.rebuilt(schema([(1, 0, "a", "b")], spark).where("conv_id = 1")), scratch)
    assert alone.count() == len(brute([(1, 0, "a", "b")]))
    scratch.clear()


def test_sql(spark, tmp_path):
    rows = made(120, 5, 9)
    schema(rows, spark).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    conversations = duckdb.read_parquet(str(tmp_path / "conversations.parquet/*.parquet"))  # noqa: F841
    columns = ", ".join(COLUMNS)
    assert sorted(duckdb.sql(f"SELECT {columns} FROM ({prefix_trie.SQL})").fetchall(), key=str) == brute(rows)
    assert sorted((tuple(r) for r in prefix_trie.query(spark, str(tmp_path)).collect()), key=str) == brute(rows)
