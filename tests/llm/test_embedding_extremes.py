"""Operator 5 on vectors whose squares leave the range of doubles, and on hot copies and components."""

from codetables.llm import common, embedding_pq


def test_tiny_and_huge_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [0.0, 1e-200, 1e-201]), (5, [0.0, 1e300, 1e299]), (6, [0.0, 0.0, 5e-324]), (7, [0.0, 0.0, 1.7e308]), (8, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_pq.dedup(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 6, False), 8: (0, 8, True)}


def test_hot_copies_and_components(spark, monkeypatch):
    """Groups above the bound are joined by a broadcast of their few keys."""
    monkeypatch.setattr(common, "HEAVY", 5)
    rows = [(k, [1.0, 0.0]) for k in range(40)] + [(100 + k, [1.0, 0.001 * k]) for k in range(1, 30)] + [(500, [0.0, 1.0]), (None, [0.0, 1.0]), (501, None)]
    df = spark.createDataFrame([(i, v, "a", 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label string, weight int, node string").repartition(6)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_pq.dedup(df).collect()), key=str)
    expected = [(i, 68, 0, i == 0) for i, v in rows[:69]] + [(500, 1, 500, True), (None, 1, 500, False), (501, 0, 501, True)]
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected, key=str)]
    assert sum(g[3] for g in got if g[0] is not None) == 3
