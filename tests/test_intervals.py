"""Overlaps by dyadic bins against every pair."""

import random

from codetables.operators import impact, intervals


def test_overlaps_equal_every_pair(spark):
    r = random.Random(9)
    span = lambda most: (lambda a: (a, a + r.choice([-1, 0, 0, 1, 3, 17, most])))(r.randint(0, 200))
    left = [(r.choice("pq"), k, *span(1 << 30)) for k in range(150)] + [("p", 900, 5, 5), ("p", 900, 5, 5), ("p", 901, None, 4), (None, 902, 1, 9), ("z", 903, 0, (1 << 31) - 1)]
    right = [(r.choice("pq"), k, *span(1 << 20)) for k in range(150)] + [("p", 901, 4, None), (None, 902, 1, 9), ("z", 5, 0, 0), ("z", 6, 1 << 30, 1 << 30)]
    a = spark.createDataFrame(left, "path string, a int, lo int, hi int")
    b = spark.createDataFrame(right, "path string, b int, start_line int, end_line int")
    expected = sorted((p, x, lo, hi, y, s, e) for p, x, lo, hi in left for q, y, s, e in right if p is not None and p == q and None not in (lo, hi, s, e) and lo <= hi and s <= e and s <= hi and lo <= e)
    assert sorted(map(tuple, intervals.overlapping(a, b, ["path"]).collect())) == expected
    assert intervals.overlapping(a.where("false"), b, ["path"]).count() == 0


def test_one_file_of_many_spans(spark):
    """A hundred thousand spans and ranges of one file: all pairs would be 10**10."""
    n = 100_000
    ranges = spark.range(n).selectExpr("'c' AS change_id", "'p' AS path", "CAST(id * 10 + 3 AS INT) AS start_line", "CAST(id * 10 + 4 AS INT) AS end_line")
    symbols = spark.range(n).selectExpr("'p' AS path", "'function' AS kind", "concat('f', id) AS name", "CAST(id * 10 AS INT) AS start_line", "CAST(id * 10 + 8 AS INT) AS end_line")
    hit = impact.changed_symbols(ranges, symbols)
    assert hit.selectExpr("count(*)", "sum(size(changed_lines))").first()[:] == (n, 2 * n)


def test_lines_are_looked_up_in_bins_that_intervals_fill(spark, monkeypatch):
    asked, bins = [], intervals.bins_of_line
    monkeypatch.setattr(intervals, "bins_of_line", lambda line, levels=intervals.LEVELS: asked.append(levels) or bins(line, levels))
    left = spark.createDataFrame([("p", 10, 12), ("p", 90, 90), ("p", 5, 4)], "path string, lo int, hi int")
    right = spark.createDataFrame([("p", k * 5 + 1, k * 5 + 15) for k in range(30)], "path string, start_line int, end_line int")
    got = {(r.lo, r.start_line) for r in intervals.overlapping(left, right, ["path"]).collect()}
    assert got == {(lo, s) for lo, hi in ((10, 12), (90, 90)) for s in range(1, 150, 5) if s <= hi and s + 14 >= lo}
    assert max(asked) <= 4  # not 32
