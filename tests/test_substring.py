"""Pattern joins through trigrams against every pattern tried on every text."""

import random
import re

from codetables.operators import explore, substring


def like(text, pattern, fold):
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            out += re.escape(pattern[at])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        at += 1
    return re.fullmatch(out, text, re.S | (re.I if fold else 0)) is not None


def test_like_pairs_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda n, s="abcA_é/": "".join(r.choice(s) for _ in range(r.randint(0, n)))
    texts = [(r.choice("xy"), word(12)) for _ in range(300)] + [("x", None), (None, "abc"), ("x", "abcabc"), ("x", "abcabc"), ("y", "日本語abc")]
    patterns = [(r.choice("xyz"), "".join(r.choice(["%", "_", "\\_", "\\%", word(4, "abcAé/"), word(4, "abcAé/")]) for _ in range(r.randint(0, 5)))) for _ in range(300)]
    patterns += [("x", "%abc%"), ("x", ""), ("x", "%"), ("x", None), ("y", "%本語a%"), ("x", "abcabc"), ("x", "abcabc")]
    t = spark.createDataFrame(texts, "repo_id string, path string")
    p = spark.createDataFrame(patterns, "repo_id string, pattern string")
    for fold in (False, True):
        expected = {(k, a, b) for k, a in patterns for j, b in texts if a is not None and b is not None and k == j and like(b, a, fold)}
        got = substring.like_pairs(p, t, "repo_id", fold=fold).collect()
        assert sorted(map(tuple, got)) == sorted(expected)
    assert substring.like_pairs(p.where("false"), t, "repo_id").count() == substring.like_pairs(p, t.where("false"), "repo_id").count() == 0


def test_lookups_equal_brute_force(spark):
    r = random.Random(7)
    word = lambda n, s="abAB_%": "".join(r.choice(s) for _ in range(r.randint(1, n)))
    paths = [("r", f"{word(3)}/{word(5)}.{r.choice(['py', 'c', ''])}") for _ in range(150)] + [("r", "x"), ("q", "a/b.py")]
    asked = [(k, r.choice("rq"), r.choice([word(3), word(6), r.choice(paths)[1][-r.randint(1, 8) :], "b.py", "y", ""])) for k in range(200)]
    got = {x.request_id: x.path for x in explore.resolve_paths(spark.createDataFrame(asked, "request_id long, repo_id string, wanted string"), spark.createDataFrame(paths, "repo_id string, path string")).collect()}
    for k, repo, wanted in asked:
        hits = [p for q, p in paths if q == repo and p.endswith(wanted) and ("/" not in wanted or p.rpartition("/")[2] == wanted.rpartition("/")[2])]
        assert got.get(k) == (min(hits, key=lambda p: (p != wanted, len(p), p)) if hits else None)

    symbols = [("r", f"f{k % 9}.py", r.choice(["function", "class"]), word(6), k) for k in range(200)]
    found = explore.symbol_lookup(spark.createDataFrame(asked, "request_id long, repo_id string, wanted string"), spark.createDataFrame(symbols, "repo_id string, path string, kind string, name string, start_line int")).collect()
    expected = set()
    for k, repo, wanted in asked:
        hits = sorted((kind, name, path, line) for q, path, kind, name, line in symbols if q == repo and like(name, f"%{wanted}%", True))
        expected |= {(k, *h, n) for n, h in enumerate(hits[:5], 1)}
    assert {(x.request_id, x.kind, x.name, x.path, x.start_line, x["rank"]) for x in found} == expected


def test_long_runs_have_long_grams(spark):
    texts = spark.createDataFrame([("r", f"a/test_{k}") for k in range(100000, 100200)], "repo_id string, path string")
    asked = spark.createDataFrame([("r", "%100123%"), ("r", "%_test%0199"), ("r", "%zzz%")], "repo_id string, pattern string")
    assert "100123" in {r.gram for r in substring.postings(texts, "repo_id", "path").collect()}
    assert {(r.pattern, r.path) for r in substring.like_pairs(asked, texts, "repo_id").collect()} == {("%100123%", "a/test_100123"), ("%_test%0199", "a/test_100199")}
