"""Chunking, diffs, impact, retrieval, admission and maintenance on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from codetables.operators import assembly, chunks, diffs, explore, impact, observe, retrieval
from codetables.plans import index
from codetables.queries import adapters
from codetables.sources import records, tables, tree
from codetables.streaming import admission


def chunked(spark, path, language, text, symbols=()):
    f = spark.createDataFrame([("r", path, language, text)], "repo_id string, path string, language string, content string")
    s = spark.createDataFrame([("r", path, *x) for x in symbols], "repo_id string, path string, kind string, name string, start_line int, end_line int")
    return [(r.start_line, r.end_line, r.name, r.content) for r in chunks.chunk_files(f, s).orderBy("start_line", "end_line", "name").collect()]


def numbered(n):
    return "\n".join(f"line {i}" for i in range(1, n + 1))


def test_symbol_chunks(spark):
    text = numbered(30)
    got = chunked(spark, "a.py", "Python", text, [("class", "A", 1, 10), ("method", "m", 2, 5), ("function", "f", 12, 99), ("route", "GET /", 12, 99), ("function", "f", 12, 99)])
    assert [(s, e, n) for s, e, n, _ in got] == [(1, 10, "A"), (12, 30, "GET /"), (12, 30, "f")]
    assert got[0][3] == "\n".join(text.split("\n")[:10])


def test_windows_cover_with_overlap(spark):
    got = [(s, e) for s, e, _, _ in chunked(spark, "a.py", "Python", numbered(240), [("function", "f", 1, 240)])]
    assert got == [(1, 100), (81, 180), (161, 240)]
    assert [(s, e) for s, e, _, _ in chunked(spark, "a.py", "Python", numbered(120), [("function", "f", 1, 120)])] == [(1, 120)]


def test_markdown_and_setext(spark):
    text = "# One\na\n\nb\n## Two\nc\nd\n\ne\nf\nThree\n=====\ng"
    assert [s for s, _, _, _ in chunked(spark, "a.md", "Markdown", text)] == [1, 5, 11]
    assert [(s, e) for s, e, _, _ in chunked(spark, "a.md", "Markdown", "no\nheadings\nat all\nhere")] == [(1, 4)]


def test_paragraphs_packed(spark):
    block = numbered(80)
    assert [s for s, _, _, _ in chunked(spark, "a.txt", "Text", "\n\n".join([block] * 3))] == [1, 82, 163]
    assert len(chunked(spark, "a.txt", "Text", "\n\n".join(["x\ny"] * 10))) == 1
    assert len(chunked(spark, "a.txt", "Text", numbered(170))) >= 2
    assert chunked(spark, "a.txt", "Text", "") == chunked(spark, "a.txt", "Text", " \n\n\t\n") == []


PATCH = "@@ -8,3 +8,4 @@ def f\n context\n+added\n context\n context\n@@ -30,2 +31 @@\n keep\n-gone"


def test_patch(spark):
    payload = json.dumps([{"filename": "a.py", "status": "modified", "patch": PATCH}, {"filename": "b.png", "status": "added"}])
    files = diffs.changed_files(spark.createDataFrame([("c", payload)], "change_id string, payload string"))
    assert [(r.path, r.patch is None) for r in files.orderBy("path").collect()] == [("a.py", False), ("b.png", True)]
    heads = diffs.hunk_lines(diffs.patch_lines(files)).select("old_start", "old_count", "new_start", "new_count").distinct().orderBy("old_start").collect()
    assert [tuple(r) for r in heads] == [(8, 3, 8, 4), (30, 2, 31, 1)]
    assert [(r.path, r.start_line, r.end_line) for r in diffs.changed_ranges(files).collect()] == [("a.py", 9, 9)]


def test_interval_join(spark):
    r = spark.createDataFrame([("c", "p", 5, 7), ("c", "p", 7, 9), ("c", "q", 1, 1)], "change_id string, path string, start_line int, end_line int")
    s = spark.createDataFrame([("p", "function", "a", 1, 5), ("p", "function", "b", 6, 8), ("p", "function", "d", 10, 12)], "path string, kind string, name string, start_line int, end_line int")
    assert {x.name: x.changed_lines for x in impact.changed_symbols(r, s).collect()} == {"a": [5], "b": [6, 7, 8]}


def test_knn_ties_and_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 3 + 1), 1.0]) for i in range(12)]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0]), (1, [3.0, 1.0])], "query_id long, vector array<float>")
    one = sorted(map(tuple, retrieval.knn_join(q, c, 3).collect()))
    assert [x[1] for x in one] == [0, 3, 6, 2, 5, 8]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, retrieval.knn_join(q, c, 3).collect())) == one


@pytest.mark.parametrize(("times", "expected"), [([0, 1, 2], [True, True, False]), ([0, 1, 10], [True, True, True]), ([0, 5, 9, 10, 15], [True, True, False, True, True])])
def test_admission(times, expected):
    assert admission.admit([t * 1_000_000 for t in times], [], 2, 10)[0] == expected


def test_costs(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 1_000_000, 5.0), ("x", 9, 9, 1.0)], "model string, input_tokens long, output_tokens long, latency_ms double")
    prices = observe.price_list(spark, [("m", 0.075, 0.3)])
    assert {r.model: r.cost_usd for r in observe.cost(usage, prices).collect()} == {"m": 0.375, "x": 0.0}
    assert [r.model for r in observe.unpriced(usage, prices).collect()] == ["x"]
    empty = observe.usage_summary(observe.cost(usage.where("false"), prices)).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0)


def test_job_stats_empty(spark):
    jobs = spark.createDataFrame([], "status string, started_at timestamp, finished_at timestamp, files_indexed int, symbols_indexed int, chunks_indexed int")
    r = observe.job_stats(jobs).first()
    assert r.total_jobs == 0 and r.mean_seconds is None and r.files_indexed == 0


def test_history(spark):
    rows = [("c", i, "user", f"t{i}" if i != 20 else " ") for i in range(24)]
    got = assembly.history(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert sorted(r.turn for r in got.collect()) == [i for i in range(12, 24) if i != 20]


def test_scope_and_patch(spark):
    owned = spark.createDataFrame([("u", "a"), ("u", "b"), ("w", "c")], "user_id string, repo_id string")
    asked = spark.createDataFrame([("u", "b"), ("u", "c")], "user_id string, repo_id string")
    assert sorted(map(tuple, explore.in_scope(asked, owned).collect())) == [("u", "b"), ("w", "c")]


def test_tree_index_and_replace(spark, tmp_path):
    root = tmp_path / "repos"
    for p, c in {"one/src/main.py": "import util\n\ndef f():\n    pass\n", "one/src/util.py": "x = 1\n", "one/node_modules/a.js": "x", "one/_x/__init__.py": "", "one/.env": "s", "two/README.md": "# T\nbody\n"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    (root / "two" / "bad.txt").write_bytes(b"\xff\xfeok")
    t = tree.read_tree(spark, str(root), prune=False)
    assert {(r.repo_id, r.files_scanned) for r in tree.scanned(t).collect()} == {("one", 5), ("two", 2)}
    out = index.index_repos(t)
    assert {(r.repo_id, r.path) for r in out["files"].collect()} == {("one", "src/main.py"), ("one", "src/util.py"), ("one", "_x/__init__.py"), ("two", "README.md"), ("two", "bad.txt")}
    assert [(r.source_path, r.target_path) for r in out["edges"].collect()] == [("src/main.py", "src/util.py")]
    assert {r.repo_id: (r.files_scanned, r.files_indexed, r.symbols_indexed) for r in out["counters"].collect()} == {"one": (5, 3, 1), "two": (2, 2, 0)}
    store = str(tmp_path / "store")
    tables.replace_index(spark, store, ["one", "two"], {"files": out["files"]})
    tables.replace_index(spark, store, ["two"], {"files": out["files"].where("false")})
    assert {r.repo_id for r in spark.read.parquet(f"{store}/files").select("repo_id").distinct().collect()} == {"one"}


def test_records(spark, tmp_path):
    assert records.read_questions(spark, str(tmp_path / "none.json")).count() == 0
    q = spark.createDataFrame([("q", "r", "a.py", None, "c")], records.QUESTION)
    records.write_questions(q, str(tmp_path / "q"))
    assert records.read_questions(spark, str(tmp_path / "q")).count() == 1
    payload = spark.createDataFrame([('{"number": 2, "state": "open", "head": {"ref": "x"}, "updated_at": "2024-01-01T00:00:00Z"}',), ("broken",)], "payload string")
    (p,) = records.pulls(payload, "open").collect()
    assert (p.number, p.title, p.head_ref) == (2, "", "x")


def test_paging(spark):
    df = spark.range(10).select(F.col("id").alias("path"))
    assert [r.path for r in explore.page(df, ["path"], 3, 2).collect()] == [3, 4]


def test_importers_by_group_equal_listed_edges(spark):
    sources = spark.createDataFrame([("r", k % 5, f"s{k}") for k in range(40)], "repo_id string, k int, source_path string")
    targets = spark.createDataFrame([("r", k % 5, f"t{k}") for k in range(30)], "repo_id string, k int, target_path string")
    changed = spark.createDataFrame([("c1", "t3"), ("c1", "t8"), ("c1", "t8"), ("c2", "t4"), ("c2", "gone")], "change_id string, path string")
    listed = impact.importers(changed, sources.join(targets, ["repo_id", "k"]))
    by_group = impact.importers_by_group(changed, sources, targets)
    assert sorted(map(tuple, by_group.collect())) == sorted(map(tuple, listed.collect())) and by_group.count() == 16


def test_patches_and_ranges_sort_no_texts(spark):
    line = "x" * 5000
    files = spark.createDataFrame([("c", "p", "@@ -1,2 +7,3 @@ def f\n" + "\n".join(m + line for m in "+- ++\\+"))], "change_id string, path string, patch string")
    assert [(r.start_line, r.end_line) for r in diffs.changed_ranges(files).orderBy("start_line").collect()] == [(7, 7), (9, 11)]
    slim = diffs.changed_ranges(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(line" in slim  # only the mark of a line goes on
    p = adapters.patches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "Join" not in p
