"""Usage files, vector writes, encoders, cards, change contexts and statistics that no query reaches."""

from codetables import catalog
from codetables.functions import vectors
from codetables.operators import assembly, diffs, explore, observe, scope
from codetables.plans import observe as plan
from codetables.plans import search
from codetables.sources import records, tables
from codetables.streaming import admission, live


def test_usage_read_and_appended(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"model": "m", "input_tokens": 5, "output_tokens": 2, "latency_ms": 1.5, "timestamp": "2024-01-02T03:04:05"}, {"model": "n", "timestamp": "bad"}]')
    u = records.read_usage(spark, str(tmp_path / "u.json"))
    assert [(r.model, r.input_tokens, r.ts and str(r.ts)) for r in u.orderBy("model").collect()] == [("m", 5, "2024-01-02 03:04:05"), ("n", None, None)]
    for _ in range(2):
        records.append_usage(u, str(tmp_path / "usage"))
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 4
    assert records.read_usage(spark, str(tmp_path / "none.json")).count() == 0


def test_repositories(spark):
    p = spark.createDataFrame([('{"id": 1, "name": "a", "full_name": "o/a", "owner": {"login": "o"}}',), ("broken",), (None,)], "payload string")
    rows = [r for r in records.repositories(p).collect() if r.id]
    assert [tuple(r) for r in rows] == [(1, "a", "o/a", False, "main", "", "o")]


def test_vectors_are_checked_before_they_are_written(spark, tmp_path):
    good = search.encode_with(spark.createDataFrame([("r", 1, "ab"), ("r", 2, None)], "repo_id string, chunk_id int, text string"), lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=1)
    assert {r.chunk_id: r.vector for r in good.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    assert tables.write_vectors(good, str(tmp_path), 2) is None and spark.read.parquet(str(tmp_path / "chunk_vectors")).count() == 2
    assert "of another dimension than 3" in tables.write_vectors(good, str(tmp_path / "no"), 3) and not (tmp_path / "no").exists()
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>").select(vectors.cosine_distance("a", "b").alias("d")).first().d
    assert abs(d - 0.04) < 1e-12


def test_symbol_cards_and_change_context(spark):
    found = spark.createDataFrame([(1, "r", "a.py", "function", "f", 3, 9, 2), (1, "r", "a.py", "class", "C", 1, 2, 1), (2, "r", "b.py", "function", "g", 1, 1, 1)], "request_id int, repo_id string, path string, kind string, name string, start_line int, end_line int, rank int")
    chunks = spark.createDataFrame([("r", "a.py", "f", 3, "first"), ("r", "a.py", "f", 5, "second"), ("r", "a.py", "C", 1, "body")], "repo_id string, path string, name string, start_line int, content string")
    cards = {r.request_id: r.card for r in assembly.symbol_cards(found, chunks).collect()}
    assert cards[1].index("class C") < cards[1].index("function f") and "first" in cards[1] and "second" not in cards[1] and 2 in cards
    reports = spark.createDataFrame([("c", [("function", "f")], [("x.py",)], [("t.py",)])], "change_id string, symbols array<struct<kind:string,name:string>>, affected array<struct<path:string>>, tests array<struct<path:string>>")
    patch = "@@ -1,1 +1,50 @@\n" + "\n".join(f"+line {i}" for i in range(50)) + "\n@@ -60 +90 @@\n+b\n@@ -70 +99 @@\n+third"
    hunks = diffs.hunk_lines(diffs.patch_lines(spark.createDataFrame([("c", "a.py", patch)], "change_id string, path string, patch string")))
    text = assembly.change_context(reports, spark.createDataFrame([("c", "Title", "b" * 900)], "change_id string, title string, body string"), hunks).first().context
    assert text.startswith("# Title") and "b" * 800 in text and "b" * 801 not in text and "+line 39" in text and "+line 40" not in text and "third" not in text and "x.py" in text and len(text) <= 8000


def test_observe(spark):
    jobs = spark.createDataFrame([(1, "completed", "2024-01-01 00:00:00", "2024-01-01 00:00:04", 3, None, 1), (2, "failed", None, None, 2, 1, None)], "job_id int, status string, started_at string, finished_at string, files_indexed int, symbols_indexed int, chunks_indexed int")
    usage = spark.createDataFrame([("m", 1_000_000, 2_000_000, 3.0), ("x", 5, 5, 1.0)], "model string, input_tokens long, output_tokens long, latency_ms double")
    out = plan.observe(jobs, usage, observe.price_list(spark, [("m", 0.5, 1.0)]))
    j, u = out["jobs"].first(), out["usage"].first()
    assert (j.total_jobs, j.completed_jobs, j.mean_seconds, j.files_indexed) == (2, 1, 4.0, 5) and (u.calls, u.cost_usd, u.mean_latency_ms) == (2, 2.5, 2.0)
    assert [r.model for r in out["unpriced"].collect()] == ["x"] and {r.model: r.cost_usd for r in out["models"].collect()} == {"m": 2.5, "x": 0.0}


def test_requested_ids_and_appended_rows(spark):
    one = "0e2ff0a4-6b02-4b6e-9d3c-0123456789ab"
    asked = spark.createDataFrame([(1, f" {one} , ,{one},nope"), (2, None), (3, "")], "request_id int, repo_ids string")
    valid, rejected = scope.requested_ids(asked)
    assert [tuple(r) for r in valid.collect()] == [(1, one)] and [tuple(r) for r in rejected.collect()] == [(1, "nope")]
    known = spark.createDataFrame([("p", "r", None), (None, "s", None)], "project string, repo string, created_at timestamp")
    new = spark.createDataFrame([("p", "r"), ("p", "s"), ("p", "s"), (None, "s"), (None, "t")], "project string, repo string")
    rows = {(r.project, r.repo): r.created_at is not None for r in explore.append_rows(known, new, ["project", "repo"]).collect()}
    assert rows == {("p", "r"): False, (None, "s"): False, ("p", "s"): True, (None, "t"): True}


def test_a_repeated_path_keeps_its_last_entry(spark):
    f = spark.createDataFrame([("c", "a", "@@ -1 +1,2 @@\n+x\n+y", 0), ("c", "a", "@@ -1 +5 @@\n+x\n y\n@@ -9 +20 @@\n+z", 1), ("c", "b", None, 2)], "change_id string, path string, patch string, pos int")
    assert [(r.path, [tuple(x) for x in r.ranges]) for r in diffs.ranges_per_file(f).collect()] == [("a", [(5, 5), (20, 20)])]


def test_limits_are_those_of_their_endpoints(spark):
    """Every usual endpoint, and one without a limit of its own, against a plain fold; the stream decides alike."""
    rows = [(1, e, 1_700_000_000 + 7 * k, k) for e in [*admission.LIMITS, "other"] for k in range(60)]
    df = spark.createDataFrame(rows, "user_id long, endpoint string, s long, request_id long").selectExpr("user_id", "endpoint", "timestamp_seconds(s) AS ts", "request_id")
    expected = set()
    for e in [*admission.LIMITS, "other"]:
        most, window = admission.LIMITS.get(e, (3, 30))
        held: list[int] = []
        for _, _, t, k in (r for r in rows if r[1] == e):
            held = [x for x in held if x > t - window]
            ok = len(held) < most
            held += [t] if ok else []
            expected.add((e, k, ok, most - len(held)))
    got = admission.batch(df, 3, 30, admission.LIMITS).collect()
    assert {(r.endpoint, r.request_id, r.allowed, r.remaining) for r in got} == expected


def test_stream_of_keys_that_share_a_group(spark, tmp_path):
    """Two micro-batches, all keys in one group of state: the decisions of the batch, and what has expired is forgotten."""
    rows = [(u, e, 1_700_000_000 + 86_400 * part + 7 * k + u, 1000 * part + 100 * u + k) for part in range(2) for u in range(3) for e in ("chat", "x") for k in range(20)]
    df = spark.createDataFrame(rows, "user_id long, endpoint string, t long, request_id long").selectExpr("user_id", "endpoint", "timestamp_seconds(t) AS ts", "request_id")
    for part in range(2):
        df.where(f"request_id DIV 1000 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(admission.stream(source, 3, 30, "36500 days", {"chat": (4, 60)}, buckets=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema(admission.OUT).parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, admission.batch(df, 3, 30, {"chat": (4, 60)}).collect()))


def test_evidence_makes_vectors_once(spark, monkeypatch):
    """The stated query set is asked, and however many blocks of queries there are, one written table of vectors is searched."""
    written, stored = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: written.append((name, df.columns)) or stored(df, name))
    got = catalog.QUERIES["conversation_evidence"](spark, "/root/testdata/sf0.001").collect()
    assert [r.conv_id for r in got] == [0] and written == [("vectors", ["chunk_id", "vector"])]
