"""An index brought up to date equals a full one after random deltas, and only what they concern is worked on."""

import random

from codetables.plans import index, reindex

SCHEMA = "repo_id string, path string, content string"


def content(rnd, paths):
    names = [p.removesuffix(".py").replace("/", ".") for p in rnd.sample(paths, 3)]
    own = [f"import {names[0]}", f"from .{names[1].split('.')[-1]} import x", f"from ..{names[2]} import (\n    y,\n)", "import os"]
    body = rnd.choice(["def f():\n    pass\n", "class A:\n    def g(self):\n        return '('\n", 'x = """\n', "y = (\n"])
    return "\n".join(rnd.sample(own, rnd.randint(0, 4))) + "\n\n" + body


def rows_of(tables):
    return {k: sorted(map(str, tables[k].select(*sorted(tables[k].columns)).collect())) for k in reindex.TABLES}


def test_five_random_deltas(spark):
    rnd = random.Random(8)
    paths = [f"{a}{b}.py" for a in ("", "a/", "a/b/", "c/") for b in ("m", "n", "o", "__init__", "p")] + ["node_modules/x.py", "a/readme.md"]
    tree = {(r, p): content(rnd, paths) for r in ("one", "two", "three") for p in rnd.sample(paths, 14)}
    frame = lambda t: spark.createDataFrame([(*k, v) for k, v in t.items()], SCHEMA)
    now = reindex.full_index(frame(tree))
    for step in range(5):
        before, tree = dict(tree), dict(tree)
        for key in rnd.sample(list(tree), 3):
            del tree[key]
        for key in rnd.sample(list(tree), 3):
            tree[key] = content(rnd, paths)
        for _ in range(4):
            tree[rnd.choice(["one", "two", "new"] if step else ["one"]), rnd.choice(paths)] = content(rnd, paths)
        if step == 3:
            tree = {k: v for k, v in tree.items() if k[0] != "three"}
        now, report = reindex.reindex(now, frame(before), frame(tree))
        assert rows_of(now) == rows_of(reindex.full_index(frame(tree)))
        changed = [k for k, v in tree.items() if before.get(k) != v and not k[1].startswith("node_modules")]
        assert report["files_scanned"] == len(changed) and report["imports_resolved"] < report["imports"]


def test_nothing_changed_and_empty_snapshots(spark):
    t = spark.createDataFrame([("r", "a.py", "import b\n"), ("r", "b.py", "")], SCHEMA)
    full = reindex.full_index(t)
    same, report = reindex.reindex(full, t, t)
    assert rows_of(same) == rows_of(full) and report == {"files_scanned": 0, "imports_resolved": 0, "files": 2, "imports": 1}
    none, _ = reindex.reindex(full, t, t.where("false"))
    assert all(not rows for rows in rows_of(none).values())
    again, _ = reindex.reindex(none, t.where("false"), t)
    assert rows_of(again) == rows_of(full)


def test_index_with_stored_statements_and_errors(spark):
    t = spark.createDataFrame([("r", "a.py", b"import b\ndef f(\n"), ("r", "b.py", b"")], "repo_id string, path string, content binary")
    out = index.index_repos(t, store=True)
    assert {(r.path, r.parse_error) for r in out["files"].collect()} == {("a.py", "line 2: ( without an end"), ("b.py", None)}
    assert [(r.name, r.start_line) for r in out["symbols"].collect()] == [("f", 2)] and out["edges"].count() == 1
