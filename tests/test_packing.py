"""Greedy packing against a plain loop, and in time linear in the blocks of one file."""

import random
import time

from codetables.operators import chunks, structure


def test_packed_equals_a_loop(spark):
    r, rows, expected = random.Random(5), [], []
    for repo, path, n in [("a", "x", 400), ("a", "y", 1), ("b", "x", 90), (None, "x", 30), ("b", None, 3)]:
        at, spans = 1, []
        for _ in range(n):
            start = at + r.randint(1, 9)
            at = start + r.choice([0, 3, 20, 150])
            rows.append((repo, path, start, at))
            if spans and at - spans[-1][2] + 1 <= 120:
                spans[-1] = (repo, path, spans[-1][2], at)
            else:
                spans.append((repo, path, start, at))
            at += 1
        expected += spans
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "repo_id string, path string, start_line int, end_line int").repartition(5)
    assert sorted(map(tuple, chunks.packed(df).collect()), key=str) == sorted(expected, key=str)
    assert chunks.packed(df.where("false")).count() == 0


def test_a_file_of_many_blocks(spark):
    took = []
    for n in (100_000, 400_000):
        df = spark.range(n).selectExpr("'r' AS repo_id", "'p' AS path", "CAST(id * 3 + 1 AS INT) AS start_line", "CAST(id * 3 + 2 AS INT) AS end_line")
        began = time.time()
        assert chunks.packed(df).count() == -(-n // 40)  # 40 blocks span 119 lines
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 5


def plan_nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from plan_nodes(children.apply(i))


def test_sources_are_read_once(spark):
    """Of equal spans none holds the other, and neither sources nor texts pass through the plan twice."""
    spans = [("a", 1, 9), ("b", 1, 9), ("c", 2, 9), ("d", 3, 4), ("d", 3, 4), ("e", 8, 12), ("f", 10, 12), ("g", 13, 13)]
    df = spark.createDataFrame([("r", "p.py", "function", *s) for s in spans], "repo_id string, path string, kind string, name string, start_line int, end_line int")
    assert sorted(r.name for r in chunks.top_level(df).collect()) == ["a", "b", "e", "g"]
    code = "class A:\n    def f(self):\n        pass\n\ndef g():\n    pass\n"
    files = spark.createDataFrame([("r", "m.py", "Python", code), ("r", "x.md", "Markdown", "# a\nb\n"), ("r", "y.md", "Markdown", "b\n\nc\n"), ("r", "e.py", "Python", " \n\n")], "repo_id string, path string, language string, content string")
    symbols = structure.symbols(files)
    nodes = list(plan_nodes(chunks.top_level(symbols)._jdf.queryExecution().optimizedPlan()))
    assert sum(n.nodeName() == "MapInArrow" for n in nodes) == 1
    for n in nodes:
        if n.nodeName() == "Window":  # what is sorted carries no text of statements
            assert not {"raw", "code"} & {n.child().output().apply(i).name() for i in range(n.child().output().size())}
    got = chunks.chunk_files(files, symbols.drop("grammar")).orderBy("path", "start_line").collect()
    assert [(r.path, r.start_line, r.end_line, r.content) for r in got] == [("m.py", 1, 3, code[: code.index("\n\n")]), ("m.py", 5, 6, "def g():\n    pass"), ("x.md", 1, 2, "# a\nb"), ("y.md", 1, 3, "b\n\nc")]
