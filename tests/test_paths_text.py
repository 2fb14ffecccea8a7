"""Path, language and text columns on small cases."""

import pytest
from pyspark.sql import functions as F

from codetables.functions import languages, paths, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_exclusion(spark):
    out = ["node_modules/a.js", "app/dist/x.py", ".git/config", "a/b.pyc", "yarn.lock", "img/Logo.PNG", ".env", "js/app.min.js", "Build/x.py", ".env.example", "src/main.py", "dist"]
    assert column(spark, out, paths.is_excluded) == [True] * 8 + [False] * 4


def test_parts(spark):
    given = ["a/b/c.tar.gz", ".gitignore", "x", "a/.env.example"]
    assert column(spark, given, paths.suffix) == [".gz", "", "", ".example"]
    assert column(spark, given, paths.stem) == ["c.tar", ".gitignore", "x", ".env"]
    assert column(spark, given, paths.directory) == ["a/b", "", "", "a"]


def test_language(spark):
    given = ["a.PY", "Dockerfile", "x/CMakeLists.txt", "a.tsx", "README.md", "k.unknown", ".editorconfig", "a.h"]
    assert column(spark, given, languages.language) == ["Python", "Dockerfile", "CMake", "TypeScript", "Markdown", "Other", "INI", "C"]
    assert column(spark, given, languages.grammar) == ["python", None, None, "tsx", None, None, None, "c"]


def test_containment(spark):
    given = ["a/b.py", "a/../b", "../x", "/etc/passwd", "", ".", "a/..", "a/../../b", None]
    assert column(spark, given, paths.is_contained) == [True, True] + [False] * 7
    assert column(spark, ["a/./b/../c", "../x"], paths.normalised) == ["a/c", None]


@pytest.mark.parametrize(("given", "n"), [("a\nb\n", 2), ("a\r\nb", 2), ("a\rb\r", 2), ("", 0), (None, 0), ("\n", 1), ("a\n\n", 2)])
def test_line_count(spark, given, n):
    assert column(spark, [given], text.line_count) == [n]


def test_clip(spark):
    long, empty, null, short = column(spark, ["x" * 20000, "", None, "abc"], lambda c: text.clip(c, 100))
    assert "19900 characters left out" in long and long.startswith("x" * 100 + "\n")
    assert (empty, null, short) == ("", "", "abc")


def test_json_and_answers(spark):
    given = ['Here: ```json\n{"a": 1}\n``` end', '{"a": 2}', "none", 'so {"a": 3} ok', "[1]"]
    got = column(spark, given, lambda c: F.get_json_object(text.json_object(c), "$.a"))
    assert got == ["1", "2", None, "3", None]
    assert column(spark, ["yes <|end|>", "ok<|tool_calls_begin|>junk", "plain"], text.clean_answer) == ["yes", "ok", "plain"]


def test_highlight_and_ids(spark):
    assert column(spark, ["A cat (x) CAT."], lambda c: text.highlight(c, F.lit("cat (x) a"))) == ["A <mark>cat</mark> <mark>(x)</mark> <mark>CAT</mark>."]
    assert column(spark, [" a, ,b ,"], text.id_list) == [["a", "b"]]


def test_citation(spark):
    df = spark.createDataFrame([("a.py", 1, 2, "function", "f"), ("b.py", 3, 4, None, None)], "p string, s int, e int, k string, n string")
    assert [r[0] for r in df.select(text.citation(*map(F.col, "psekn"))).collect()] == ["a.py:1-2 [function f]", "b.py:3-4"]
