"""Statements, masks and blocks: heads on several lines, code-like text in strings and comments, random nesting, linear time."""

import random
import time

import pytest

from codetables.operators import scan, structure

SOURCES = {
    "py/shop.py": (
        '"""Shop.\n\ndef not_me():\n    pass\n"""\nimport os  # import re\n\ntext = """\nclass NorMe:\n"""\n\n\ndef price(\n    item,\n    taxes=("(", 2),  # )\n):\n    """Price.\n\ndef inner_doc():\n    """\n    return item\n\n\n@login(\n    needed=True,\n)\n@app.route(\n    "/buy", methods=["GET", "POST"]\n)\nasync def buy(\n    item,\n):\n    def check(): return item\n    return check\n\n\n@client.get("/not-a-route")\ndef fetched():\n    pass\n\n\nclass Till:\n    rate = {\n  "a": 1,\n    }\n\n    @property\n    def open(self): return "def x(): {"\n    # a comment at the end\n',
        {("function", "price", 13, 21), ("route", "GET /buy", 24, 34), ("route", "POST /buy", 24, 34), ("function", "check", 33, 33), ("class", "Till", 42, 48), ("method", "open", 48, 48)},
        {("os", False)},
    ),
    "web/list.js": (
        'const s = "}"; // {\nimport {\n  one,\n  two,\n} from "./parts";\nfunction wide(\n  a = "){",\n  b = `}\n  } ${a}`,\n) {\n  /* } */\n  const r = /[}"]/g; // "\n  return { a, b };\n}\nclass Row extends Base {\n  async fill(\n    cells,\n  ) {\n    if (cells) {\n      go("}");\n    }\n  }\n}\nrouter.GET("/rows", (req, res) => {\n  res.send("}");\n});\nrouter.post(\n  \'/rows\',\n  add,\n);\nconst add = async (\n  req,\n) => {\n};\nconst text = "app.get(\'/no\', x)";\nconst two = [require("./a"), require("b")];\n',
        {("function", "wide", 6, 14), ("class", "Row", 15, 23), ("method", "fill", 16, 22), ("route", "GET /rows", 24, 26), ("route", "POST /rows", 27, 30), ("function", "add", 31, 34)},
        {("./parts", True), ("./a", True), ("b", False)},
    ),
    "a/Till.java": (
        'package a;\n\nimport java.util.Map; // import x.Y;\n\n@Deprecated\npublic class Till<T extends Map<String, T>>\n    implements Runnable\n{\n  private final String s = "{"; char c = \'}\';\n\n  public static Map<String, List<Integer>> count(\n      int a,\n      String b)\n      throws Bad\n  {\n    // }\n    if (a > 0) { return null; }\n    return new HashMap<>(a);\n  }\n\n  abstract int size(\n      int a);\n\n  Till(int n) { this.n = n; }\n}\n',
        {("class", "Till", 5, 25), ("method", "count", 11, 19), ("method", "size", 21, 22), ("method", "Till", 24, 24)},
        {("java.util.Map", False)},
    ),
    "c/heap.c": ('#include <stdio.h>\n#include "heap.h" /* { */\n\nstatic int *heap_top(struct heap *h,\n                     int n)\n{\n  char c = \'{\', *s = "\\"}";\n  return 0;\n}\n\nint small(void) { return 1; }\nint declared(int a);\n', {("function", "heap_top", 4, 9), ("function", "small", 11, 11)}, {("<stdio.h>", True), ("heap.h", True)}),
    "c/shape.cpp": ('class Shape : public Base\n{\npublic:\n  int area(\n      int w,\n      int h) const {\n    return w * h; // }\n  }\n};\n\ntemplate <typename T>\nvoid Shape::turn(\n    T by)\n{\n  if (by) { go(by); }\n}\n\nShape::Shape(int w)\n    : Base(w),\n      h(1)\n{\n}\n\nstatic int\nplain(void) {\n}\n', {("class", "Shape", 1, 9), ("method", "area", 4, 8), ("function", "Shape::turn", 12, 16), ("function", "Shape::Shape", 18, 22), ("function", "plain", 24, 26)}, set()),
    "go/main.go": ('package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\nvar words = []string{\n\t"not an import",\n}\n\nfunc Sum(\n\ta int,\n\tb int,\n) int {\n\ts := `}\nfunc no() {`\n\treturn a + b\n}\n\nfunc (p *Person) Name(\n) string {\n\treturn "}"\n}\n', {("function", "Sum", 12, 19), ("method", "Name", 21, 24)}, {("fmt", False), ("math", False)}),
    "rs/lib.rs": ("use crate::{\n    a,\n    b,\n};\n\npub fn longest<'a>(\n    x: &'a str,\n    c: char,\n) -> &'a str {\n    let d = '{';\n    let r = r#\"}\"\n}\"#;\n    x\n}\n\nimpl<T> Shape for Square {\n    fn area(\n        &self,\n    ) -> f64 {\n        1.0 // }\n    }\n}\n\ntrait Named {\n    fn name(&self) -> String;\n}\n", {("function", "longest", 6, 14), ("class", "Square", 16, 22), ("method", "area", 17, 21), ("class", "Named", 24, 26), ("function", "name", 25, 25)}, {("crate", True)}),
    "k/Kite.kt": ('import org.sky.Wind\n\nclass Kite(\n  val n: Int,\n) {\n  fun fly(\n    far: Int,\n  ): Int {\n    val s = """}\n    class No {"""\n    return far\n  }\n}\n', {("class", "Kite", 3, 13), ("method", "fly", 6, 12)}, {("org.sky.Wind", False)}),
    "s/Hill.scala": ('import land.{\n  Slope,\n  Top\n}\n\nobject Hill {\n  def climb(\n    n: Int\n  ): Int = {\n    n // }\n  }\n}\n', {("class", "Hill", 6, 12), ("method", "climb", 7, 11)}, {("land", False)}),
    "p/shop.php": ("<?php\n# {\nfunction pay(\n  $x,\n  $y = '}'\n) {\n  return \"{$x}\n}\";\n}\n", {("function", "pay", 3, 9)}, set()),
    "r/bee.rb": ("require 'json' # require 'no'\n=begin\nclass No\n=end\nclass Bee\n  def hum(\n    loud,\n    long\n  )\n    if loud\n      1\n    end\n  end\n\n  def self.fly?; true; end\nend\n", {("class", "Bee", 5, 16), ("method", "hum", 6, 13), ("method", "fly?", 15, 15)}, {("json", True)}),
    "sh/go.sh": ('# f() {\nrun() {\n  case "$1" in\n    a) echo "}" ;;\n  esac\n  echo ${#x}\n}\nfunction stop\n{\n  exit\n}\n', {("function", "run", 2, 7), ("function", "stop", 8, 11)}, set()),
    "r/fit.R": ("fit <- function(x,\n                y = \"}\") {\n  # }\n  x\n}\n", {("function", "fit", 1, 5)}, set()),
}


@pytest.fixture(scope="module")
def found(spark):
    f = spark.createDataFrame([("r", p, s, "x", 1) for p, (s, _, _) in SOURCES.items()], "repo_id string, path string, content string, code string, line_no int").repartition(4)
    code = structure.statements(f).cache()
    out = {p: (set(), set()) for p in SOURCES}
    for r in structure.symbols_of(code).collect():
        out[r.path][0].add((r.kind, r.name, r.start_line, r.end_line))
    for r in structure.imports_of(code).collect():
        out[r.path][1].add((r.module, r.is_relative))
    errors = {r.path: r.parse_error for r in structure.parse_errors(code).collect()}
    return out, errors


@pytest.mark.parametrize("path", list(SOURCES))
def test_spans_and_imports(found, path):
    assert found[0][path] == SOURCES[path][1:]
    assert path not in found[1]


@pytest.mark.parametrize(
    ("path", "source", "error"),
    [
        ("a.py", "x = (\n", "line 1: ( without an end"), ("a.py", 'x = 1\ny = """\nz\n', "line 2: string without an end"), ("a.c", "int f() {\n/* }\n", "line 2: comment without an end"),
        ("a.java", "class A {\n  )\n}\n", "line 2: unexpected )"), ("a.js", "f(`a\n", "line 1: string without an end"), ("a.py", 'x = """a"""\n', None), ("a.ts", "/**/ const a = `x`;", None), ("a.py", "", None), ("a.py", "# (\n'(' \"[\"\n", None),
    ],
)
def test_what_is_left_open(spark, path, source, error):
    rows = structure.parse_errors(structure.statements(spark.createDataFrame([("r", path, source)], "repo_id string, path string, content string"))).collect()
    assert [r.parse_error for r in rows] == ([error] if error else [])


def nested(rnd, grammar, depth, at, out, expected, inside, counter):
    """Adds a random definition to the lines ``out``; spans go to ``expected``."""
    pad, kind, name = "    " * depth, rnd.choice(["class", "function"]), f"n{next(counter)}"
    start = len(out) + 1
    head = [f"{pad}class {name}" if kind == "class" else f"{pad}def {name}(", f"{pad}    a,", f"{pad})"] if grammar == "python" else [f"{pad}class {name}" if kind == "class" else f"{pad}function {name}(", f'{pad}    a = "{{(",', f"{pad})"]
    if kind == "class":
        head = head[:1]
    head[-1] += ":" if grammar == "python" else " {"
    out.extend(head)
    noise = ['    """', "def no(): {(", '    """', "    # ) class no:"] if grammar == "python" else ["    // } class no {", "    s = '}';", "    /* {", " function no( */", "    t = `", "} `;"]
    for _ in range(rnd.randint(0, 3)):
        if depth < 5 and rnd.random() < 0.6:
            nested(rnd, grammar, depth + 1, at, out, expected, inside or kind == "class", counter)
        else:
            out.extend(noise_line if noise_line.startswith(("def", "}", " f")) else pad + noise_line for noise_line in noise)
    out.append(f"{pad}    x = 1")
    if grammar != "python":
        out.append(pad + "}")
    end = len(out)
    expected.add(("method" if kind == "function" and inside else kind, name, start, end))
    out.extend(rnd.choice([[], [""], ["", f"{pad}# end" if grammar == "python" else f"{pad}// }}"]]))


def test_random_nesting(spark):
    import itertools

    rnd, rows, expected = random.Random(4), [], {}
    for k in range(60):
        grammar, out, spans, counter = rnd.choice(["python", "javascript"]), [], set(), itertools.count()
        for _ in range(rnd.randint(1, 6)):
            nested(rnd, grammar, 0, 0, out, spans, False, counter)
        path = f"f{k}." + ("py" if grammar == "python" else "js")
        rows.append(("r", path, rnd.choice(["\n", "\r\n", "\r"]).join(out)))
        expected[path] = spans
    got = {p: set() for p in expected}
    for r in structure.symbols(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect():
        got[r.path].add((r.kind, r.name, r.start_line, r.end_line))
    assert got == expected


@pytest.mark.parametrize(("body", "grammar"), [("def f(\n    a,\n):\n    return '('\n\n", "python"), ("{\n", "java"), ("(\n", "python"), ("]", "java"), ("(]\n", "c"), ('"""', "python"), ("/* ", "go"), ("`", "typescript"), ("r#\"", "rust"), ("a /", "javascript")])
def test_time_is_linear(body, grammar):
    took = []
    for n in (10_000, 40_000):
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            scan.file_statements(body * n, grammar)
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[1] < 12 * took[0] + 0.2


def test_none(spark):
    f = spark.createDataFrame([("r", "a.txt", "def x(): pass"), ("r", "b.py", None), ("r", "c.py", ""), (None, "d.py", "def y(): pass")], "repo_id string, path string, content string")
    assert [(r.repo_id, r.name) for r in structure.symbols(f).collect()] == [(None, "y")]
    assert structure.symbols(f.where("false")).count() == 0 and structure.imports(f.where("false")).count() == 0
