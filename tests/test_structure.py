"""Symbols, routes, imports and their resolution on small sources."""

import pytest

from codetables.operators import resolve, structure

LEDGER = """import csv, json
from decimal import Decimal as D
from . import rates
from .. import clock
from ledger.money import (
    Euro,
)


class Account(Base):
    limit = 3

    @property
    def balance(self):
        if self.rows:
            return sum(self.rows)

        return 0

    class Note:
        def text(self):
            return ""


def transfer(source,
             target):
    # a comment at the left
    def check():
        return source

    return check()


@router.delete("/accounts/{number}")
@logged
def close_account(number):
    return number


@bp.route("/month", methods=["PUT"])
async def month():
    return 1


@cached(3)
def rate(day): return day
"""
QUEUE = """import zlib from 'zlib';
import * as clock from "../clock";
export { Slot } from './slot';
const fs = require("fs");

export default class Queue<T> {
  private rows: T[] = [];

  push(row: T): void {
    if (row) {
      this.rows.push(row);
    }
  }
}

interface Ticket {
  id: string;
}

export const drain = async (q: Queue<number>) => {
  await q.flush();
};

router.patch('/slots/:slot', (request, reply) => reply.send({}));
"""
TREE = """package tree

import (
	"fmt"
	alias "example.org/forest/leaf"
)

type Walker interface {
	Next() bool
}

func (w *cursor) Next() bool {
	if w.at > 3 {
		return false
	}
	return true
}

func depth(n int) int { return n }
"""
HEAP = """#include <stdio.h>
#include "pile/heap.h"

struct heap {
  int n;
};

static int *heap_top(struct heap *h)
{
  return &h->n;
}
"""
SHAPE = """use super::area::{Square, Round};
use std::fmt;

pub struct Shape {
    side: u32,
}

impl Shape {
    pub fn grow(&mut self) {
        self.side += 1;
    }
}
"""
#: path -> source; expected imports of each as (module, is_relative)
OTHERS = {
    "a/Boat.java": ("package a;\nimport java.util.List;\nimport static org.sea.Port.open;\n\nclass Boat {\n  void sail() {\n  }\n}\n", {("java.util.List", False), ("org.sea.Port.open", False)}),
    "a/Kite.kt": ("import org.sky.Wind\nimport org.sky.Tail as T\n\nclass Kite {\n  fun fly() {\n  }\n}\n", {("org.sky.Wind", False), ("org.sky.Tail", False)}),
    "a/Hill.scala": ("import land.Slope\n\nclass Hill {\n}\n", {("land.Slope", False)}),
    "a/shop.php": ("<?php\nuse Shop\\Till;\n\nfunction pay($x) {\n  return $x;\n}\n", {("Shop\\Till", False)}),
    "a/bee.rb": ("require 'json'\nrequire_relative 'hive/comb'\n\nclass Bee\n  def hum\n    1\n  end\nend\n", {("json", True), ("hive/comb", True)}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = {"ledger/book.py": LEDGER, "web/queue.ts": QUEUE, "tree.go": TREE, "pile/heap.c": HEAP, "geo/shape.rs": SHAPE, "plain.txt": "def no(): pass\n", "blank.py": " \n", "none.py": None, **{p: c for p, (c, _) in OTHERS.items()}}
    f = spark.createDataFrame([("r", p, c) for p, c in rows.items()], "repo_id string, path string, content string")
    out: dict = {"imports": {}}
    for r in structure.symbols(f).collect():
        out.setdefault(r.path, {})[r.name] = (r.kind, r.start_line, r.end_line)
    for r in structure.imports(f).collect():
        out["imports"].setdefault(r.path, set()).add((r.module, r.is_relative))
    return out


def test_python(found):
    s = found["ledger/book.py"]
    assert s["Account"] == ("class", 10, 22) and s["balance"][0] == "method" and s["text"][0] == "method"
    assert s["transfer"][0] == "function" and s["transfer"][1] == 25 and s["transfer"][2] >= 31
    assert s["DELETE /accounts/{number}"][0] == "route" and "close_account" not in s and "PUT /month" in s and "month" not in s
    assert s["rate"][0] == "function"
    assert {("decimal", False), (".rates", True), ("..clock", True), ("ledger.money", False), ("csv", False)} <= found["imports"]["ledger/book.py"]


def test_typescript(found):
    s = found["web/queue.ts"]
    assert s["Queue"] == ("class", 6, 14) and s["push"] == ("method", 9, 13) and s["drain"] == ("function", 20, 22)
    assert s["PATCH /slots/:slot"][0] == "route" and "request" not in s
    assert {("zlib", False), ("../clock", True)} <= found["imports"]["web/queue.ts"]


def test_others(found):
    assert found["tree.go"]["Walker"] == ("class", 8, 10) and found["tree.go"]["Next"] == ("method", 12, 17) and found["tree.go"]["depth"] == ("function", 19, 19)
    assert found["imports"]["tree.go"] == {("fmt", False), ("example.org/forest/leaf", False)}
    assert found["pile/heap.c"]["heap_top"][0] == "function"
    assert {m for m, _ in found["imports"]["pile/heap.c"]} == {"<stdio.h>", "pile/heap.h"}
    assert found["geo/shape.rs"]["Shape"][0] == "class" and "grow" in found["geo/shape.rs"]
    assert any(m.startswith("super::area") for m, _ in found["imports"]["geo/shape.rs"])
    assert "plain.txt" not in found and "blank.py" not in found


@pytest.mark.parametrize("path", list(OTHERS))
def test_imports_of_other_grammars(found, path):
    assert found["imports"][path] == OTHERS[path][1]
    assert path in found


@pytest.mark.parametrize(
    ("grammar", "path", "module", "manifest", "expected"),
    [
        ("python", "app/main.py", "app.models", ["app/models.py"], "app/models.py"),
        ("python", "backend/app/main.py", "app.models", ["backend/app/models/__init__.py"], "backend/app/models/__init__.py"),
        ("python", "app/a/b.py", "..common", ["app/common.py"], "app/common.py"),
        ("python", "app/a/b.py", ".local", ["app/a/local.py", "local.py"], "app/a/local.py"),
        ("python", "app/a/b.py", ".gone", ["app/a/__init__.py"], "app/a/__init__.py"),
        ("python", "app/main.py", "os", ["app/x.py"], None),
        ("typescript", "src/a/b.ts", "./c", ["src/a/c/index.ts", "src/a/c.ts"], "src/a/c.ts"),
        ("typescript", "src/a/b.ts", "../types", ["src/types.ts"], "src/types.ts"),
        ("tsx", "src/a.tsx", "@/lib/x", ["lib/x.tsx"], "lib/x.tsx"),
        ("javascript", "a.js", "react", ["react.js"], None),
        ("java", "A.java", "com.x.Y", ["com/x/Y.java"], "com/x/Y.java"),
        ("c", "src/m.c", "local.h", ["local.h", "src/local.h"], "src/local.h"),
        ("rust", "main.rs", "crate::a::b", ["a/b/mod.rs"], "a/b/mod.rs"),
        ("ruby", "lib/a.rb", "b", ["lib/b.rb"], "lib/b.rb"),
    ],
)
def test_resolution(spark, grammar, path, module, manifest, expected):
    i = spark.createDataFrame([("r", path, grammar, module, False)], "repo_id string, path string, grammar string, module string, is_relative boolean")
    m = spark.createDataFrame([("r", p) for p in manifest], "repo_id string, path string")
    assert [r.resolved_path for r in resolve.resolve(i, m).collect()] == [expected]
