"""Operator 6 on hostile pages: linear time, the same marks as a plain pattern, depth of hidden elements, records read back from files."""

import random
import re
import time

import pytest

from codetables.llm import warc_derive as w
from codetables.llm.common import shared_folder

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?[a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>", re.S)
LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def marks(page):
    p, at, out = w._Page(page), 0, []
    while m := p.mark(at):
        out.append(m)
        at = m[1]
    return out


def test_marks_equal_a_pattern_with_backtracking():
    r = random.Random(2)
    bits = ["<a ", "<b", "</b", ">", '"', "'", " x=", "t", "<!--", "-->", "<!", "<?", "/", "<title>", "</title", "href=", " ", "<html ", "lang=en", "\n", "<A\tHREF = ", "<"]
    for _ in range(20_000):
        page = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        if not re.search(r"<[a-zA-Z/][^\s/>]*[\"']", page):  # a quote in a name: here it belongs to the name
            assert marks(page) == [(m.start(), m.end(), (m[1] or "").lower()) for m in TAG.finditer(page)], page
        assert w.links_of(page) == [next(filter(None, m), "") for m in LINK.findall(page)], page
        title, lang = TITLE.search(page), LANG.search(page)
        assert w.title_of(page) == (title[1].strip() if title else None), page
        assert w.language_of(page) == (lang[1] if lang else None), page


@pytest.mark.parametrize("bit", ['<a title="x ', "<a title='x \" ", "<title>", "<title", "<a ", "<a href=x ", '<a href="', "<!", "<html ", "<html lang ", "<noscript>", "<textarea>", "</a '\"", "<svg>", "<script>", "<!-- ", "<a b='\"", "<head>"])
def test_time_is_linear(bit):
    page = bit * ((1 << 20) // len(bit))
    began = time.process_time()
    w.plain_text(page), w.links_of(page), w.title_of(page), w.language_of(page)
    assert time.process_time() - began < 8


def test_depth():
    assert w.plain_text("<svg><svg></svg>inner</svg>after") == "after"
    assert w.plain_text("a<template>b<template>c</template>d</template>e<svg/>f") == "aef"
    assert w.plain_text("x<svg><SVG/>y</svg>z") == "xz"


def test_records_from_files(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} é" * (i % 7)) for i in range(300)] + [(5, None, None)], "page_id long, url string, html string").repartition(5)
    derived = w.derive(w.responses(pages))
    folder = shared_folder(spark, "warc-test")
    index = w.write_files(derived, folder)
    again = w.read_files(folder, index)
    assert index.count() == 602 and index.select("file").distinct().count() <= 5
    columns = derived.columns
    assert sorted(map(str, again.select(*columns).collect())) == sorted(map(str, derived.collect()))
    assert w.read_files(folder, index.where("false")).count() == 0
