"""Operator 3 keeps the sets of large regions apart: rounds that divide these read no others."""

from codetables.llm import jaccard_join
from codetables.llm.common import Scratch


def test_only_sets_of_large_regions_are_written(spark, monkeypatch):
    near = lambda name, n: [" ".join(f"{name}{i}" for i in range(40 + k)) for k in range(n)]
    groups = [near("large", 7), *(near(f"g{k}_", 2) for k in range(30))]
    rows, expected = [], {}
    for texts in groups:
        first = len(rows)
        for t in texts:
            expected[len(rows)] = first
            rows.append((len(rows), t))
    written, before = {}, Scratch.written

    def spied(self, df, name):
        out = before(self, df, name)
        if name == "sets":
            written[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "written", spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, n=4, num=80, block=4).collect()}
    assert got == expected and written["sets"] == 7

    written.clear()
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, n=4, num=80).collect()}
    assert got == expected and not written  # without a large region no set is written
