"""The pipeline on the smallest tables: each stage keeps the columns and does its whole job."""

import collections
import re

import corpus_pipeline
from codetables.llm import langid, toxicity
from codetables.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.6 * len(before), name
        docs, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == before


def fates(name, rows, docs, labels, tmp):
    """For each row, the set of rows that may stand for it afterwards: itself or nothing, or its group of which one row stays."""
    text = [r["text"] or "" for r in rows]
    if name == "toxicity":
        scores = toxicity.train(docs, labels).scores(text)
        return [{i} if s < 0.5 else set() for i, s in enumerate(scores)]
    if name == "language":
        got = map(langid.train(docs).predict, (t.encode() for t in text))
        return [{i} if lang != "und" and score >= langid.LEAST_SCORE else set() for i, (lang, score) in enumerate(got)]
    last = [(r["doc_id"] is None, r["doc_id"] or 0) for r in rows]
    if name == "exact_dedup":
        groups = collections.defaultdict(list)
        for i, t in enumerate(text):
            groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(i)
        best = {k: min((-len(text[i]), last[i]) for i in g) for k, g in groups.items()}
        return [{j for j in g if (-len(text[j]), last[j]) == best[k]} for k, g in groups.items()]
    sets, words = [], re.compile(r"[^\x20\x09-\x0D]+")
    for t in text:
        w = words.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    same = [(r["doc_id"], r["text"]) for r in rows]
    group = [same.index(x) for x in same]  # of rows equal in both, one stays, with an empty set too
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {g: min(last[i] for i in range(len(rows)) if group[i] == g) for g in group}
    return [{i for i in range(len(rows)) if group[i] == g and last[i] == best[g]} for g in set(group)]


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names, empty tables; against brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = documents(spark, SF)
    names = [*plain.columns, "label", "node", "raw", "kept", "language", "toxicity", "_keep_id"]
    given = [dict(r.asDict(), label="x", node=1, raw="h", kept=True, language="q", toxicity=0.1, _keep_id=None) for r in plain.limit(60).collect()]
    base = " ".join(f"some words number {i} of a longer text" for i in range(40))
    nothing = dict.fromkeys(names)
    texts = [None, "", " \n\t ", base, base, base.replace(" ", "  "), base + " end", base.upper(), "the cat of the house and the dog", base * 30]
    extra = [dict(nothing, doc_id=d, text=t) for k, t in enumerate(texts) for d in (None, 10**9 + k, 10**9 + k)]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema), "label string, node long, raw string, kept boolean, language string, toxicity double, _keep_id long"])
    docs = spark.createDataFrame([tuple(r[c] for c in names) for r in given + extra], schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, None, 1), (1, None, None)], "doc_id long, quality int, toxic int"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        got = collections.Counter(tuple(r) for r in out.collect())
        values = [tuple(r[c] for c in docs.columns) for r in rows]
        groups = fates(name, rows, docs, labels, tmp_path)
        # every row that stays is one of its group, and each group keeps one row
        left = +got
        for g in groups:
            if g:
                mine = next((values[i] for i in g if left[values[i]]), None)
                assert mine is not None, (name, rows[min(g)]["doc_id"])
                left[mine] -= 1
        assert not +left, name
        assert out.columns == docs.columns
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokens = sum(len(encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(p.length for p in pieces) == tokens and sum(p.doc_tokens for p in pieces if p.start == 0) == tokens
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
