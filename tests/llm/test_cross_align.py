"""Operator 11 against the libraries and all pairs of overlapping tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from codetables.llm import chunks, common, cross_align

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
R = random.Random(3)
ODD = ["<|endoftext|> x <s> </s>", " ", "  ", "\n", "\n\n ", "a ", " a", "a  \n b", "", None, "x\xa0y", "a\x00b", "the " * 50, "a" * 300, "ab,cd.ef 1234567890,5", "\r\nx\r\n  y'\r\n", "▁ a▁b", "日本語🙂 é́", "x" * 20 + "ﬁ"]
MADE = ["".join(R.choice("aHIÉİĲŉ#%&$*, ßſÿŸ.'S!\n \t\r<s>日本🙂") for _ in range(R.randint(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    inv = {c: b for b, c in chunks.byte_letters().items()}

    def of(text):
        """(n_a, n_b, groups as text, links)"""
        none = (0, 0, "", [])
        if not text:
            return none
        a, b = t.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(inv[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            return none
        x, y = (np.cumsum([0, *(len(v) for v in s)]).tolist() for s in (bytes_a, bytes_b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(x) & set(y))[1:]:
            k, m = x.index(cut), y.index(cut)
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if x[i] < y[j + 1] and y[j] < x[i + 1]]
        return len(a), len(b), ";".join(groups), links

    return of


def test_documents(spark, brute):
    rows = list(enumerate(ODD + MADE)) + [(3, "again"), (None, "no id"), (None, None), (5, "again")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, block int, pair string").repartition(5)
    known = [(i, *brute(t)) for i, t in rows]
    counts = collections.Counter(link for r in known for link in r[4])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    expected = sorted(str((i, a, b, len(g.split(";")) if g else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")) for i, a, b, g, links in known)
    scratch = common.Scratch(spark)
    aligned = scratch.written(cross_align.align(docs, BYTE, PIECE), "aligned")
    assert sorted(str(tuple(r)) for r in cross_align.scores(aligned, scratch).collect()) == expected
    assert {(r.pair >> 32, r.pair & (1 << 32) - 1): (r.total, r.best) for r in cross_align.pair_counts(aligned).collect()} == {k: (n, n == best[k[1]]) for k, n in counts.items()}
    shown = cross_align.align(docs, BYTE, PIECE, keep_groups=True).where("kind = 1").select("doc_id", "groups").collect()
    assert sorted(str(tuple(r)) for r in shown) == sorted(str((i, g)) for i, _, _, g, _ in known)
    empty = scratch.written(cross_align.align(docs.where("false"), BYTE, PIECE), "aligned")
    assert cross_align.scores(empty, scratch).count() == 0
    scratch.clear()


def test_small_blocks_and_hot_pairs(spark, brute, monkeypatch):
    """Blocks of a few documents; every pair is in many blocks, so totals come by the broadcast of heavy keys."""
    monkeypatch.setattr(common, "HEAVY", 3)
    texts = [f"the same words again {k % 7}, and again" for k in range(60)]
    scratch = common.Scratch(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30)
    got = cross_align.scores(scratch.written(cross_align.align(docs, BYTE, PIECE), "aligned"), scratch).collect()
    scratch.clear()
    counts = collections.Counter(link for t in texts for link in brute(t)[3])
    assert {r.doc_id: r.count_sum for r in got} == {i: sum(counts[x] for x in brute(t)[3]) for i, t in enumerate(texts)}


def test_shared_cuts_equal_the_intersection():
    r = np.random.default_rng(1)
    for n, p in ((1, 0.5), (2, 0.9), (30, 0.4), (500, 0.1), (500, 0.5), (3000, 0.02)):
        for _ in range(40):
            length = n + 1
            x, y = (np.flatnonzero(np.append(np.insert(r.random(length - 1) < q, 0, True), True)) for q in (p, r.random()))
            both = np.intersect1d(x, y)
            docs = np.unique(np.concatenate([both[:1], both[-1:], r.choice(both, min(3, len(both)))]))
            cx, cy = cross_align.shared_cuts(x, y, np.searchsorted(x, docs), np.searchsorted(y, docs))
            assert x[cx].tolist() == y[cy].tolist() == both[1:].tolist()


def test_pieces_equal_the_library():
    import sentencepiece

    sp, e = sentencepiece.SentencePieceProcessor(model_file=PIECE), cross_align.PieceEncoder(PIECE, cache=200)
    assert e.safe
    texts = [t for t in ODD + MADE if t and "▁" not in t]
    for k in range(0, len(texts), 40):
        part = [f" {t}" for t in texts[k : k + 40]]
        cut = [chunks.PIECES.findall(t) if e.can_cut(t) else None for t in part]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_cut(part, cut)] == [sp.encode(t[1:]) for t in part]
