"""The ten operators on awkward rows against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codetables.llm import bpe_fst, chunks, common, components, embedding_pq, exact_dedup, jaccard_join, langid, packing, sharding, token_files, toxicity, warc_derive

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)] + ["Größe", "naïve", "don't", "it's", "日本語", "🙂", "x\xa0y", "#1,000.5"]
BASE = " ".join(RNG.choice(WORDS) for _ in range(120))
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(" ", "  ")), (4, BASE.replace("w1 ", "q ", 1) + "."), (5, None), (6, ""), (7, " \n\t "),
    (8, "A b"), (9, "a  B"), (10, "one two three four five"), (None, "no id here at all, none"), (None, BASE), (11, " ".join(RNG.choice(WORDS) for _ in range(9000))),
    (12, "\n\n  two\n\n\nlines \n"), (13, "\x1c.\x1c a \x85 b"), (14, "aaaa" * 500), *((20 + i, " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 60)))) for i in range(40)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "h") for i, t in ROWS], "doc_id long, text string, label string, part int, node string").repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def key(r):
    return tuple((x is not None, x) for x in r)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, none):
    path, encode = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    folder, manifest = token_files.write(docs, path, 0)
    got = token_files.read_digests(manifest, folder, token_files.dtype_of(path)).collect()
    start, expected = 0, collections.Counter()
    assert sorted(r.start for r in got) == [sum(x) for x in [[r.n_tokens for r in sorted(got, key=lambda r: r.start)][:k] for k in range(len(got))]]
    for i, t in ROWS:
        ids = [*encode(t), 0]
        expected[i, len(ids), crc(ids)] += 1
        start += len(ids)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda x: (x is not None, x))
    folder, manifest = token_files.write(none, path, 0)
    assert token_files.read_digests(manifest, folder, "<u2").count() == 0


def test_chunked_encoding_equals_library():
    texts = [t or "" for _, t in ROWS] + ["".join(RNG.choice("ab, \n.'é日-1\xa0\t") for _ in range(40)) for _ in range(500)]
    texts += ["".join(RNG.choice("aHIÉİẞ#%&$*, Σσſ\u0301\u0331\u0307KÅ.'S") for _ in range(40)) for _ in range(500)]
    texts += ["".join(RNG.choice("aHIÉİĲŉ#%&$*, ßſÿŸ.'S!\n") for _ in range(40)) for _ in range(500)]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        e, encode = chunks.ChunkEncoder(public_tokenizers.path(name), drops, cache=300), library(name)
        assert e.direct
        for k in range(0, len(texts), 50):
            assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts[k : k + 50])] == [encode(t) for t in texts[k : k + 50]]


def test_added_tokens_as_the_unmodified_library():
    from tokenizers import Tokenizer

    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext|>", "word", " ", "\n", "\x85", "Größe", ". "]
    texts = ["", "a <|endoftext|> b", *("".join(RNG.choice(parts) for _ in range(12)) for _ in range(300)), *("".join(RNG.choice(parts[3:]) for _ in range(12)) for _ in range(300))]
    for name, drops, own in (("byte_bpe_50k.json", False, 50256), ("word_bpe_49k.json", True, 49407)):
        plain, e = Tokenizer.from_file(public_tokenizers.path(name)), chunks.ChunkEncoder(public_tokenizers.path(name), drops)
        got = [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and own in got[1]


def test_packing(docs, none):
    encode = library("word_bpe_49k.json")
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, length=256).collect()
    wanted = collections.Counter((i, tuple([*encode(t), 2])) for i, t in ROWS)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in wanted.items())
    for rows in sequences.values():
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))]
    full = [sum(n for _, n in rows) for _, rows in sorted(sequences.items())]
    assert all(n == 256 for n in full[:-1]) and full[-1] <= 256
    for i, rows in pieces.items():
        if sum(n for (d, _), n in wanted.items() if d == i) == 1:
            ids = [x for r in sorted(rows, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u2").tolist()]
            assert wanted[i, tuple(ids)] == 1
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_packing_keeps_like_documents_together(spark):
    rng = random.Random(8)
    topics = [[f"{chr(97 + k)}{rng.randrange(10**6)}" for _ in range(40)] for k in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4] if rng.random() < 0.8 else topics[0]) for _ in range(120))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 2, 512).collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if not r.start]
    assert len(order) == 400 and sum(a % 4 == b % 4 for a, b in zip(order, order[1:])) > 200  # of random neighbours, 100


def test_hilbert_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def linked(rows, n, num, den=100):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(spark, docs, none, n, num):
    more = []
    for k in range(60):
        w = [RNG.choice(WORDS) for _ in range(RNG.choice([6, 8, 20, 40, 90]))]
        for _ in range(RNG.choice([1, 2, 5])):
            v = list(w)
            for _ in range(RNG.choice([0, 1, 2])):
                v[RNG.randrange(len(v))] = RNG.choice(WORDS)
            more.append((1000 + len(more), " ".join(v)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(map(tuple, jaccard_join.join(both, n, num).collect()), key=key)
    assert got == sorted(linked(ROWS + more, n, num), key=key)
    assert jaccard_join.join(none, n, num).count() == 0


def test_jaccard_join_in_blocks(spark):
    """Large regions of one chain, of several clusters and of copies just below the threshold, in blocks of four."""
    rows = []
    for seed, n, edits in ((1, 40, 1), (2, 30, 3), (3, 30, 6)):
        rng = random.Random(seed)
        base = [f"t{k}" for k in range(60)] if seed > 1 else [f"u{k}" for k in range(60)]
        for i in range(n):
            w = list(base)
            for k in range(edits):
                w[rng.randrange(30)] = f"x{rng.randrange(3 * edits)}"
            rows.append((1000 * seed + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.join(df, 1, 85, block=4).collect()), key=key)
    assert got == sorted(linked(rows, 1, 85), key=key)


def test_jaccard_cells_are_bounded(spark):
    """A region of 3000 members is compared in cells of about two blocks, and all pairs of different labels meet in one."""
    members = spark.range(3000).selectExpr("7L as region", "id as node", "3000L as members", "150000L as weight", "if(id % 3 = 0, 0L, id % 50) as label")
    cells = jaccard_join._grid(jaccard_join._chunked(members, 100), 100).select("cell", "node", "label", "side").collect()
    by = collections.defaultdict(list)
    for r in cells:
        by[r.cell].append(r)
    assert max(map(len, by.values())) <= 300
    met = {(min(x.node, y.node), max(x.node, y.node)) for rows in by.values() for x in rows if x.side == 0 for y in rows if y.side and x.label != y.label}
    label = {r.node: r.label for r in cells}
    assert len(met) == sum(label[i] != label[j] for i in range(3000) for j in range(i))


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (5, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long"), common.Scratch(spark)).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 7: 3}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, none, weak):
    hashed = {"content_hash": F.length} if weak else {}
    got = exact_dedup.mark(docs, **hashed).collect()
    body = lambda t: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[body(t)].append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        (g,) = [g for b, g in groups.items() if hashlib.sha256(b.encode()).hexdigest() == r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(g), min(g)[3])
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    if not weak:
        assert sorted(map(key, exact_dedup.dedup(docs).select("doc_id").collect())) == sorted(key((min(g)[3],)) for g in groups.values())
        assert exact_dedup.mark(none).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, "a" if i % 3 else "b", (base[i % 60] + rng.standard_normal(16) * 0.15).tolist()) for i in range(400)]
    rows += [(i, "a", rows[0][2]) for i in range(400, 430)] + [(500, None, rows[0][2]), (501, "a", None), (502, "a", []), (503, "a", [0.0] * 16), (504, "a", [float("nan")] * 16), (505, "a", [None, 1.0]), (506, "a", [1.0, 2.0]), (507, "a", [2.0, 4.0]), (507, "a", [2.0, 4.0]), (None, "a", [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label string, embedding array<double>, node int")
    got = sorted((tuple(r) for r in embedding_pq.dedup(df, 0.9).collect()), key=lambda r: key(r[:2]))
    fine = [i for i, (_, lab, v) in enumerate(rows) if lab and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for i in fine:
        for j in fine:
            a, b = np.array(rows[i][2]), np.array(rows[j][2])
            if i != j and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                n[i] += 1
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    expected = sorted(((rows[i][0], n[i], least[comp[i]]) for i in range(len(rows))), key=key)
    assert sorted((r[:3] for r in got), key=key) == expected
    assert embedding_pq.dedup(df.where("false")).count() == 0


def test_warc(spark, tmp_path):
    page = "<html lang='de'><head><title>A &amp; B</title><style>p{}</style></head><body><!-- <p>no --><p>One <b>two</b><script>var t='</p>';</script><br>three &lt;4<a href=\"/x?a=1&amp;b=2\" title='>'>link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/\nb", page, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, record string")
    source = warc_derive.responses(pages)
    out = warc_derive.derive(source)
    rows = out.collect()
    assert len(rows) == 8 and {r.record_type for r in rows} == {"metadata", "conversion"}
    (text,) = [r for r in rows if r.source_id == 1 and r.record_type == "conversion"]
    headers, block = warc_derive.parse(bytes(text.record))
    assert block.decode() == "One two\nthree <4link" and text.block_digest == warc_derive.digest(block) and text.content_length == len(block)
    response = {r.source_id: dict(warc_derive.parse(bytes(r.record))[0]) for r in source.collect()}
    for r in rows:
        h = dict(warc_derive.parse(bytes(r.record))[0])
        assert h["WARC-Refers-To"] == r.refers_to == response[r.source_id]["WARC-Record-ID"]
        assert h["WARC-Payload-Digest"] == response[r.source_id]["WARC-Payload-Digest"] and h["WARC-Date"] == response[r.source_id]["WARC-Date"]
    (meta,) = [warc_derive.parse(bytes(r.record))[1] for r in rows if r.source_id == 1 and r.record_type == "metadata"]
    import json

    facts = json.loads(meta)
    assert facts["title"] == "A & B" and facts["links"] == ["/x?a=1&b=2"] and facts["lang"] == "de" and facts["http-headers"]["Content-Type"].startswith("text/html")
    folder = f"file://{tmp_path}/warc"
    index = warc_derive.write_files(out, folder)
    again = warc_derive.read_files(folder, index)
    assert sorted(bytes(r.record) for r in again.collect()) == sorted(bytes(r.record) for r in rows)
    assert warc_derive.derive(source.where("false")).count() == 0


def test_warc_of_a_crawler(spark):
    """Repeated fields, chunked and compressed bodies, field names in other case."""
    import gzip
    import json

    page = "<html lang=fr><title>Été</title><body><a href=/x>mot</a>" + "".join(f"<p>p{i}" for i in range(3000))
    body = page.encode()
    raw = zlib.compressobj(wbits=-15)
    chunked = lambda b: b"".join(b"%x;e=1\r\n%s\r\n" % (len(b[i : i + 999]), b[i : i + 999]) for i in range(0, len(b), 999)) + b"0\r\nX-T: 1\r\n\r\n"
    cases = [
        ("", body), ("Content-Encoding: gzip", gzip.compress(body)), ("content-encoding: X-GZIP", gzip.compress(body[:500]) + gzip.compress(body[500:])), ("Content-Encoding: deflate", zlib.compress(body)),
        ("Content-Encoding: deflate", raw.compress(body) + raw.flush()), ("Transfer-Encoding: chunked", chunked(body)), ("Content-Encoding: gzip\r\nTransfer-Encoding: Chunked", chunked(gzip.compress(body))), ("Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(body))),
        ("Transfer-Encoding: gzip, chunked", chunked(gzip.compress(body))), ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", body), ("Content-Encoding: br", b"\x8b\x02\x80<p>"), ("Content-Type: text/html; charset=undefined", body),
    ]
    rows = []
    for i, (more, sent) in enumerate(cases):
        http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nLink: <u>\r\nSet-Cookie: b=2\r\n" + (more + "\r\n" if more else "").encode() + b"\r\n" + sent
        rows.append((i, bytearray(warc_derive.record([("warc-type" if i % 2 else "WARC-TYPE", "response"), ("WARC-Record-ID", f"<{i}>"), ("WARC-Concurrent-To", "<x>"), ("WARC-Concurrent-To", "<y>")], http))))
    rows += [(90, bytearray(warc_derive.record([("WARC-Type", "request"), ("X-Note", "WARC-Type: response")], b""))), (91, None)]
    out = warc_derive.derive(spark.createDataFrame(rows, "source_id long, record binary")).collect()
    blocks = {(r.source_id, r.record_type): warc_derive.parse(bytes(r.record))[1] for r in out}
    assert len(out) == 2 * len(cases) and len(blocks) == len(out)
    for i in range(len(cases)):
        facts = json.loads(blocks[i, "metadata"])
        assert [v for k, v in facts["http-fields"] if k == "Set-Cookie"] == ["a=1", "b=2"] and [k for k, _ in facts["http-fields"][:3]] == ["Set-Cookie", "Link", "Set-Cookie"]
        assert [v for k, v in facts["warc-fields"] if k == "WARC-Concurrent-To"] == ["<x>", "<y>"]
        if cases[i][0].endswith("br"):
            assert (blocks[i, "conversion"], facts["title"], facts["links"], facts["not-decoded"]) == (b"", None, [], ["br"])
        else:
            assert (facts["title"], facts["lang"], facts["links"], facts["not-decoded"]) == ("Été", "fr", ["/x"], [])
            assert blocks[i, "conversion"].decode() == warc_derive.plain_text(page)
    cut = gzip.compress(body)[:-200]  # a body that the crawler cut off gives what it holds
    got, left = warc_derive.decoded(cut, ["gzip"])
    assert body.startswith(got) and len(got) > 100 and not left


def random_page():
    """A page of random elements, with its text from the way it was put together."""
    page, lines, n = ["<html><head>"], [""], 0
    for _ in range(RNG.randint(0, 3)):
        page.append(RNG.choice(["<title>T <body> t</title>", "<meta charset=utf-8>", "<script>if(a<b){w('</head><p>')}</script>", "<style>p>a{content:'<body>'}</style>", "<noscript><img src=x></noscript>", "<template><p>no</p></template>", "<!-- <body> -->"]))
    page.append(RNG.choice(["</head><body>", "</head>", "<body>", "<body class='a>b'>", ""]))
    for _ in range(RNG.randint(1, 8)):
        n += 1
        kind = RNG.randrange(7)
        if kind == 0:
            page.append(RNG.choice(["<script>for(i=0;i<n;i++){x()}</script>", "<SCRIPT>s='<p>it'</SCRIPT >", "<script><!-- w('<script>a</script>') --></script>", "<style>a<b{}</style>", "<svg><path/></svg>", "<noscript>i<n;</noscript>"]))
        elif kind == 1:
            page.append(f"<textarea>a<b>{n}</textarea>")
            lines[-1] += f"a<b>{n}"
        elif kind == 2:
            page.append(f"<b>b{n}</b>")
            lines[-1] += f"b{n}"
        elif kind == 3:
            page.append(f"plain{n}")
            lines[-1] += f"plain{n}"
        else:
            page.append(f"<p>word{n}</p>")
            lines += [f"word{n}", ""]
    return "".join(page), "\n".join(x for x in lines if x)


def test_plain_text_of_pages_with_script_and_open_head():
    text = warc_derive.plain_text
    assert text("<script>for(i=0;i<n;i++){x()}</script><p>body text</p>") == "body text"
    assert text("<html><head><title>t</title><meta charset=utf-8><body>all of it") == "all of it"
    assert text("<head><title>t</title><p>one<p>two") == "one\ntwo" and text("<head><title>t</title>bare") == "bare"
    assert text("a<noscript><script></noscript>b<script>c") == "ab" and text("<head><template><p>x</p></template><noscript><body>y") == "y"
    for _ in range(2000):
        page, expected = random_page()
        assert text(page) == expected, page


def test_language(spark, docs, none):
    words = {"en": "the of and to in is that", "fr": "le la et les des est que", "de": "der die und das ist nicht ein"}
    rows = [(i, " ".join(RNG.choice(words[k].split()) for _ in range(30)), k) for k in words for i in range(100 * len(k), 100 * len(k) + 60)]
    train = spark.createDataFrame([(i * 10 + n, t, k) for n, (i, t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(train, None)
    got = langid.predict(train, model).join(train, "doc_id").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (5, 6, 7)) and odd[13].lang_pred != "und"
    assert langid.predict(none, model).count() == 0 and langid.accept(none, model).count() == 0
    assert langid.accept(train, model).columns == train.columns and langid.accept(train, model).count() == train.count()
    empty = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


@pytest.mark.parametrize("languages", [5, 70, 130])
def test_language_masks(languages):
    """Masks and corrected shares against plain sets, for one mask word and for several."""
    rng = np.random.default_rng(3)
    texts = {f"l{k:03d}": [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(60)).encode() for _ in range(3)] for k in range(languages)}
    counts = {name: (3, *langid.counted(t * 2)) for name, t in texts.items()}
    model = langid.fit(counts)
    assert model.names == sorted(texts)
    most = collections.defaultdict(float)
    for _, g, rate in counts.values():
        for x, r in zip(g.tolist(), rate.tolist(), strict=True):
            most[x] = max(most[x], r)
    place = lambda x, m: x * m % (1 << 64) >> (64 - langid.SLOT_BITS)
    filters = []
    for name in model.names:
        _, g, rate = counts[name]
        own = [x for x, r in zip(g.tolist(), rate.tolist(), strict=True) if r >= langid.LEAST_SHARE * most[x]]
        filters.append({place(x, m) for x in own for m in langid._MULTIPLIERS[: langid.HASHES]})
    wrong = [(len(f) / (1 << langid.SLOT_BITS)) ** langid.HASHES for f in filters]
    for text in [texts["l000"][0], texts[model.names[-1]][1] * 3, b"entirely other words 123", b"ab"]:
        g = langid.grams(text).tolist()
        hits = [sum(all(place(x, m) in f for m in langid._MULTIPLIERS[: langid.HASHES]) for x in g) for f in filters]
        shares = [min(1, max(0, (h / len(g) - w) / (1 - w))) for h, w in zip(hits, wrong, strict=True)]
        assert np.allclose(model.shares(text), shares)
        total = sum(shares)
        if max(shares) > sorted(shares)[-2]:
            assert model.predict(text) == (model.names[int(np.argmax(shares))], pytest.approx(max(shares) / total))
    unseen = rng.integers(0, 1 << 32, 200_000).astype(np.uint32)
    assert np.allclose(model.hits(unseen) / len(unseen), wrong, atol=0.002)


def test_toxicity(spark, docs, none):
    clean = [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(5, 80))) for _ in range(300)]
    rows = [(i, t + (f" you {RNG.choice(['idiot', 'stupid', 'moron'])} !" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 1)], "doc_id long, toxic int"))
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).join(df, "doc_id").where((F.crc32(F.col("doc_id").cast("string")) % 5) == 0).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    misspelt, fine = model.scores(["w1 w2 you idiott !", "w3 w4 w5"])
    assert misspelt > fine
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.accept(df, model).columns == df.columns
    assert toxicity.score(none, model).count() == 0
    assert 0 < toxicity.train(df.where("false"), labels).scores([""])[0] < 1


def test_shards(docs, none):
    got = sorted(sharding.shard(docs).collect(), key=lambda r: (r.shard, r.slot))
    sizes = [r.size for r in got]
    assert sorted(sizes) == sorted(len((t or "").encode()) + 1 for _, t in ROWS)
    total, before = sum(sizes), 0
    for r in got:
        assert r.shard == before * 8 // total
        before += r.size
    for s in {r.shard for r in got}:
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    assert sharding.shard(none).count() == 0


def test_bpe_transducer(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe_fst.read_ranks(path)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_fst.digests(docs, path, public_tokenizers.PATTERN).collect():
        options = [exact.encode_ordinary(t or "") for i, t in ROWS if i == r.doc_id]
        assert (r.n_tokens, r.ids_sha256) in [(len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for x in options]
        assert r.decoded_sha256 in [hashlib.sha256((t or "").encode()).hexdigest() for i, t in ROWS if i == r.doc_id]
    small = bpe_fst.Transducer(ranks, transitions=50)  # forgets its states again and again
    texts = [bytes(RNG.randrange(256) for _ in range(RNG.randint(0, 30))) for _ in range(300)] + [b"the" * 40, b"=" * 99]
    for t in texts:
        assert small.encode(t) == bpe_fst.merge_by_rank(ranks, t)
    for _ in range(3000):  # borders of tokens against the definition, most of them of parts that merges could cross
        word = RNG.choice([" international", "aaaaaaaa", "====----====", "ationalization", "Größenordnung"]).encode()
        i, j = sorted(RNG.sample(range(len(word) + 1), 2))
        a, b = (RNG.choice([x for x in (w[k:m] for k in range(len(w)) for m in range(k + 1, len(w) + 1)) if x in ranks]) for w in (word[: j or 1], word[i:]))
        assert small._compatible(ranks[a], ranks[b]) == (bpe_fst.merge_by_rank(ranks, a + b) == [ranks[a], ranks[b]])
    usual = bpe_fst.Transducer(ranks)
    for t in texts * 8:  # first by paths, then by transitions
        assert usual.encode(t) == bpe_fst.merge_by_rank(ranks, t)
    assert usual.steps
    long = b"ab" * 3000
    assert small.encode(long) == bpe_fst.merge_by_rank(ranks, long) and len(small.steps) <= 50
    decoder = bpe_fst.Decoder(small.bytes_of)
    for t in ["日本語🙂é" * 5, "plain"]:
        ids = small.encode(t.encode())
        parts = [decoder.feed([i]) for i in ids] + [decoder.close()]
        assert b"".join(parts).decode() == t and all(p.decode() is not None for p in parts)
    assert bpe_fst.decode_ids(bpe_fst.encode_texts(none, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).count() == 0
