"""Operator 13 against a parse of one text at a time, and what its phrases promise."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from codetables.llm import fingerprints as fp

M = (1 << 64) - 1
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(RNG.randint(2, 9))) for _ in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


TEXTS = ["", "x", "ab", "aa", "a" * 1000 + "b", "ab" * 300, "line one\n" * 50, prose(3, 1), prose(60, 2), prose(400, 3), "日本語🙂 " * 40, "퟿\U0010ffff", prose(5000, 4)]


def mix(x):
    x = (x ^ x >> 30) * int(fp._M1) & M
    x = (x ^ x >> 27) * int(fp._M2) & M
    return x ^ x >> 31


def toss(a, b):
    low = ((a ^ b) & -(a ^ b)).bit_length() - 1
    return 2 * low + (b >> low & 1)


def parse(text):
    """Levels of one text as lists of (name, length)."""
    x, out = [(mix(ord(c) + 1), 1) for c in text], []
    while x:
        runs = []
        for name, n in x:
            if runs and runs[-1][0] == name:
                runs[-1] = (name, runs[-1][1] + n, runs[-1][2] + 1)
            else:
                runs.append((name, n, 1))
        x = [(name if k == 1 else mix((name + k * int(fp._STEP)) & M), n) for name, n, k in runs]
        labels = [x[0][0] & 1] + [toss(a[0], b[0]) for a, b in zip(x, x[1:], strict=False)]
        for _ in range(fp.ROUNDS):
            labels = [labels[0] & 1] + [toss(a, b) for a, b in zip(labels, labels[1:], strict=False)]
        begins = [k for k in range(len(x)) if k == 0 or (1 < k < len(x) - 1 and labels[k - 1] < labels[k] > labels[k + 1])]
        joined = []
        for i, j in zip(begins, [*begins[1:], len(x)], strict=True):
            value = sum(x[k][0] * pow(int(fp._STEP), k - i, 1 << 64) for k in range(i, j))
            name = x[i][0] if j == i + 1 else mix((value + (j - i + (len(out) + 1 << 32)) * int(fp._M2)) & M)
            joined.append((name, sum(n for _, n in x[i:j])))
        x = joined
        out.append(x)
        if len(x) == 1:
            break
    return out


def sketch(text):
    """Fingerprint of one text."""
    slots = {}
    for level, x in enumerate(parse(text), 1):
        seen = {}
        for name, _ in x:
            seen[name] = seen.get(name, -1) + 1
            v = mix((name + (seen[name] if level >= fp.COUNTED else 0) * int(fp._M2)) & M ^ int(fp._STEP))
            slot, v = (v >> 57) % fp.SLOTS, v << 7 & M
            slots[slot] = min(slots.get(slot, v), v)
    if not slots:
        return bytes(fp.SLOTS)
    out = []
    for k in range(fp.SLOTS):
        far = next(d for d in range(fp.SLOTS) if (k + d) % fp.SLOTS in slots)
        out.append(mix((slots[(k + far) % fp.SLOTS] + far * int(fp._STEP)) & M) & 255)
    return bytes(out)


def test_levels_and_sketches():
    got = [[] for _ in TEXTS]
    for _, x, start, borders in fp.levels(TEXTS):
        ends = np.append(start[1:], sum(map(len, TEXTS)))
        for k in range(len(TEXTS)):
            i, j = borders[k], borders[k + 1]
            got[k].append(list(zip(x[i:j].tolist(), (ends[i:j] - start[i:j]).tolist(), strict=True)))
    for text, mine in zip(TEXTS, got, strict=True):
        expected = parse(text)
        assert mine[: len(expected)] == expected
        assert all(m == (expected[-1] if expected else []) for m in mine[len(expected) :])
    assert [s.tobytes() for s in fp.sketches(TEXTS)] == [sketch(t) for t in TEXTS]


def test_blocks_are_short_and_equal_substrings_share_their_interior():
    passage = prose(300, 7)
    a, b = prose(50, 8) + passage + prose(20, 9), prose(91, 10) + passage + prose(77, 11)
    for level, (x, y) in enumerate(zip(parse(a), parse(b), strict=False), 1):
        if level > 4:
            break
        inside = []
        for text, phrases in ((a, x), (b, y)):
            at, found, begin = 0, set(), text.index(passage)
            margin = 16 * 3**level
            for name, n in phrases:
                if at >= begin + margin and at + n <= begin + len(passage) - margin:
                    found.add((at - begin, n, name))
                at += n
            inside.append(found)
        assert inside[0] == inside[1] and (level > 3 or inside[0])
        assert max(n for _, n in x) <= 16**level


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, None), (None, "no id"), (None, None), (40, TEXTS[8]), (41, TEXTS[8]), (41, TEXTS[8]), (99, prose(80, 12))]
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, following string, part int").repartition(6).cache()


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text or "", r.h) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    expected = []
    for (i, t, _), (_, f, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + f[:q]
        a, b, c = (np.frombuffer(sketch(v), np.uint8) for v in (t, e, f))
        near = [min(1.0, max(0.0, (float((a == v).mean()) - 1 / 256) / (1 - 1 / 256))) for v in (b, c)]
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), *(round(v, 9) for v in near)))
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.with_next(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert fp.with_next(docs.where("false")).count() == 0
    one = fp.with_next(docs.where("doc_id = 99")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0  # its own next
    alone = {(r.doc_id, r.fingerprint) for r in fp.fingerprints(docs).collect()}
    assert alone == {(e[0], e[3]) for e in expected}


def test_phrases_are_the_text(docs):
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id >= 7 AND doc_id <> 41").collect()}
    named: dict = {}
    for r in fp.phrases(docs.where("doc_id >= 7 AND doc_id <> 41")).collect():
        part = texts[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length
        assert named.setdefault((r.level, r.name), part) == part  # equal names are equal substrings


def test_likeness():
    near, far = [], []
    for k in range(40):
        t, f = prose(RNG.randint(20, 900), 100 + k), prose(300, 500 + k)
        e = fp.edited([t], [f])[0]
        m = fp.sketches([t, e, f])
        near.append(fp.likeness(m[:1], m[1:2])[0])
        far.append(fp.likeness(m[:1], m[2:])[0])
        assert fp.fingerprint_of(t) == m[0].tobytes().hex()
    assert min(near) > 0.3 and max(far) < min(near)
    assert zlib.crc32(fp.sketches([TEXTS[9]]).tobytes()) == zlib.crc32(fp.sketches([TEXTS[9], "x"])[:1].tobytes())
