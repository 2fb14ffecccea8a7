"""Operator 3's rows of packed n-grams come back as they went in."""

import numpy as np

from codetables.llm import jaccard_join


def test_packed_and_unpacked():
    r = np.random.default_rng(4)
    for n, nodes, parts in ((0, 3, 3), (1, 1, 1), (3000, 4, 2), (5000, 3000, 7), (1000, 1, 1), (510, 2, 1)):
        part, node = r.integers(0, parts, n), r.integers(-(1 << 62), 1 << 62, nodes)[r.integers(0, nodes, n)]
        key, kind = r.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4"), r.integers(0, 255, n).astype(np.uint8)
        if n > 1:
            assert sum(1 for _ in jaccard_join._packed(part, node, key, kind)) == len(np.unique(part))
        got = [(p, *row) for p, data in jaccard_join._packed(part, node, key, kind) if n for row in zip(*(c.tolist() for c in jaccard_join._unpacked(data, "<u4", "u1")), strict=True)]
        assert sorted(got) == sorted(zip(part.tolist(), node.tolist(), key.tolist(), kind.tolist(), strict=True))
