"""Hard negatives against all pairs in plain Python, and the intervals against true scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score double, row string"


def brute(rows, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by scoring everything; rows are (id, vector, label)."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda k: (-k[0], k[1] is None, k[1] or 0)
    out = []
    for n, (i, v, lab) in enumerate(ok):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(ok) if m != n]
        for s, j, _ in sorted((x for x in scored if x[2] == lab), key=first)[:positives]:
            fits = sorted((x for x in scored if x[2] != lab and 50 * s <= 100 * x[0] <= 95 * s), key=first)
            out += [(i, j, k, m, s, t) for k, (t, m, _) in enumerate(fits[:negatives], 1)]
    return out


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 0.5, "y") for r in rows], SCHEMA).repartition(3)
    out = hn.mined(df, F.col("vec_id") % 50 == 0, **how).collect()
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out]


def vectors(kind, seed=3, n=260):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.standard_normal((6, 70))
        return [(int(i), (centres[i % 6] + 0.4 * rng.standard_normal(70)).tolist(), int(i % 4)) for i in range(0, 5 * n, 5)]
    if kind == "ties":  # few different vectors, many equal scores, negative ones too
        return [(i, [float(x) for x in rng.integers(-1, 2, 3)], int(rng.integers(0, 3))) for i in range(n)]
    rows = [(i, rng.standard_normal(8).tolist(), int(rng.integers(0, 3))) for i in range(n)]  # rows that take no part, repeated and short ones
    odd = [(50, None, 1), (100, [1.0] * 8, None), (150, [1.0, None] + [1.0] * 6, 1), (200, [float("nan")] * 8, 1), (250, [float("inf")] + [1.0] * 7, 1), (None, None, None)]
    return rows + odd + [(0, rows[0][1], rows[0][2]), (None, rows[7][1], 2), (7, rows[7][1], rows[7][2]), (300, [0.5], 1), (350, [], 2), (301, [2.0, 2.0], 0)]


@pytest.mark.parametrize("kind, how", [("clusters", {}), ("ties", {"anchors": 2}), ("odd", {"planes": 1})])
def test_equals_all_pairs(spark, kind, how):
    rows = vectors(kind)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(brute(rows), key=key)
    assert sorted(mined(spark, rows, **how), key=key) == want and want


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert mined(spark, [(50, [1.0], 0), (2, [1.0], 1)]) == []  # no positive
    assert mined(spark, [(50, [1.0], None), (100, None, 1)]) == []


@pytest.mark.parametrize("d", [1, 5, 64, 130])
@pytest.mark.parametrize("planes", [1, 4])
def test_scores_lie_in_their_intervals(d, planes):
    rng = np.random.default_rng(d)
    x = np.floor(rng.standard_normal((400, d)) * 300 + 40).astype(np.int64)
    x[:20], x[20:30] = x[0], 0
    coder = hn.Coder.of(x.mean(axis=0), 1)
    low, high = hn.Queries(coder, x[:50], planes).intervals(*coder.codes(x), slice(None))
    true = x @ x[:50].T
    assert ((low <= true) & (true <= high)).all()
    assert (high - low).mean() < 4 * np.linalg.norm(x, axis=1).mean() ** 2


def test_few_are_scored():
    """In clusters most candidates' intervals rule them out, and what is found is complete."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64)) * 3
    x = np.floor((centres[np.arange(6000) % 40] + 0.3 * rng.standard_normal((6000, 64))) * 256).astype(np.int64)
    coder = hn.Coder.of(x.mean(axis=0), 0)
    code, align, rest = coder.codes(x)
    label = np.arange(6000) % 40 % 7

    class Part:
        def __init__(self, k):
            at = slice(k, k + 1000)
            self.row = self.id = np.arange(6000)[at]
            self.label, self.vectors, self.code, self.align, self.rest = label[at], x[at], code[at], align[at], rest[at]

    chunk = hn.Chunk(np.arange(0, 6000, 50), label[::50], x[::50], hn.Queries(coder, x[::50]))
    best, scored = hn.nearest(chunk, (Part(k) for k in range(0, 6000, 1000)), 5)
    same = sum(int((label == v).sum()) for v in chunk.label)
    assert scored < 0.35 * same
    true = (x @ x[::50].T).astype(float)
    true[(label[:, None] != chunk.label) | (np.arange(6000)[:, None] == chunk.row)] = -np.inf
    assert best.held[1].reshape(-1, 5).tolist() == np.sort(true, axis=0)[::-1][:5].T.astype(np.int64).tolist()
