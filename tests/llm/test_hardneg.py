"""Hard-negative mining against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.llm import hardneg as hn

SCHEMA = "vec_id long, label int, embedding array<float>, class string, rank int, windows int"


def brute(rows, anchors=50, k_pos=5, k_neg=3):
    use = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(s, i):
        return (-s, i is None, i or 0)
    out = []
    for n, (i, label, v) in enumerate(use):
        if i is None or i % anchors:
            continue
        scored = [(dot(v, w), j, m) for k, (j, m, w) in enumerate(use) if k != n]
        pos = sorted([(s, j) for s, j, m in scored if m == label], key=lambda x: order(*x))[:k_pos]
        for p, j in pos:
            neg = sorted([(s, q) for s, q, m in scored if m != label and 50 * p <= 100 * s <= 95 * p],
                         key=lambda x: order(*x))[:k_neg]
            out += [(i, j, r + 1, q, p, s) for r, (s, q) in enumerate(neg)]
    return sorted(out, key=str)


def mined(llm, rows, **kw):
    df = llm.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, **kw)
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                   for r in got.collect()), key=str)


def cloud(seed, n, dims, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(4), [float(np.float32(0.15 * (x + rng.gauss(0, spread)))) for x in c]))
    return rows


@pytest.mark.parametrize("seed,dims,spread,cells", [(1, 16, 0.5, 16_384), (2, 20, 1.5, 60), (3, 3, 0.1, 7)])
def test_equals_brute_force(llm, seed, dims, spread, cells):
    rows = cloud(seed, 700, dims, spread)
    assert mined(llm, rows, cell_anchors=max(2, cells // 8), cell_rows=cells) == brute(rows)


def test_copies_ties_and_odd_rows(llm):
    rows = cloud(5, 200, 8, 0.8)
    same = rows[7][2]
    rows += [(1000 + i, 2, same) for i in range(120)] + [(2000 + i, 3, [x * 0.8 for x in same]) for i in range(60)]
    rows += [(50, 1, rows[50][2]), (50, rows[50][1], rows[50][2]), (None, 1, rows[100][2]), (None, 0, same)]
    rows += [(3000, None, same), (3001, 1, None), (3050, 1, [None] * 8), (3100, 1, [float("nan")] + same[1:]),
             (3150, 1, [float("inf")] * 8), (3200, 1, []), (3250, 2, same[:3]), (3251, 2, [*same, 0.0]), (-50, 1, same)]
    assert mined(llm, rows, cell_anchors=5, cell_rows=40) == brute(rows)


def test_empty_and_without_partners(llm):
    assert mined(llm, []) == []
    assert mined(llm, [(50, 1, [1.0, 2.0])]) == []
    assert mined(llm, [(50, 1, [1.0, 2.0]), (51, 1, [1.0, 2.0])]) == []
    assert mined(llm, [(51, 1, [1.0, 2.0]), (52, 2, [0.7, 1.4])]) == []


def test_index_keeps_every_row_above_the_thresholds():
    rng = np.random.default_rng(1)
    energy = np.sqrt(np.arange(40, 0, -1))
    rows = np.floor(rng.normal(size=(900, 40)) * energy * 20)
    anchors = np.floor(rng.normal(size=(15, 40)) * energy * 20)
    index, norms, score = hn.Index(rows), hn._norms(anchors), anchors @ rows.T
    pruned = 0
    for share in (0.95, 0.8, 0.5, 0.2, 0.0, -1.0):
        low = score.max(axis=1) * share
        found = set(index.candidates(anchors, norms, low).tolist())
        want = set(np.flatnonzero((score >= low[:, None]).any(axis=0)).tolist())
        assert want <= found
        pruned += len(found) < len(rows)
    assert pruned >= 2


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        hn._product(np.full((1, 4), 2.0 ** 40), np.full((1, 4), 2.0 ** 40))
    big = np.array([[2.0 ** 28, 3.0]])
    assert hn._product(big, big).tolist() == [[2 ** 56 + 9]]
