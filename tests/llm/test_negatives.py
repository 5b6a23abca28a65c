"""Hard negatives against all products, the recursion against the plain product."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import negatives as N


@pytest.mark.parametrize("shape", [(0, 3, 2), (1, 1, 1), (33, 40, 65), (64, 64, 64), (71, 130, 99), (2, 500, 3)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    for size in (1 << 8, 1 << 30):
        a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (k, n))
        assert (N.strassen(a, b, 4) == a @ b).all() and (N.strassen(a, b) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    slot, score, ident = rng.integers(0, 9, 400), rng.integers(-3, 4, 400), rng.permutation(400)
    one, two = N.Heaps(9, 5), N.Heaps(9, 5)
    one.add(slot, score, ident)
    for at in rng.permutation(400).reshape(-1, 40):
        two.add(slot[at], score[at], ident[at])
    assert (one.score == two.score).all() and (one.id == two.id).all()


def brute(rows):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (anchor, label, v) in enumerate(good):
        if anchor % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i, lab) for m, (i, lab, w) in enumerate(good) if m != n)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(anchor, i, r, s[1], -p, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, _row string, rank int").repartition(4)
    return sorted(tuple(r) for r in N.hard_negatives(N.integer_vectors(df), F.expr("vec_id % 50 = 0"), **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dims=24, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    return [(i, (centre + rng.normal(size=dims)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"anchors_per_block": 3}])
def test_equals_all_products(spark, options):
    rows = vectors(2, 700)
    same = rows[5][1]
    rows += [(1000 + i, same, i % 3) for i in range(200)]  # a group of equal vectors, with anchors in it
    want = brute(rows)
    assert found(spark, rows, **options) == want and len(want) > 50


def test_tiles_of_any_size(spark, monkeypatch):
    rows = vectors(3, 300, dims=70)
    for name in ("TILE_ANCHORS", "TILE_ROWS", "LEAF"):
        monkeypatch.setattr(N, name, 7)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(4, 120, dims=6)
    rows += [(50, rows[3][1], 2), (50, rows[3][1], 2), (None, rows[3][1], 1), (200, None, 1), (250, [], 1), (300, [1.0], 1), (350, [0.5] * 9, 3),
             (400, [float("nan")] * 6, 1), (401, [None, 1.0], 1), (402, [float("inf")], 2), (403, [1.0] * 6, None), (450, [-x for x in rows[0][1]], 0)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(50, [1.0], 1)], [(50, None, None)], [(50, [1.0], 1), (51, [1.0], 2)]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == []
