"""The threshold algorithm against a plain ranking of all rows."""

import math

import numpy as np
import pytest

from trajloom.llm import hardneg as h

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, rank int, q string, block int"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, label, 1, 1, "q", 0) for i, e, label in rows], SCHEMA).repartition(parts)


def brute(rows, is_anchor, k=5, low=80):
    """anchor, positive, rank, negative, scores by sorting everything."""
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, label in rows if None not in (i, e, label) and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, label, q in sorted(whole, key=lambda r: (r[1], r[2])):
        if is_anchor(i):
            anchors.setdefault(i, (label, q))
    out = []
    for a, (label, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, z)), i, other) for i, other, z in whole]
        top = sorted((s, i) for s, i, other in scored if other == label and i != a)[:k]
        for s, p in set(top):
            window = sorted((t, i) for t, i, other in scored if other != label and -80 * s <= -100 * t <= -100 * s) if low == 80 else []
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(window[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_rows(seed, n=700, d=9, scale=0.4):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(r.normal(0, scale, d), 3)], int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("block", [40, 8192])
def test_equals_brute_force(spark, block):
    rows = random_rows(1)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(230)]  # a vector that a fourth of all rows share
    df = h.vectors(rows_of(spark, rows))
    found = got(h.hard_negatives(df, df.filter("vec_id % 50 = 0"), block=block))
    assert found == brute(rows, lambda i: i % 50 == 0) and len(found) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.45, 0.5], 2), (2, [0.45, 0.5], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [0.5, 0.5], None)]
    rows += [(None, [1.0, 1.0], 2), (8, [], 1), (8, [], 2), (9, [0.4, 0.5, 0.9], 3), (10, [0.0, 0.0], 1), (11, [0.0, 0.0], 2), (12, [-0.5, -0.5], 1), (100, [0.3], 1), (100, [0.3], 2), (200, [0.0, 0.0], 1), (300, [-0.5, 0.1], 7), (400, [1.0, 0.2], 2)]
    rows += [(50, [0.45, 0.5], 2)] * 40  # repeated rows, more than fit a window
    df = h.vectors(rows_of(spark, rows))
    assert got(h.hard_negatives(df, df.filter("vec_id % 100 = 0"))) == brute(rows, lambda i: i % 100 == 0)
    nothing = h.vectors(rows_of(spark, []))
    assert got(h.hard_negatives(nothing, nothing)) == []
    assert got(h.hard_negatives(df, df.filter("vec_id < 0"))) == []


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 0.5], 1), (2, [3e6, 0.25], 2), (3, [2.9e6, 7.0], 2), (4, [1e3, 0.0], 3)]
    df = h.vectors(rows_of(spark, rows))
    assert got(h.hard_negatives(df, df.filter("vec_id = 0"))) == brute(rows, lambda i: i == 0)


def test_reading_stops_early():
    """Rows far below the threshold are never scored."""
    r = np.random.default_rng(3)
    q = r.integers(-20, 20, (6000, 4))
    q[:30] += 500
    block = h.Lists(np.arange(6000), np.zeros(6000, np.int64), q)
    w = h.Best(5)
    n = h.search(block, 0, np.array([10, 10, 10, 10]), [w], -1)
    assert n < 1000 and w.ids.tolist() == np.lexsort((np.arange(6000), -(q @ np.full(4, 10))))[:5].tolist()
