import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from siftline.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, rank int"


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90):
    """All scores; of rows that share an id the least by (label, vector)."""
    best = {}
    for i, e, label, *_ in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        best[i] = min(best.get(i, (label, e)), (label, e))
    v = {i: (label, [min(max(math.floor(min(max(256 * x, -1e300), 1e300)), -H.LARGEST), H.LARGEST) for x in e]) for i, (label, e) in best.items()}
    score = lambda a, b: sum(x * y for x, y in zip(v[a][1], v[b][1]))
    out = []
    for a in v:
        if a % every:
            continue
        ranked = sorted((-score(a, b), b) for b in v if b != a)
        for s, p in [(-s, b) for s, b in ranked if v[b][0] == v[a][0]][:positives]:
            inside = [(b, -t) for t, b in ranked if v[b][0] != v[a][0] and low * s <= 100 * -t <= high * s]
            out += [(a, p, k + 1, b, s, t) for k, (b, t) in enumerate(inside[:negatives])]
    return sorted(out)


def found(spark, rows, every=10, parts=3, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect())


def clusters(rnd, n, dims, labels=4):
    centres = [[rnd.gauss(0, 0.2) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("dims,labels", [(1, 2), (3, 3), (24, 4)])
def test_against_all_scores(spark, dims, labels):
    rows = clusters(random.Random(dims), 300, dims, labels)
    want = brute(rows)
    assert want
    assert found(spark, rows) == want


def test_repeats_ties_nulls_and_odd_vectors(spark):
    rnd = random.Random(7)
    rows = clusters(rnd, 200, 6)
    same = rows[3][1]
    rows += [(1000 + i, same, i % 3) for i in range(90)]  # a third of all rows are one vector
    rows += [(2000, None, 1), (2010, [], 1), (2020, [None, 1.0], 0), (2030, [math.nan] * 6, 0), (2040, [math.inf] * 6, 1), (2050, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [(2060, [0.5, 0.5], 1), (2070, [0.1] * 9, 2), (2080, [0.0] * 6, 1), (2090, [1e300, -1e300], 1), (2100, [1e30] * 6, 0), (2110, [-0.3] * 6, 2)]
    rows += [rows[0], rows[0], (10, [0.9] * 6, 0), (10, [0.2] * 6, 3), (20, [math.nan], 0)]
    want = brute(rows)
    assert {r[0] for r in want} >= {1000, 1010}
    assert found(spark, rows) == want


def test_empty_tables_and_no_anchors(spark):
    assert found(spark, []) == []
    rows = clusters(random.Random(1), 30, 3)
    assert found(spark, rows, every=10**9 + 7, low=30) == brute(rows, every=10**9 + 7)
    assert found(spark, [(i, [1.0], 0) for i in range(30)]) == []  # one label
    assert found(spark, [(i, [], i % 2) for i in range(30)]) == brute([(i, [], i % 2) for i in range(30)])
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(None).cast("boolean")).columns == [c.split()[0] for c in H.OUTPUT.split(", ")]


def test_blocks_of_anchors(spark, monkeypatch):
    rows = clusters(random.Random(5), 250, 8)
    monkeypatch.setattr(H, "ANCHORS", 4)
    assert found(spark, rows, every=5) == brute(rows, every=5)


def test_other_windows(spark):
    rows = clusters(random.Random(6), 150, 5)
    kw = {"positives": 2, "negatives": 3, "low": -20, "high": 100}
    assert found(spark, rows, **kw) == brute(rows, **kw)


def test_bounds_hold_and_prune():
    """Every score lies within its bounds, and few rows are scored in a typical table."""
    rnd = np.random.default_rng(0)
    m = np.floor(256 * rnd.normal(0, 0.125, (4000, 64))).astype(np.int32)
    low, high = m.min(axis=0).astype(np.int64), m.max(axis=0).astype(np.int64)
    edges = np.clip(np.ceil(m.mean(axis=0)[:, None] + m.std(axis=0)[:, None] * np.linspace(-H.SPREAD, H.SPREAD, H.CELLS - 1)).astype(np.int64), low[:, None], high[:, None] + 1)
    cells = H.Cells(edges, np.hstack((low[:, None], edges)), np.hstack((edges - 1, high[:, None])))
    codes = np.ascontiguousarray(cells.of(m).T).astype(np.intp)
    lower, upper = H.bounds(m[:20], cells, codes)
    exact = m[:20].astype(np.int64) @ m.astype(np.int64).T
    assert (lower <= exact).all()
    assert (exact <= upper).all()
    reach = H.kth(lower, 5, np.full(20, -(1 << 60)))
    assert (upper >= reach[:, None]).mean() < 0.2
