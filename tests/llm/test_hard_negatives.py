import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedrank.llm.hard_negatives import Mining, SplitTree, hard_negatives, squared

SCHEMA = "vec_id long, label int, embedding array<float>"
SMALL = Mining(leaf=16, arity=4, sample=300, fitted=2)


def plain(rows, is_anchor, s=Mining()):
    """The same by scoring every anchor with every row."""
    taking = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            taking[i] = min(taking.get(i, (label, v)), (label, v))
    held = {i: (label, [math.floor(s.scale * float(np.float32(x))) for x in v]) for i, (label, v) in taking.items()}
    out = []
    for a, (label, q) in held.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in held.items() if i != a)
        for p, pid in [(-p, i) for p, i, other in scored if other == label][: s.positives]:
            hits = [(i, -n) for n, i, other in scored if other != label and s.low * p <= -100 * n <= s.high * p]
            out += [(a, pid, rank, i, p, n) for rank, (i, n) in enumerate(hits[: s.negatives], 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, settings, schema=SCHEMA):
    found = hard_negatives(spark.createDataFrame(rows, schema).repartition(3), is_anchor, settings)
    return sorted(tuple(r) for r in found.collect())


def clustered(rng, n, dims=16, clusters=12):
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("settings", [Mining(), SMALL, Mining(leaf=40, arity=2, sample=60, fitted=1, positives=2, negatives=3, low=10, high=50),
                                      Mining(leaf=8, arity=12, sample=1000, streams=5)])
def test_equals_scoring_all_rows(spark, settings):
    rng = np.random.default_rng(3)
    x = np.concatenate([clustered(rng, 500), rng.normal(size=(60, 16)) * 3, np.zeros((5, 16))])
    rows = [(i * 3 - 200, int(rng.integers(0, 5)), v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, 2, rows[7][2]) for i in range(40)]  # copies
    expected = plain(rows, lambda i: i % 25 == 0, settings)
    assert mined(spark, rows, F.col("vec_id") % 25 == 0, settings) == expected and len(expected) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.6, 0.1]), (3, 2, [0.5]), (4, 3, [0.5, 0.0, 2.0]), (5, 3, []),
            (6, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (7, 2, None), (8, 2, [None, 1.0]), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]),
            (11, 2, [-inf, 0.0]), (1, 1, [9.0, 9.0]), (1, 0, [0.8, 0.1]), (2, 2, [0.6, 0.1]), (12, 1, [-1.0, -1.0]), (13, 4, [0.7, 0.0]), (14, 1, [0.9, 0.3])]
    expected = plain(rows, lambda i: i in (0, 12, 4), SMALL)
    assert mined(spark, rows, F.col("vec_id").isin(0, 12, 4), SMALL) == expected and expected
    extra = [(*r, 1, "x", 2.0) for r in rows]
    assert mined(spark, extra, F.col("vec_id").isin(0, 12, 4), SMALL, SCHEMA + ", id int, leaf string, score double") == expected
    assert mined(spark, rows, F.lit(None).cast("boolean"), SMALL) == []
    for none in ([], rows[6:8], [(0, 1, [1.0])]):
        assert mined(spark, none, F.col("vec_id") == 0, Mining()) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    for size in (300.0, 1e5, 5e6):
        rows = [(i, i % 3, (np.float32(size) * rng.random(4, np.float32)).tolist()) for i in range(120)]
        expected = plain(rows, lambda i: i % 10 == 0, SMALL)
        assert mined(spark, rows, F.col("vec_id") % 10 == 0, SMALL) == expected and expected
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, 1, [1e8, 1e8])], F.lit(True), SMALL)


def test_siblings_are_eliminated_and_none_in_vain():
    rng = np.random.default_rng(8)
    x = np.floor(256 * clustered(rng, 6000, clusters=40))
    tree = SplitTree(x[:1500], 20, 8)
    leaf = tree.route(x)
    for node, rows, away, near in tree.visits(x):
        for j in np.unique(near).tolist():
            mine, norm = near == j, (x[rows[near == j]] ** 2).sum(1)
            tree.ranges[node, j] = np.sqrt(away[mine].min(0)), np.sqrt(away[mine].max(0)), norm.min(), norm.max()
    q = x[::100]
    scores = q @ x.T
    best = np.sort(scores, axis=1)[:, -10]
    query, found = tree.reached(q, best, np.full(len(q), np.inf))
    sent = set(zip(query.tolist(), found.tolist()))
    for i, j in zip(*np.nonzero(scores >= best[:, None])):
        assert (i, leaf[j]) in sent
    assert len(sent) < 0.35 * len(q) * tree.leaves
    assert np.allclose(squared(x[:3], x[3:5]), ((x[:3, None] - x[None, 3:5]) ** 2).sum(2))
