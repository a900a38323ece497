"""Hard negatives against plain scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import hard_negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int"


def plain(rows):
    ok = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l, *_ in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out, seen = [], set()
    for a, la, va in ok:
        if a % 100 or (a, la, tuple(va)) in seen:
            continue
        seen.add((a, la, tuple(va)))
        scored = sorted(((dot(va, v), -i, l) for i, l, v in ok if i != a), reverse=True)
        for p, i, l in [x for x in scored if x[2] == la][:5]:
            fit = [(s, j) for s, j, l2 in scored if l2 != la and 80 * p <= 100 * s <= 100 * p][:5]
            out += [(a, -i, r + 1, -j, p, s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, m.hard_negatives(df, F.col("id") % 100 == 0, **kw).collect()))


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(6, size=n)] + 0.05 * rng.normal(size=(n, dims))
    return [(int(i), [float(a) for a in x[i]], int(rng.integers(3)), "x", 1) for i in range(n)]


@pytest.mark.parametrize("anchors", [3, 2048])
def test_equal_to_all_pairs(spark, anchors):
    rows = clustered(900, 8, 1)
    rows += [(None, [1.0] * 8, 1, None, None), (901, None, 1, "", 0), (902, [1.0, None], 1, "", 0), (903, [float("nan")] * 8, 1, "", 0)]
    rows += [(904, [float("inf")] * 8, 1, "", 0), (905, [1.0] * 8, None, "", 0), (1000, [], 1, "", 0), (1100, [0.5] * 3, 2, "", 0)]
    rows += [rows[0], rows[0], (7, rows[7][1], 2, "", 0)] + [(2000 + k, rows[100][1], k % 2, "", 0) for k in range(12)]  # repeats and ties
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows, anchors=anchors) == want


def test_huge_components_and_empty_tables(spark):
    rows = [(i, [4e4 * (i % 7 + 1), -3e5, 1.0], i // 4 % 2, "", 0) for i in range(0, 300, 4)]
    assert max(r[4] for r in plain(rows)) > 2**53 and mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1, "", 0)]) == []  # no anchor


def test_tree_is_minimal_and_bounds_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(rng.normal(size=(8, 16)), 8, axis=0) + 0.01 * rng.normal(size=(64, 16)))).astype(np.int64)
    order, parent, edge = m.spanning_tree(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs, root = sorted((d[i, j], i, j) for i in range(64) for j in range(i)), list(range(64))
    total = 0
    for w, i, j in pairs:  # Kruskal
        if root[i] != root[j]:
            total += w
            root = [root[i] if r == root[j] else r for r in root]
    assert math.isclose(edge.sum(), total) and sorted(order) == list(range(64))
    place = {int(a): k for k, a in enumerate(order)}
    assert all(p < 0 or place[int(p)] < place[a] for a, p in enumerate(parent))
    tree = m.AnchorTree(np.arange(64), np.zeros(64, int), x, order, parent, edge)
    rows = np.floor(256 * rng.normal(size=(500, 16)))
    truth = rows.astype(np.int64) @ x.T
    low, scored = float(np.quantile(truth, 0.99)), 0
    for a, keep, scores in m._walk(tree, rows, True, lambda a: [(low, math.inf)]):
        assert (scores == truth[keep, a]).all() and set(np.flatnonzero(truth[:, a] >= low)) <= set(keep)
        scored += len(keep)
    assert scored < 0.4 * truth.size
