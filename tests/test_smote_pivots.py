"""The pruned neighbour search: exact with ties, and fewer pairs of blocks on clustered vectors."""

import numpy as np
import pytest

from notewise.operators import smote as sm


def brute(x, k):
    out = {}
    for a in range(len(x)):
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        order = sorted((round(d[b], 9), b) for b in range(len(x)) if b != a)[:k]
        out |= {(a, r): b for r, (_, b) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("kind", ["clusters", "one crowd", "grid", "spread"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "clusters":
        x = 20 * rng.standard_normal((30, 6))[rng.integers(0, 30, 600)] + 0.1 * rng.standard_normal((600, 6))
    elif kind == "one crowd":  # a third of the rows at one point
        x = rng.standard_normal((300, 4))
        x[100:200] = x[100]
    elif kind == "grid":  # every distance is tied many times
        x = np.array([(a, b, c) for a in range(7) for b in range(7) for c in range(5)], dtype=float)
    else:
        x = rng.standard_normal((300, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "note_id long, embedding array<double>")
    stats = {}
    got = {(r.i, r.r): r.j for r in sm.smote_neighbors(df.repartition(4), k=4, block_rows=20, stats=stats).collect()}
    assert got == brute(x, 4)
    print(kind, stats, f"{stats['pairs'] / stats['all_pairs']:.1%} of all pairs")
    if kind == "clusters":
        assert stats["pairs"] < 0.25 * stats["all_pairs"]


def test_fewer_rows_than_neighbours_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "note_id long, embedding array<float>")
    got = {(r.i, r.r): r.j for r in sm.smote_neighbors(df, k=5, block_rows=1).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert sm.smote_neighbors(df.where("note_id < 0")).count() == 0
    assert sm.smote_neighbors(df.where("note_id = 1")).count() == 0
