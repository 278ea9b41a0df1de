"""The grid's fits: rows summed a tree, splits that don't hang on rounding, and a network's block over many tasks."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.operators import boosting as bo
from notewise.operators import network as nw


def data(n, width, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 16, (n, width)).astype(np.uint8), rng.random(n), rng.random(n) / 4


def tree_of(p, x, g, h):
    growth = bo.Growth(p, float(g.sum()), float(h.sum()), len(x))
    return bo.grown(growth, np.asfortranarray(x), np.arange(x.shape[1]), g, h, np.arange(len(x))).tree(False)


def test_of_two_children_the_smaller_is_summed(monkeypatch):
    x, g, h = data(4000, 5, 1)
    g -= 0.5
    p = bo.Params(depth=6, leaves=64, l2=1.0, min_rows=5, min_hessian=0.5, bins=15)
    seen, sums_of = [], bo.sums_of
    monkeypatch.setattr(bo, "sums_of", lambda x, g, h, groups, n: seen.append(sum(map(len, groups))) or sums_of(x, g, h, groups, n))
    less = tree_of(p, x, g, h)
    assert seen[0] == 4000 and len(seen) == 6 and max(seen[1:]) <= 2000
    seen.clear()
    monkeypatch.setattr(bo, "HELD_BYTES", 0)  # no room for sums: every node from its rows
    whole = tree_of(p, x, g, h)
    assert max(seen[1:]) > 2000
    for k in ("feature", "bin", "left", "right", "rows"):
        assert less[k] == whole[k]
    assert np.allclose(less["value"], whole["value"], atol=1e-12) and np.allclose(less["gain"], whole["gain"], atol=1e-8)


def test_sums_of_small_and_large_groups_are_those_of_their_rows():
    x, g, h = data(3000, 4, 2)
    rng = np.random.default_rng(0)
    groups = [np.sort(rng.choice(3000, n, replace=False)) for n in (1, 700, 0, 512, 513, 300, 900, 2)]
    got = bo.sums_of(np.asfortranarray(x), g, h, groups, 17)
    for s, rows in zip(got, groups):
        for j in range(4):
            for k, v in enumerate((g, h, np.ones(3000))):
                assert np.allclose(s[k, j], [v[rows][x[rows, j] == b].sum() for b in range(17)])


def test_a_side_of_the_least_hessian_but_for_rounding_may_be_split_off():
    p = bo.Params(l2=1.0, min_rows=1, min_hessian=1.0)
    for off in (1e-13, 0.0, -1e-13):  # what another order of the sums leaves
        sums = np.array([[[8.0, -4.0]], [[9.0, 1.0 + off]], [[30.0, 4.0]]])[None]
        assert bo.best_splits(sums, np.array([3]), p)[0][1:3] == (3, 0)
        assert bo.best_splits(sums[..., ::-1].copy(), np.array([3]), p)[0][1:3] == (3, 0)


def test_a_block_in_parts_is_dealt_to_many_tasks_and_gives_the_same_network(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((100, 4))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))],
                               "note_id long, y int, features array<double>")
    rows = bo.as_rows(df, "c", 0)
    cells = {"c": nw.Params(hidden=(6, 4), dropout=(0.3, 0.2), epochs=3, step=0.01, batch_norm=True)}
    for block_rows in (100, 40):
        whole = nw.fit_cells(rows, cells, block_rows)["c"]
        with monkeypatch.context() as m:
            m.setattr(nw, "PART_ROWS", 16)
            m.setattr(nw, "SLICE_ROWS", 8)
            parts = nw.fit_cells(rows, cells, block_rows)["c"]
            packed = nw.pack(rows, {"c": 100}, cells, block_rows)
            tasks = nw.dealt(packed, {"c": 100}, {"c": 4}, cells, block_rows).select(F.spark_partition_id().alias("t"), "first", "size", "block").collect()
        assert np.allclose(whole.margins(x), parts.margins(x), atol=1e-10)
        assert len({r["t"] for r in tasks}) > 1 and len({(r["block"], r["first"]) for r in tasks}) == len(tasks) >= 7


def grid_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 5)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.standard_normal(n) > 0.3).astype(int)
    df = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))],
                               "note_id long, y int, features array<double>")
    return x, df


def test_a_cell_of_many_blocks_is_fitted_by_one_task(spark, monkeypatch):
    x, df = grid_rows(spark, 300, 3)
    rows = bo.as_rows(df.where("note_id < 250"), "a", 0).unionByName(bo.as_rows(df.where("note_id >= 250"), "a", 1))
    p = bo.Params(rounds=6, leaves=6, min_rows=5, bins=12, row_share=0.8, feature_share=0.8, patience=6)
    whole = bo.fit_cells(rows, {"a": p})["a"]
    many = bo.fit_cells(rows, {"a": p}, block_rows=64)["a"]  # a job a pass

    def refused(*a):
        raise AssertionError("a pass as a job")
    monkeypatch.setattr(bo, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bo, "_together", refused)
    monkeypatch.setattr(bo, "ROWS_ALONE", 299)
    with pytest.raises(AssertionError, match="a pass as a job"):
        bo.fit_cells(rows, {"a": p})
    monkeypatch.setattr(bo, "ROWS_ALONE", 300)
    alone = bo.fit_cells(rows, {"a": p}, rounds_alone=4)["a"]  # five blocks, put together twice
    for k in ("node", "feature", "bin", "left", "right", "rows"):
        assert [t[k] for t in alone.trees] == [t[k] for t in whole.trees] == [t[k] for t in many.trees]
    assert np.allclose(alone.margins(x), whole.margins(x), atol=1e-12) and np.allclose(alone.losses, whole.losses, atol=1e-12)


def test_cells_of_a_set_are_packed_once(spark):
    x, df = grid_rows(spark, 200, 4)
    p, q = bo.Params(rounds=3, leaves=4, bins=9), bo.Params(rounds=2, leaves=6, bins=9, pos_weight=3.0)
    own = reduce(lambda a, b: a.unionByName(b), [bo.as_rows(df, c, 0) for c in "abc"])
    one = bo.as_rows(df, "a", 0)
    r = bo.replace(p, bins=5)  # other bins: not the same blocks
    apart = bo.fit_cells(own, {"a": p, "b": q, "c": r})
    shared = bo.fit_cells(one, {"a": p, "b": q, "c": r}, sets=dict.fromkeys("abc", "a"))
    assert all(apart[c].trees == shared[c].trees and apart[c].start == shared[c].start for c in "abc")
    seen = []
    edges_of, bo.edges_of = bo.edges_of, lambda rows, *a: seen.append(rows.count()) or edges_of(rows, *a)
    try:
        blocks, facts = bo.pack(one, {"a": p, "b": q}, 64, sets={"a": "a", "b": "a"})
    finally:
        bo.edges_of = edges_of
    assert seen == [200] and {(r["cell"], r["block"]) for r in blocks.collect()} == {(c, i) for c in "ab" for i in range(facts[c]["blocks"])}
    assert facts["a"]["start"] != facts["b"]["start"]


def test_sums_by_pairs_of_features_are_those_of_single_ones(monkeypatch):
    x, g, h = data(5000, 7, 6)  # an odd number of features, groups on both sides of a table's cells
    rng = np.random.default_rng(1)
    groups = [np.sort(rng.choice(5000, n, replace=False)) for n in (5000, 290, 289, 3000, 1)]
    monkeypatch.setattr(bo, "_CHUNK", 700)
    got = bo.sums_of(bo.Bins(np.asfortranarray(x)), g, h, groups, 17)
    by_row = bo.sums_of(bo.Bins(np.asfortranarray(x[:, [0, 2, 5]]), x, np.array([0, 2, 5])), g, h, groups, 17)
    for s, some, rows in zip(got, by_row, groups):
        for j in range(7):
            want = [[v[rows][x[rows, j] == b].sum() for b in range(17)] for v in (g, h, np.ones(5000))]
            assert np.allclose(s[:, j], want) and (j not in (0, 2, 5) or np.allclose(some[:, [0, 2, 5].index(j)], want))


def test_few_rows_find_the_leaves_that_many_find(monkeypatch):
    x, g, h = data(600, 5, 7)
    tree = tree_of(bo.Params(leaves=40, min_rows=2, bins=15), x, g - 0.5, h)
    found = []
    for most in (0, 10 ** 9):
        monkeypatch.setattr(bo, "_ROWS_A_NODE", most)
        found.append(bo.descend(tree, x))
    assert (found[0] == found[1]).all() and len(set(found[0])) > 20
    assert (bo.descend({"feature": [-1], "bin": [0], "left": [-1], "right": [-1]}, x) == 0).all()


def test_a_grid_reads_its_rows_once(spark, monkeypatch):
    from notewise.plans import recipes as rc
    _, df = grid_rows(spark, 150, 8)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    data = df.select("note_id", "y", F.col("features").alias("embedding")).repartition(2)
    data = data.mapInArrow(seen, data.schema)
    got = rc.experiment_grid({"e": (data, 5)}, gens=("v1", "v2"), learners=("gbt",))
    assert got.select("gen").distinct().count() == 2 and reads.value == 150
