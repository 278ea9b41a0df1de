"""Fitted models against plain versions: boosting, early stopping, Shapley values, networks, importances, the grid."""

import hashlib
import itertools
import json
import math

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from notewise.operators import attribution as at
from notewise.operators import boosting as bo
from notewise.operators import models as mo
from notewise.operators import network as nw
from notewise.plans import recipes as rc
from notewise.plans.catalog import load_all
from notewise.sources.tables import table


def sample(n, d, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, d)), 2)
    y = (x[:, 0] * x[:, 1 % d] + 0.5 * x[:, 2 % d] + 0.3 * rng.standard_normal(n) > 0.2).astype(np.int8)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def frame(spark, x, y, key="note_id"):
    return spark.createDataFrame([(i * 7 + 1, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
                                 f"{key} long, y int, features array<double>")


# ---- boosting


def plain_tree(bins, g, h, here, features, p, n_bins):
    """Best-first, one leaf at a time, every split tried by summing its rows; value of each row's leaf."""
    def score(gs, hs):
        t = math.copysign(max(abs(gs) - p.l1, 0), gs)
        return t * t / (hs + p.l2)

    def best(rows, depth):
        used = rows[here[rows]]
        if p.depth >= 0 and depth >= p.depth:
            return None
        found = None
        G, H = g[used].sum(), h[used].sum()
        for f in features:
            for b in range(n_bins):
                left = used[bins[used, f] <= b]
                right = used[bins[used, f] > b]
                if min(len(left), len(right)) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                    continue
                gain = round(score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(G, H), 9)
                if gain > p.min_gain and (found is None or gain > found[0]):
                    found = gain, f, b
        return found

    leaves = [(np.arange(len(bins)), 0)]
    options = [best(*leaves[0])]
    while len(leaves) < p.leaves and any(options):
        i = max((i for i, o in enumerate(options) if o), key=lambda i: options[i][0])
        (rows, depth), (_, f, b) = leaves.pop(i), options.pop(i)
        for side in (rows[bins[rows, f] <= b], rows[bins[rows, f] > b]):
            leaves.append((side, depth + 1))
            options.append(best(side, depth + 1))
    out = np.zeros(len(bins))
    for rows, _ in leaves:
        used = rows[here[rows]]
        G, H = g[used].sum(), h[used].sum()
        out[rows] = -math.copysign(max(abs(G) - p.l1, 0), G) / (H + p.l2) * p.step
    return out, len(leaves)


def plain_margins(bins, y, ids, p, start, n_bins):
    margin = np.full(len(y), start)
    for r in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, p.pos_weight, 1.0)
        here = bo.uniform(ids, p.seed, r) < p.row_share
        value, _ = plain_tree(bins, w * (q - y), w * q * (1 - q), here, bo.features_of(p, r, bins.shape[1]), p, n_bins)
        margin = margin + value
    return margin


SETTINGS = [
    bo.Params(rounds=4, leaves=7, min_rows=5, bins=12, l2=0.1),
    bo.Params(rounds=3, leaves=16, depth=4, min_rows=1, min_hessian=0.5, bins=9, l1=0.3, l2=1.0, pos_weight=3.0, start="zero"),
    bo.Params(rounds=4, leaves=6, min_rows=3, bins=16, l1=0.1, l2=0.1, row_share=0.7, feature_share=0.6, step=0.3),
]


@pytest.mark.parametrize("p", SETTINGS)
def test_boosting_equals_a_plain_version(spark, p):
    """In one block (a task runs the rounds) and in many (each pass is a job)."""
    x, y = sample(160, 5, missing=0.05)
    ids = np.arange(160) * 7 + 1
    rows = bo.as_rows(frame(spark, x, y), "c", 0)
    alone = bo.fit_cells(rows, {"c": p})["c"]
    many = bo.fit_cells(rows, {"c": p}, block_rows=40, rounds_together=2)["c"]
    bins = bo.binned(x, alone.edges, p.bins)
    assert max(len(e) for e in alone.edges) < p.bins
    start = 0.0 if p.start == "zero" else math.log(y.sum() * p.pos_weight / (len(y) - y.sum()))
    want = plain_margins(bins, y, ids, p, start, p.bins)
    assert np.allclose(alone.margins(x), want, atol=1e-9)
    assert np.allclose(many.margins(x), want, atol=1e-9)
    scored = bo.predict(alone, frame(spark, x, y)).collect()
    assert np.allclose([r.score for r in sorted(scored)], 1 / (1 + np.exp(-want)), atol=1e-9)


def test_a_leaf_by_hand():
    """One stump from margin 0: p = 1/2, so g = w (1/2 - y) and h = w / 4."""
    x = np.array([[0]] * 4 + [[1]] * 6, dtype=np.uint8)
    y = np.array([1, 1, 1, 0] + [0] * 5 + [1])
    for weight, l1, l2 in [(1, 0, 0), (3, 0, 0), (1, 0.25, 0), (2, 0.5, 1.5)]:
        p = bo.Params(leaves=2, min_rows=1, l1=l1, l2=l2, pos_weight=weight, bins=4, step=1.0)
        tree = bo.grown_alone(p, 0, x, y, np.arange(10), np.zeros(10))
        g = [0.5 - 1.5 * weight, 2.5 - 0.5 * weight]
        h = [(1 + 3 * weight) / 4, (5 + weight) / 4]
        value = [-math.copysign(max(abs(a) - l1, 0), a) / (b + l2) for a, b in zip(g, h)]
        assert np.allclose([tree["value"][tree["left"][0]], tree["value"][tree["right"][0]]], value)
        gain = sum(max(abs(a) - l1, 0) ** 2 / (b + l2) for a, b in zip(g, h)) - max(abs(sum(g)) - l1, 0) ** 2 / (sum(h) + l2)
        assert math.isclose(tree["gain"][0], gain, abs_tol=1e-8)


def test_leaves_and_depth_are_limits():
    x, y = sample(3000, 6, 3)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(6)]
    bins = bo.binned(x, edges, 32)
    for p in (bo.Params(leaves=64, min_rows=1, bins=32), bo.Params(leaves=64, depth=3, min_rows=1, bins=32),
              bo.Params(leaves=8, depth=10, min_rows=1, bins=32)):
        tree = bo.grown_alone(p, 0, bins, y, np.arange(3000), np.zeros(3000))
        n = tree["feature"].count(-1)
        assert n == min(p.leaves, 2 ** p.depth if p.depth >= 0 else 64)
        where = bo.descend(tree, bins)
        assert [tree["rows"][v] for v in np.unique(where)] == np.unique(where, return_counts=True)[1].tolist()


def test_early_stopping_carries_on_and_resumes(spark, tmp_path, monkeypatch):
    """A driver that stops after some blocks goes on; no round is fitted twice; equal to one fit."""
    x, y = sample(300, 4, 1)
    y[::9] ^= 1
    rows = bo.as_rows(frame(spark, x[:200], y[:200]), "c", 0).unionByName(
        bo.as_rows(frame(spark, x[200:], y[200:]).withColumn("note_id", F.col("note_id") + 10_000), "c", 1))
    p = bo.Params(rounds=60, step=0.3, leaves=8, min_rows=3, bins=16, patience=8)
    blocks = []
    real = bo._next_block

    def counted(spark, state, book, live, a, b):
        blocks.append(len(book["cells"]["c"]["trees"]))
        if len(blocks) == 3:
            raise KeyboardInterrupt
        return real(spark, state, book, live, a, b)
    monkeypatch.setattr(bo, "_next_block", counted)
    state = str(tmp_path / "state")
    with pytest.raises(KeyboardInterrupt):
        bo.fit_cells(rows, {"c": p}, state, rounds_alone=5)
    got = bo.fit_cells(rows, {"c": p}, state, rounds_alone=5)["c"]
    fitted = blocks[:2] + blocks[3:]
    assert fitted == sorted(set(fitted)) and fitted[:3] == [0, 5, 10]
    monkeypatch.setattr(bo, "_next_block", real)
    whole = bo.fit_cells(rows, {"c": bo.replace(p, patience=None)}, rounds_alone=60)["c"]
    best, stopped = bo.best_round(whole.losses, 8)
    assert stopped and len(got.trees) == best < 52
    assert np.allclose(got.margins(x), whole.first(best).margins(x), atol=1e-12)
    margin = whole.first(best).margins(x[200:])
    assert math.isclose(whole.losses[best - 1], float(np.logaddexp(0, np.where(y[200:] == 1, -margin, margin)).mean()), rel_tol=1e-9)
    # the same by jobs over many blocks, and by average precision
    together = bo.fit_cells(rows, {"c": bo.replace(p, rounds=6)}, block_rows=70, rounds_together=3)["c"]
    assert np.allclose(together.losses, whole.losses[:6], atol=1e-9)
    q = bo.replace(p, rounds=4, metric="average_precision")
    a, b = bo.fit_cells(rows, {"c": q})["c"], bo.fit_cells(rows, {"c": q}, block_rows=70)["c"]
    assert np.allclose(a.losses, b.losses, atol=1e-9) and all(-1 <= v <= 0 for v in a.losses)


def test_more_rounds_later_continue_the_same_model(spark, tmp_path):
    x, y = sample(150, 3, 2)
    rows = bo.as_rows(frame(spark, x, y), "c", 0)
    p = bo.Params(rounds=4, leaves=5, min_rows=3, bins=8)
    state = str(tmp_path / "s")
    first = bo.fit_cells(rows, {"c": p}, state)["c"]
    more = bo.fit_cells(rows, {"c": bo.replace(p, rounds=9)}, state)["c"]
    assert more.trees[:4] == first.trees
    assert np.allclose(more.margins(x), bo.fit_cells(rows, {"c": bo.replace(p, rounds=9)})["c"].margins(x), atol=1e-12)


def test_one_class_and_few_rows(spark):
    x, _ = sample(6, 2, 5)
    for y in (np.zeros(6, dtype=int), np.ones(6, dtype=int)):
        m = bo.fit(frame(spark, x, y), bo.Params(rounds=3, bins=8))
        assert all(len(t["node"]) == 1 for t in m.trees) and np.isfinite(m.margins(x)).all()


def test_a_book_holds_the_new_rounds_alone(spark, tmp_path):
    """What the driver writes after a block of rounds doesn't grow with the rounds before it."""
    x, y = sample(120, 3, 6)
    rows = bo.as_rows(frame(spark, x, y), "a", 0).unionByName(bo.as_rows(frame(spark, x, 1 - y), "b", 0))
    p = bo.Params(rounds=6, leaves=5, min_rows=3, bins=8)
    got = bo.fit_cells(rows, {"a": p, "b": p}, str(tmp_path), rounds_alone=2)
    for i in range(1, 4):
        lines = spark.read.parquet(f"{tmp_path}/book-{i}").collect()
        assert [len(json.loads(r["facts"])["trees"]) for r in lines] == [2, 2]
    again = bo.fit_cells(rows, {"a": p, "b": p}, str(tmp_path))
    assert all(len(got[c].trees) == 6 and again[c].trees == got[c].trees for c in "ab")


def test_a_node_that_can_not_split_is_not_summed():
    """Both sides need min_hessian, so a node with less than twice as much is a leaf."""
    x = np.repeat(np.arange(4, dtype=np.uint8), 3)[:, None]
    asked = []
    for least in (1.0, 0.7):
        growth = bo.Growth(bo.Params(min_rows=1, min_hessian=least, bins=4), 0.0, 1.8, len(x))
        asked.append(growth.wanted())
    assert asked == [[], [0]]


def test_blocks_are_dealt_evenly(spark):
    x, y = sample(400, 4, 8)
    blocks, facts = bo.pack(bo.as_rows(frame(spark, x, y), "c", 0), {"c": bo.Params(bins=8)}, block_rows=64)
    sizes = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    assert facts["c"]["blocks"] == 50 and len(sizes) == min(50, spark.sparkContext.defaultParallelism)
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("p", SETTINGS)
def test_nodes_grown_whole_equal_those_grown_by_sums(spark, monkeypatch, p):
    x, y = sample(300, 5, 9, missing=0.05)
    rows = bo.as_rows(frame(spark, x, y), "c", 0)
    passes, real = [], bo._splits

    def counted(*a):
        passes[-1] += 1
        return real(*a)
    monkeypatch.setattr(bo, "_splits", counted)
    margins = []
    for most in (0, 120, 20_000):
        monkeypatch.setattr(bo, "ROWS_WHOLE", most)
        passes.append(0)
        margins.append(bo.fit_cells(rows, {"c": p}, block_rows=80)["c"].margins(x))
    assert np.allclose(margins[0], margins[1], atol=1e-9) and np.allclose(margins[0], margins[2], atol=1e-9)
    assert passes[2] == 2 * p.rounds < passes[0] and passes[2] <= passes[1] <= passes[0]


# ---- attribution


def test_shapley_values_equal_all_subsets(spark):
    x, y = sample(250, 6, 4)
    df = frame(spark, x, y)
    model = bo.fit(df, bo.Params(rounds=6, leaves=14, min_rows=4, bins=16, row_share=0.9))
    bins = bo.binned(x, model.edges, 16)

    def expected(tree, v, b, known):
        f = tree["feature"][v]
        if f < 0:
            return tree["value"][v]
        kids = tree["left"][v], tree["right"][v]
        if f in known:
            return expected(tree, kids[int(b[f] > tree["bin"][v])], b, known)
        return sum(tree["rows"][k] * expected(tree, k, b, known) for k in kids) / tree["rows"][v]

    got = {r.note_id: r for r in at.shapley_values(model, df).collect()}
    margins = model.margins(x)
    for i in range(0, 250, 31):
        value = {s: sum(expected(t, 0, bins[i], s) for t in model.trees) for k in range(7) for s in itertools.combinations(range(6), k)}
        r = got[i * 7 + 1]
        for j in range(6):
            phi = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / math.factorial(6) * (value[tuple(sorted((*s, j)))] - value[s])
                      for s in value if j not in s)
            assert math.isclose(r.contrib[j], phi, abs_tol=1e-9)
        assert math.isclose(r.bias + sum(r.contrib), margins[i], abs_tol=1e-9)
    table_ = np.array([got[i * 7 + 1].contrib for i in range(250)])
    for r in at.shapley_summary(model, df).collect():
        assert math.isclose(r.mean_abs, np.abs(table_[:, r.feature]).mean(), abs_tol=1e-9)
        assert math.isclose(r.mean, table_[:, r.feature].mean(), abs_tol=1e-9)


def test_importance_adds_up_the_gains(spark):
    x, y = sample(200, 4, 6)
    model = bo.fit(frame(spark, x, y), bo.Params(rounds=5, leaves=6, min_rows=5, bins=16))
    rows = bo.importance(model, spark).collect()
    gains = [sum(g for t in model.trees for f, g in zip(t["feature"], t["gain"]) if f == j) for j in range(4)]
    assert [r.feature for r in rows] == sorted(range(4), key=lambda j: (-gains[j], j))
    assert all(math.isclose(r.gain, gains[r.feature]) and math.isclose(r.importance, gains[r.feature] / sum(gains)) for r in rows)


def test_permutation_importance_equals_permuted_columns(spark):
    x, y = sample(220, 3, 7)
    df = frame(spark, x, y)
    model = bo.fit(df, bo.Params(rounds=5, leaves=6, min_rows=5, bins=16))

    def auc(score):
        pos, neg = score[y == 1], score[y == 0]
        return ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    key = [int(hashlib.md5(f"42:{i * 7 + 1}".encode()).hexdigest()[:8], 16) for i in range(220)]
    order = sorted(range(220), key=lambda i: (key[i], i))
    partner = np.empty(220, dtype=int)
    partner[order] = order[1:] + order[:1]
    base = auc(np.round(model.margins(x), 12))
    got = {r.feature: r for r in mo.permutation_importance(model, mo.with_features(df, "features"), 3).collect()}
    for j in range(3):
        z = x.copy()
        z[:, j] = x[partner, j]
        want = auc(np.round(model.margins(z), 12))
        assert math.isclose(got[j].permuted_auc, want, abs_tol=1e-9) and math.isclose(got[j].auc_drop, base - want, abs_tol=1e-9)


# ---- networks


def moments(x):
    return x.mean(0), x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))


@pytest.mark.parametrize("norm", [False, True])
def test_gradients_equal_finite_differences(norm):
    rng = np.random.default_rng(0)
    p = nw.Params(hidden=(5, 4), dropout=(), batch_norm=norm, pos_weight=3.0)
    x, y = rng.standard_normal((30, 6)), (rng.random(30) < 0.3).astype(np.int8)
    w, net, m = nw.weights_of(y, p), nw.fresh(p, 6), moments(x)
    grads, _ = nw.gradients(net, nw.gradient_sums(net, x, y, w, m, None), m)
    for v, g in zip(nw._flat(net), grads):
        for at_ in itertools.islice(np.ndindex(v.shape), 8):
            old, got = v[at_], []
            for d in (1e-6, -1e-6):
                v[at_] = old + d
                got.append(nw.gradient_sums(net, x, y, w, m, None)[-2] / 30)
            v[at_] = old
            assert math.isclose((got[0] - got[1]) / 2e-6, g[at_], abs_tol=1e-7)


def test_weighted_gradients_equal_those_of_copied_rows():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((40, 6)), (rng.random(40) < 0.3).astype(np.int8)
    net = nw.fresh(nw.Params(hidden=(7, 3)), 6)
    weight = np.where(y == 1, 4, 1)
    weighted = nw.gradient_sums(net, x, y, weight.astype(float), None, None)
    copied = nw.gradient_sums(net, np.repeat(x, weight, 0), np.repeat(y, weight), np.ones(weight.sum()), None, None)
    assert np.allclose(weighted[:-1], copied[:-1], atol=1e-10) and weighted[-1] == 40


@pytest.mark.parametrize("norm", [False, True])
def test_training_in_blocks_equals_plain_steps(spark, norm):
    """Full-batch Adam written out, without dropout; blocks of 30 rows; two cells in the same jobs."""
    x, y = sample(130, 5, 8)
    p = nw.Params(hidden=(6, 4), dropout=(), batch_norm=norm, epochs=4, step=0.05, pos_weight=2.5)
    q = nw.Params(hidden=(3,), dropout=(), epochs=2, step=0.01)
    df = frame(spark, x, y)
    nets = nw.fit_cells(bo.as_rows(df, "p", 0).unionByName(bo.as_rows(df, "q", 0)), {"p": p, "q": q}, block_rows=30)
    for name, settings in (("p", p), ("q", q)):
        net = nw.fresh(settings, 5)
        step = nw.Adam(net)
        m = moments(x)
        for _ in range(settings.epochs):
            grads, _ = nw.gradients(net, nw.gradient_sums(net, x, y, nw.weights_of(y, settings), m, None), m)
            if net.norm is not None:
                a, s = nw._batch_stats(net, m)
                net.running = [0.9 * net.running[0] + 0.1 * a, 0.9 * net.running[1] + 0.1 * (s ** 2 - 1e-5) * 130 / 129]
            step.take(grads)
        assert np.allclose(nets[name].margins(x), net.margins(x), atol=1e-8)
    got = sorted((r.note_id, r.score) for r in nw.predict(nets["p"], df).collect())
    assert np.allclose([s for _, s in got], 1 / (1 + np.exp(-nets["p"].margins(x))))


def test_masks_of_slices_are_those_of_the_block():
    p = nw.Params(hidden=(7, 5, 3), dropout=(0.3, 0.0, 0.4))
    rng = np.random.default_rng([1, 2, 3])
    whole = {0: rng.random((11, 7)), 2: rng.random((11, 3))}
    draws = nw.mask_draws(p, [1, 2, 3], 11)
    assert draws[1][0] is None and [d[1:] for d in draws] == [(7, 0.3), (5, 0.0), (3, 0.4)]
    for i, w in whole.items():
        assert np.array_equal(np.concatenate([draws[i][0].random((k, w.shape[1])) for k in (4, 4, 3)]), w)


def test_a_block_in_slices_has_the_same_network(spark, monkeypatch):
    x, y = sample(90, 4, 7)
    rows = bo.as_rows(frame(spark, x, y), "c", 0)
    p = nw.Params(hidden=(6, 4), dropout=(0.3, 0.2), epochs=3, step=0.01, batch_norm=True)
    whole = nw.fit_cells(rows, {"c": p})["c"]
    monkeypatch.setattr(nw, "SLICE_ROWS", 16)
    sliced = nw.fit_cells(rows, {"c": p})["c"]
    assert np.allclose(whole.margins(x), sliced.margins(x), atol=1e-10)


def test_a_network_learns_and_dropout_is_seeded(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    p = nw.Params(hidden=(16, 8), dropout=(0.2,), epochs=40, step=0.02)
    df = frame(spark, x, y)
    a = nw.fit_cells(bo.as_rows(df, "c", 0), {"c": p})["c"]
    b = nw.fit_cells(bo.as_rows(df.repartition(3), "c", 0), {"c": p})["c"]
    assert np.allclose(a.margins(x), b.margins(x))
    assert ((a.margins(x) > 0) == y).mean() > 0.95


# ---- recipes and queries


def plain_metrics(score, y, threshold):
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], y[order]
    ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp = np.cumsum(hit)[ends]
    precision, recall = tp / (ends + 1), tp / hit.sum()
    if threshold is None:
        f1 = 2 * precision * recall / (precision + recall + 1e-8)
        threshold = max(zip(np.round(f1, 12), -s[ends]))[1] * -1
    pos, neg = score[y == 1], score[y == 0]
    return {"threshold": threshold, "accuracy": ((score > threshold) == y).mean(),
            "average_precision": (np.diff(tp, prepend=0) / hit.sum() * precision).sum(),
            "roc_auc": ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()}


def test_grid_metrics_are_those_of_each_cell_s_own_scores(spark, monkeypatch):
    """v1, v5 and v5_test (threshold from another split) with fewer rounds, recomputed cell by cell."""
    small = {g: dict(r, gbt=dict(r["gbt"], rounds=12), xgb=dict(r["xgb"], rounds=8)) for g, r in rc.RECIPES.items()}
    monkeypatch.setattr(rc, "RECIPES", small)
    e = table(spark, SF01, "embeddings")
    data = e.select(F.col("vec_id").alias("note_id"), (F.col("label") == 0).cast("int").alias("y"), "embedding")
    gens, learners = ("v1", "v5", "v5_test"), ("xgb", "mlp")
    grid = rc.experiment_grid({"vec": (data, 64)}, gens, learners).collect()
    got = {(r.gen, r.learner, r.metric if r["class"] == "all" else "accuracy"): r.value for r in grid
           if r["class"] == "all" or (r["class"] == "accuracy" and r.metric == "f1-score")}
    assert len(got) == len(gens) * len(learners) * 4
    for g in gens:
        for lr in learners:
            recipe = small[g]
            prepared = rc.prepare(data, recipe, 42, lr)
            model = rc.fit(prepared, recipe, lr)

            def scores(split, model=model, prepared=prepared):
                rows = prepared.where(F.col("split") == split).collect()
                margin = model.margins(np.array([r.embedding for r in rows], dtype=float))
                return 1 / (1 + np.exp(-margin)), np.array([r.y for r in rows])
            fixed = None if recipe["threshold"] == "tuned" else recipe["threshold"]
            if g == "v5_test":
                fixed = plain_metrics(*scores("val"), None)["threshold"]
            for name, v in plain_metrics(*scores(recipe.get("eval_on", "test")), fixed).items():
                assert math.isclose(got[g, lr, name], v, abs_tol=1e-9), (g, lr, name)


def test_model_queries_return_values(spark):
    reg = load_all()
    scored = reg["train_gbt"].fn(spark, SF01)
    assert scored.columns == ["note_id", "y", "score"] and scored.where("score between 0 and 1").count() == 100
    shap = reg["attribution_summary"].fn(spark, SF01)
    assert shap.columns == ["feature", "mean_abs", "mean"] and shap.count() == 64
    both = reg["predict_score"].fn(spark, SF01)
    assert both.groupBy("split").count().orderBy("split").collect()[0]["count"] == 100
    kept = reg["early_stopping"].fn(spark, SF01).first()
    assert 1 <= kept.n_trees <= kept.n_rounds <= 1000 and 0 <= kept.roc_auc <= 1
