"""Shapley values of boosted trees, exactly and in polynomial time.

A leaf's share in the margin depends on the features of its path alone. For a row, a path's feature j is
hot (o = 1) if the row satisfies all of the path's splits on it; if j is unknown, the row is taken to
satisfy them with probability z, the product of the rows that went that way at those splits. With the
features joined by independent coins of bias t, the leaf is reached with probability
prod_k (z_k + t (o_k - z_k)), and the Shapley value, the mean over all orders of joining, is the integral
over t of its derivative in j:

    phi_j = value * (o_j - z_j) * integral_0^1 prod_{k != j} (z_k + t (o_k - z_k)) dt

The integrand is a polynomial of degree m - 1 for a path of m features, so ceil(m / 2) Gauss-Legendre
points give it exactly: the weights of all 2^m subsets without listing them. Rows are handled in Arrow
batches, leaf by leaf.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.operators.boosting import Boosted, _column, _matrix, binned
from notewise.session import ship_package


def paths_of(tree: dict) -> list[tuple]:
    """(value, features, low, high, z) of each leaf: its path's features are hot where low < bin <= high."""
    out, stack = [], [(0, {})]
    while stack:
        v, path = stack.pop()
        f = tree["feature"][v]
        if f < 0:
            names = sorted(path)
            out.append((tree["value"][v], np.array(names, dtype=int), *(np.array([path[j][i] for j in names], dtype=float) for i in range(3))))
            continue
        low, high, z = path.get(f, (-1, np.inf, 1.0))
        for child, lo, hi in ((tree["left"][v], low, min(high, tree["bin"][v])), (tree["right"][v], max(low, tree["bin"][v]), high)):
            share = tree["rows"][child] / max(tree["rows"][v], 1)
            stack.append((child, path | {f: (lo, hi, z * share)}))
    return out


@lru_cache(maxsize=None)
def _points(m: int) -> tuple[np.ndarray, np.ndarray]:
    t, w = np.polynomial.legendre.leggauss(max(1, -(-m // 2)))
    return (t + 1) / 2, w / 2


def shapley(model: Boosted, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(bias, contributions): bias + contributions.sum(1) are the margins."""
    bins = binned(x, model.edges, model.params.bins)
    phi = np.zeros(x.shape)
    bias = model.start
    for tree in model.trees:
        for value, names, low, high, z in paths_of(tree):
            bias += value * z.prod()
            if not len(names):
                continue
            part = bins[:, names]
            hot = ((part > low) & (part <= high)).astype(np.float64)
            t, w = _points(len(names))
            factor = z[None, :, None] + t[None, None, :] * (hot - z)[:, :, None]
            others = factor.prod(axis=1)[:, None, :] / factor
            phi[:, names] += value * (hot - z) * (others @ w)
    return float(bias), phi


def shapley_values(model: Boosted, df: DataFrame, features: str = "features", key: str = "note_id") -> DataFrame:
    """key, bias, contrib (one value a feature) of each row; bias + the sum of contrib is the row's margin."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                bias, phi = shapley(shared.value, _matrix(pdf["x"]))
                yield pd.DataFrame({key: pdf[key], "bias": bias, "contrib": list(phi)})
    return df.select(key, _column(df, features).alias("x")).mapInPandas(run, f"{key} long, bias double, contrib array<double>")


def shapley_summary(model: Boosted, df: DataFrame, features: str = "features") -> DataFrame:
    """feature, mean_abs, mean of all features' values over all rows, the greatest first: sums inside a batch, then one aggregate."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                _, phi = shapley(shared.value, _matrix(pdf["x"]))
                yield pd.DataFrame({"feature": np.arange(phi.shape[1]), "size": np.abs(phi).sum(0), "total": phi.sum(0), "n": len(pdf)})
    sums = df.select(_column(df, features).alias("x")).mapInPandas(run, "feature int, size double, total double, n long")
    return sums.groupBy("feature").agg((F.sum("size") / F.sum("n")).alias("mean_abs"), (F.sum("total") / F.sum("n")).alias("mean")).orderBy(
        F.desc("mean_abs"), "feature")
