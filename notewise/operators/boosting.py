"""Second-order gradient boosting of binary trees over quantile-binned features.

Rows are binned once (at most ``bins`` quantile bins a feature, 255 or fewer, edges from one aggregate) and packed into
blocks (one of up to ``BLOCK_ROWS`` rows, or as many smaller ones as it takes): ids, part (training or validation),
label, a byte a feature (feature by feature) and the margin so far. A round sums first and second derivatives of the log loss per (cell, node, feature, bin)
and grows one tree best-first; a *cell* is one fit, and all cells of a grid grow in the same jobs.

* More rows: a pass over the blocks gives the sums of all wanted nodes of all cells, added up inside a
  task before the shuffle, then by (cell, node); what comes back to the driver is one best split a node.
  Best-first growth takes about as many passes as the tree is deep, not one a leaf: each pass asks for the
  children of every node that would be chosen so far, which is never too few (a child can only push
  others out). Of a node whose rows weigh less than the tasks' sums the rows travel instead, and the task
  that gets them (``ROWS_WHOLE`` at most) finds all splits below it at once.
* Up to ``ROWS_ALONE`` rows: sums need no exchange, so a task puts the cell's blocks together and runs a whole block
  of rounds on them with the same kernels; the cells of a grid run side by side.

After a block of rounds the trees, the validation losses and the rows with their new margins are written
under the state folder. The next block starts from them, so no round is fitted twice, and a driver that
was stopped goes on after the last block that it wrote. Early stopping reads the losses of the rounds that
exist.

Gains and leaves are those of the regularised second-order objective: with T(G) = sign(G) max(|G| - l1, 0),
a leaf's value is -T(G) / (H + l2) and a split's gain T(G_l)^2 / (H_l + l2) + T(G_r)^2 / (H_r + l2) -
T(G)^2 / (H + l2). ``pos_weight`` multiplies the derivatives of positive rows. Each tree sees a seeded
share of the features, each round a seeded share of the rows (by hash of the id, so it doesn't depend on
blocks). Equal gains (to 9 places) go to the lower feature, then the lower bin. A missing value (NaN, null)
lies above all bins.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.session import scratch_path, ship_package

BLOCK_ROWS = 50_000
#: A cell of at most so many rows is fitted by one task (about 400 bytes a row): its passes need no exchange and no job each.
ROWS_ALONE = 500_000
#: The rows of larger cells come in blocks of about a PARTS-th of BLOCK_ROWS, at most BLOCKS_A_TASK to a task where cores are short.
PARTS, BLOCKS_A_TASK = 8, 16
#: A node of at most so many rows is grown to its end by one task, if its rows weigh no more than their sums.
ROWS_WHOLE = 20_000
#: Rounds between two written states: where a task runs alone, and where every pass is a job.
ROUNDS_ALONE, ROUNDS_TOGETHER = 100, 10


@dataclass(frozen=True)
class Params:
    rounds: int = 100
    step: float = 0.1
    leaves: int = 31          # at most; 2 ** depth or more leaves growth to the depth
    depth: int = -1           # -1: no limit
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    min_gain: float = 0.0
    row_share: float = 1.0
    feature_share: float = 1.0
    pos_weight: float = 1.0
    bins: int = 255
    start: str = "average"    # margin before the first tree: the (weighted) log odds, or "zero"
    metric: str = "logloss"   # of validation rows: logloss or average_precision
    patience: int | None = None
    seed: int = 42


# ---- kernels on arrays

def derivatives(margin: np.ndarray, y: np.ndarray, pos_weight: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, pos_weight, 1.0)
    return w * (p - y), w * p * (1 - p)


def uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each id."""
    salt = (seed * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % (1 << 64)
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64(salt)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def features_of(p: Params, turn: int, width: int) -> np.ndarray:
    """The features that a round's tree may split on."""
    n = max(1, int(np.ceil(p.feature_share * width)))
    if n >= width:
        return np.arange(width)
    return np.sort(np.argsort(uniform(np.arange(width), p.seed + 1, turn), kind="stable")[:n])


class Bins:
    """The bins of rows, by column, by row (of all features, if those are at hand), and by row two features in one number."""

    def __init__(self, columns: np.ndarray, by_row: np.ndarray | None = None, features: np.ndarray | None = None):
        self.columns, self._rows, self._features, self._pairs = columns, by_row, features, None

    def of(self, rows: np.ndarray) -> np.ndarray:
        """(row, feature)."""
        if self._rows is None:
            self._rows = np.ascontiguousarray(self.columns)
        got = np.take(self._rows, rows, axis=0)
        return got if self._features is None else np.take(got, self._features, axis=1)

    def pairs(self, n_bins: int) -> np.ndarray:
        """(row, pair): the first feature's bin x ``n_bins`` + the second's (0 beside the last of an odd number)."""
        if self._pairs is None:
            n, width = self.columns.shape
            self._pairs = np.empty((n, -(-width // 2)), dtype=np.uint16)
            for i in range(0, n, _CHUNK):
                part = self.columns[i:i + _CHUNK]
                pairs = part[:, ::2].astype(np.uint16) * np.uint16(n_bins)
                pairs[:, :width // 2] += part[:, 1::2]
                self._pairs[i:i + _CHUNK] = pairs
        return self._pairs


#: Rows whose bins are turned or gathered at once, and rows of small groups that are summed at once.
_CHUNK, _AT_ONCE = 8192, 1024


def sums_of(x: np.ndarray | Bins, g: np.ndarray, h: np.ndarray, groups: list[np.ndarray], n_bins: int) -> np.ndarray:
    """(group, 3, feature, bin): sums of g, h and 1 of each group's rows (x in columns; rows in the groups' order).

    g and h are one complex number, so that a pass adds both. Of a group with more rows than a table of two features
    has cells, two features are added up at once; smaller groups are summed over all features together."""
    x = x if isinstance(x, Bins) else Bins(x)
    width = x.columns.shape[1]
    out = np.zeros((len(groups), 3, width, n_bins))
    large = [i for i, r in enumerate(groups) if len(r) > n_bins ** 2]
    pieces = [(i, r[k:k + _CHUNK]) for i, r in enumerate(groups) if len(r) <= n_bins ** 2 for k in range(0, len(r), _CHUNK)]
    upto = np.cumsum([len(r) for _, r in pieces])
    starts = np.arange(width) * n_bins
    while pieces:
        n = max(1, int(np.searchsorted(upto, _AT_ONCE, side="right")))
        some, pieces, upto = pieces[:n], pieces[n:], upto[n:] - upto[n - 1]
        rows = np.concatenate([r for _, r in some])
        at = x.of(rows) + starts
        if n > 1:
            at += np.repeat(np.arange(n) * (width * n_bins), [len(r) for _, r in some])[:, None]
        at, size = at.ravel(), n * width * n_bins
        sums = np.zeros(size, dtype=np.complex128)
        np.add.at(sums, at, np.repeat(g[rows] + 1j * h[rows], width))
        for k, v in enumerate((sums.real, sums.imag, np.bincount(at, minlength=size))):
            v = v.reshape(n, width, n_bins)
            if n == 1:
                out[some[0][0], k] += v[0]
            else:  # whole groups
                out[[i for i, _ in some], k] += v
    for i in large:
        pairs = x.pairs(n_bins)
        sums = np.zeros((pairs.shape[1], n_bins ** 2), dtype=np.complex128)
        counts = np.zeros(sums.shape, dtype=np.int64)
        for k in range(0, len(groups[i]), 2 * _CHUNK):
            rows = groups[i][k:k + 2 * _CHUNK]
            at = np.take(pairs, rows, axis=0).T.astype(np.intp, order="C")
            v = g[rows] + 1j * h[rows]
            for j in range(len(at)):
                np.add.at(sums[j], at[j], v)
                counts[j] += np.bincount(at[j], minlength=n_bins ** 2)
        for axis, every in ((2, slice(0, None, 2)), (1, slice(1, None, 2))):
            s, c = (t.reshape(-1, n_bins, n_bins).sum(axis)[:len(range(width)[every])] for t in (sums, counts))
            out[i, 0, every], out[i, 1, every], out[i, 2, every] = s.real, s.imag, c
    return out


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


#: Numbers of sums whose cuts are weighed at once.
_WEIGHED = 1 << 15


def best_splits(sums: Sequence[np.ndarray], features: np.ndarray, p: Params) -> list[tuple | None]:
    """(gain, feature, bin, left g, h, n) of each group of :func:`sums_of`, or None."""
    def worth(g, h):
        g = np.maximum(np.abs(g) - p.l1, 0) if p.l1 else g
        h = h + p.l2
        return g * g / (h if p.min_hessian + p.l2 > 0 else np.maximum(h, 1e-300))

    counted = p.min_rows > 1 or p.min_hessian <= 0  # else a side with the least Hessian has a row
    least = p.min_hessian - 1e-9 * (p.min_hessian > 1e-6)  # a sum that is the least Hessian but for rounding is enough
    out: list[tuple | None] = []
    kinds = 3 if counted else 2
    step = max(1, _WEIGHED // max(1, sums[0].size)) if len(sums) else 1
    for some in (sums[i:i + step] for i in range(0, len(sums), step)):
        width, cuts = some[0].shape[1:]
        left = np.empty((kinds, len(some), width, cuts))
        for i, s in enumerate(some):
            np.cumsum(s[:kinds], axis=2, out=left[:, i])
        totals = np.array([s[:, 0, :].sum(-1) for s in some])
        each = totals[:, :, None, None]
        ok = left[1] >= least
        ok &= left[1] <= each[:, 1] - least
        if counted:
            ok &= left[2] >= p.min_rows
            ok &= left[2] <= each[:, 2] - p.min_rows
        ok[:, :, -1] = False
        at = np.flatnonzero(ok)  # gains of the allowed cuts alone: in small nodes these are few
        ends = np.searchsorted(at, np.arange(1, len(some) + 1) * (width * cuts))
        counts = np.diff(ends, prepend=0)
        g, h = left[0].ravel()[at], left[1].ravel()[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            own = [float(worth(G, H)) if H + p.l2 > 0 else 0.0 for G, H, _ in totals]
        gains = worth(g, h) + worth(np.repeat(totals[:, 0], counts) - g, np.repeat(totals[:, 1], counts) - h) - np.repeat(own, counts)
        for i, s in enumerate(some):
            gain = gains[ends[i] - counts[i]:ends[i]]
            if not len(gain):
                out.append(None)
                continue
            top = gain.max()
            value = np.round(top, 9)
            if not value > p.min_gain:
                out.append(None)
                continue
            near = np.flatnonzero(gain >= top - 2e-9 - 1e-12 * abs(top))  # rounding keeps order: the equals of top are among these
            one = int(near[np.round(gain[near], 9) == value][0]) + ends[i] - counts[i]
            f, b = divmod(int(at[one]) - i * width * cuts, cuts)
            out.append((float(value), int(features[f]), b, float(g[one]), float(h[one]), float(s[2, f, :b + 1].sum())))
    return out


class Growth:
    """Best-first growth of one tree from best splits that are asked for in passes."""

    def __init__(self, p: Params, g: float, h: float, n: float):
        self.p = p
        self.stats = [(g, h, n)]
        self.depth = [0]
        self.split: dict[int, tuple | None] = {}
        self.child: dict[int, tuple[int, int]] = {}
        self.known: dict[int, tuple] = {}  # (splits, children, number there) of nodes whose own growth was ended elsewhere

    def adopt(self, v: int, splits: dict, children: dict, u: int = 0) -> None:
        """Best splits of node v and below it from a growth that began at v's rows (or passed them as its node u)."""
        self.split[v] = splits[u]
        self.known[v] = splits, children, u

    def chosen(self) -> list[int]:
        """The nodes that would be split, the best gains first, by what is known."""
        free = 0 <= self.p.depth and self.p.leaves >= 1 << self.p.depth  # no order to decide: the depth alone ends growth
        out: list[int] = []
        heap = [(-self.split[0][0], 0)] if self.split.get(0) else []
        while heap and (free or len(out) + 1 < self.p.leaves):
            _, v = heapq.heappop(heap)
            out.append(v)
            for c in self.child.get(v, ()):
                if self.split.get(c):
                    heapq.heappush(heap, (-self.split[c][0], c))
        return out

    def wanted(self) -> list[int]:
        """Nodes whose best split has to be known next; empty when the tree is done."""
        if 0 not in self.split:
            return [0] if self._may_split(0) else self._none(0)
        while True:
            out, adopted = [], False
            for v in self.chosen():
                if v not in self.child:
                    _, _, _, g, h, n = self.split[v]
                    G, H, N = self.stats[v]
                    self.child[v] = (len(self.stats), len(self.stats) + 1)
                    self.stats += [(g, h, n), (G - g, H - h, N - n)]
                    self.depth += [self.depth[v] + 1] * 2
                    splits, children, u = self.known.get(v, ({}, {}, 0))
                    for c, w in zip(self.child[v], children.get(u, ())):
                        if w in splits:
                            self.adopt(c, splits, children, w)
                            adopted = True
                out += [c for c in self.child[v] if c not in self.split and (self._may_split(c) or self._none(c))]
            if not adopted:
                return out

    def _may_split(self, v: int) -> bool:
        _, h, n = self.stats[v]  # both sides need their least rows and Hessian (less what rounding may take)
        return n >= 2 * self.p.min_rows and h >= 2 * self.p.min_hessian - 1e-6 and (self.p.depth < 0 or self.depth[v] < self.p.depth)

    def _none(self, v: int) -> list:
        self.split[v] = None
        return []

    def tree(self, whole: bool) -> dict:
        """Arrays of the nodes so far (``whole``: every split that was made, for finding rows), or of the grown tree."""
        inner = set(self.child) if whole else set(self.chosen())
        order, place = [0], {0: 0}
        for v in order:
            if v in inner:
                for c in self.child[v]:
                    place[c] = len(order)
                    order.append(c)
        def leaf(v):
            g, h, _ = self.stats[v]
            return float(-shrunk(np.float64(g), self.p.l1) / max(h + self.p.l2, 1e-300)) * self.p.step
        return {"node": order, "feature": [self.split[v][1] if v in inner else -1 for v in order],
                "bin": [self.split[v][2] if v in inner else 0 for v in order],
                "left": [place[self.child[v][0]] if v in inner else -1 for v in order],
                "right": [place[self.child[v][1]] if v in inner else -1 for v in order],
                "value": [leaf(v) for v in order], "gain": [self.split[v][0] if v in inner else 0.0 for v in order],
                "rows": [int(round(self.stats[v][2])) for v in order]}


def parted(x: np.ndarray, rows: np.ndarray, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a node that go left and right, each in order; x holds bins in columns."""
    left = np.take(x[:, feature], rows) <= cut
    return rows.compress(left), rows.compress(~left)


def rows_of(tree: dict, x: np.ndarray, rows: np.ndarray, places: Sequence[int] | None = None) -> dict[int, np.ndarray]:
    """The rows at each of the places of a tree's arrays (all leaves if None), from the root down."""
    feature, cut, left, right = (tree[k] for k in ("feature", "bin", "left", "right"))
    if places is None:
        wanted, above = None, None
    else:  # only ways to the wanted places are followed; a child lies behind its parent
        wanted, above = set(places), set(places)
        for v in range(len(feature) - 1, -1, -1):
            if feature[v] >= 0 and (left[v] in above or right[v] in above):
                above.add(v)
    out, stack = {}, [(0, rows)]
    while stack:
        v, here = stack.pop()
        if above is not None and v not in above:
            continue
        if feature[v] < 0 if wanted is None else v in wanted:
            out[v] = here
        if feature[v] >= 0:
            a, b = parted(x, here, feature[v], cut[v])
            stack += [(left[v], a), (right[v], b)]
    return out


#: Rows a node of a tree from which a node's rows go down together.
_ROWS_A_NODE = 20


def descend(tree: dict, x: np.ndarray) -> np.ndarray:
    """The place of each row's leaf in a tree's arrays; x holds bins."""
    at = np.zeros(len(x), dtype=np.int64)
    if len(x) < _ROWS_A_NODE * len(tree["feature"]):  # all rows a level down at once: nodes with few rows aren't worth a call each
        feature, cut, left, right = (np.asarray(tree[k]) for k in ("feature", "bin", "left", "right"))
        here = np.flatnonzero(feature[at] >= 0)
        while len(here):
            v = at[here]
            at[here] = np.where(x[here, feature[v]] <= cut[v], left[v], right[v])
            here = here[feature[at[here]] >= 0]
        return at
    for v, rows in rows_of(tree, np.asfortranarray(x), np.arange(len(x))).items():
        at[rows] = v
    return at


def added(tree: dict, x: np.ndarray) -> np.ndarray:
    return np.asarray(tree["value"])[descend(tree, x)]


def start_margin(p: Params, n_pos: float, n_neg: float) -> float:
    if p.start == "zero" or not n_pos or not n_neg:
        return 0.0
    return float(np.log(n_pos * p.pos_weight / n_neg))


def losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(y == 1, -margin, margin))


def average_precision(margin: np.ndarray, y: np.ndarray) -> float:
    """Step sum over distinct scores."""
    if not y.sum():
        return 0.0
    order = np.argsort(-margin, kind="stable")
    m, hit = margin[order], y[order].astype(np.float64)
    ends = np.append(np.flatnonzero(np.diff(m)), len(m) - 1)
    tp = np.cumsum(hit)[ends]
    return float((np.diff(tp, prepend=0) * tp / (ends + 1)).sum() / hit.sum())


#: Sums of nodes that may still be split are kept up to so many bytes a tree; other nodes' children are both summed.
HELD_BYTES = 64 << 20


def grown(growth: Growth, part: np.ndarray | Bins, features: np.ndarray, g: np.ndarray, h: np.ndarray, here: np.ndarray) -> Growth:
    """The growth, ended, from its root's rows; ``part`` holds the bins of ``features`` in columns.

    Of two children the one of fewer rows is summed; the other's sums are the parent's less these."""
    n_bins = growth.p.bins + 1
    bins = part if isinstance(part, Bins) else Bins(part)
    room = HELD_BYTES // (24 * max(1, len(features)) * n_bins)
    rows, held = {0: here}, {}  # of nodes without children
    while wanted := growth.wanted():
        asked, summed, less = set(wanted), {}, []  # summed: nodes in order
        apart = [v for v in rows if v in growth.child]
        for v in apart:
            _, f, b, *_ = growth.split[v]
            rows |= zip(growth.child[v], parted(bins.columns, rows.pop(v), int(np.searchsorted(features, f)), b))
            few, many = sorted(growth.child[v], key=lambda c: len(rows[c]))
            if many in asked and v in held:
                summed[few] = None
                less.append((many, few, v))
            else:
                summed |= dict.fromkeys(c for c in (few, many) if c in asked)
        summed |= dict.fromkeys(asked - summed.keys() - {m for m, _, _ in less})
        sums = dict(zip(summed, sums_of(bins, g, h, [rows[v] for v in summed], n_bins)))
        for many, few, v in less:
            rest = held[v] - sums[few]
            rest[:2] *= rest[2] > 0  # a bin without rows has no remainder
            sums[many] = rest
        for v in apart:
            held.pop(v, None)
        growth.split |= dict(zip(wanted, best_splits([sums[v] for v in wanted], features, growth.p)))
        for v in wanted:
            if growth.split[v] and len(held) < room:
                held[v] = sums[v]
    return growth


def grown_alone(p: Params, turn: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray, margin: np.ndarray,
                by_row: np.ndarray | None = None) -> dict:
    """One round's tree from rows that are all here; ``by_row``: their bins with a row's side by side, if at hand."""
    x = np.asfortranarray(x)
    g, h = derivatives(margin, y, p.pos_weight)
    here = np.flatnonzero(uniform(ids, p.seed, turn) < p.row_share)
    features = features_of(p, turn, x.shape[1])
    part = x if len(features) == x.shape[1] else np.asfortranarray(x[:, features])
    growth = Growth(p, float(g[here].sum()), float(h[here].sum()), len(here))
    bins = Bins(part, by_row, features if part is not x and by_row is not None else None)
    return grown(growth, bins, features, g, h, here).tree(False)


# ---- rows in blocks

_ROWS = "cell string, block int, ids binary, part binary, y binary, x binary, margin binary"
_STATE = _ROWS + ", trees string, losses array<double>"


def _arrays(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return {"ids": ids, "part": np.frombuffer(row["part"], dtype=np.int8), "y": np.frombuffer(row["y"], dtype=np.int8),
            "x": np.frombuffer(row["x"], dtype=np.uint8).reshape(-1, len(ids)).T, "margin": np.frombuffer(row["margin"], dtype=np.float64)}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def binned(x: np.ndarray, edges: Sequence[np.ndarray], missing: int) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), missing, np.searchsorted(e, x[:, j], side="left"))
    return out


def edges_of(rows: DataFrame, bins: dict[str, int], widths: dict[str, int]) -> dict[str, list[np.ndarray]]:
    """Bin edges of each cell and feature from its training rows (cell, part, x), in one aggregate."""
    most = max(bins.values())
    probabilities = [i / most for i in range(1, most)]
    each = rows.where("part = 0").select("cell", F.posexplode("x").alias("feature", "value")).where(~F.isnan("value"))
    got = each.groupBy("cell", "feature").agg(F.percentile_approx("value", probabilities, 20_000).alias("edges"))
    out = {c: [np.zeros(0)] * width for c, width in widths.items()}
    for r in got.toArrow().to_pylist():  # one row a cell and feature
        e = np.unique(np.asarray(r["edges"], dtype=np.float64))
        out[r["cell"]][r["feature"]] = e if bins[r["cell"]] == most else e[:: max(1, -(-len(e) // (bins[r["cell"]] - 1)))]
    return out


@dataclass
class Boosted:
    """A fitted model: trees over bins, their edges and the margin before the first tree."""

    trees: list[dict]
    edges: list[np.ndarray]
    start: float
    params: Params
    losses: list[float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges, self.params.bins)
        return self.start + sum((added(t, b) for t in self.trees), np.zeros(len(x)))

    def first(self, n: int) -> Boosted:
        return replace(self, trees=self.trees[:n])


def best_round(values: Sequence[float], patience: int | None) -> tuple[int, bool]:
    """(rounds up to the lowest loss before ``patience`` rounds without a lower one, whether it stopped there)."""
    best = 0
    for i, v in enumerate(values):
        if v < values[best]:
            best = i
        elif patience is not None and i - best >= patience:
            return best + 1, True
    return best + 1, False


def pack(rows: DataFrame, cells: dict[str, Params], block_rows: int | None = None, sets: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """(blocks, facts by cell) of rows (cell, id, part, y, x); ``sets``: see :func:`fit_cells`.

    The rows of a set are counted, binned and packed once, whatever the number of its cells."""
    sets = sets or {c: c for c in cells}
    of_set: dict[tuple, list[str]] = {}  # cells whose blocks are the same but for the margin
    for c, p in cells.items():
        of_set.setdefault((sets[c], p.bins), []).append(c)
    first = {some[0]: name for (name, _), some in of_set.items()}  # packed rows go by the name of the first of their cells
    if any(c != name for c, name in first.items()):
        rows = reduce(DataFrame.unionByName, [rows.where(F.col("cell") == name).withColumn("cell", F.lit(c)) for c, name in first.items()])
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), *[
        F.count(F.when((F.col("part") == 0) & (F.col("y") == k), 1)).alias(f"n{k}") for k in (0, 1)]).collect()  # one row a set
    edges = edges_of(rows, {c: cells[c].bins for c in first}, {r["cell"]: r["width"] for r in sizes})
    unit = block_rows or BLOCK_ROWS
    alone = block_rows or max(ROWS_ALONE, BLOCK_ROWS)
    facts = {}
    for some in of_set.values():
        for r in (r for r in sizes if r["cell"] == some[0]):
            n = r["n"]
            facts |= {c: {"rows": n, "alone": n <= alone, "blocks": -(-n // unit) if n <= alone else -(-n // max(1, unit // PARTS)),
                          "edges": edges[some[0]], "start": start_margin(cells[c], r["n1"], r["n0"])} for c in some}
    n_blocks = F.create_map(*[F.lit(v) for c in first if c in facts for v in (c, facts[c]["blocks"])])
    keyed = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(11), "id"), n_blocks[F.col("cell")]).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        cell = table["cell"][0].as_py()
        f = facts[cell]
        column = table["x"].combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        row = {"cell": cell, "block": table["block"][0].as_py(), "ids": table["id"].to_numpy().astype(np.int64).tobytes(),
               "part": table["part"].to_numpy().astype(np.int8).tobytes(), "y": table["y"].to_numpy().astype(np.int8).tobytes(),
               "x": binned(x, f["edges"], cells[cell].bins).T.tobytes(), "margin": b""}
        return pa.Table.from_batches([_batch([row], _ROWS)])

    def started(batches):  # a block of each cell of the set
        for b in batches:
            for row in b.to_pylist():
                for c in next(some for some in of_set.values() if some[0] == row["cell"]):
                    yield _batch([row | {"cell": c, "margin": np.full(len(row["y"]), facts[c]["start"]).tobytes()}], _ROWS)

    blocks = keyed.groupBy("cell", "block").applyInArrow(packed, _ROWS).mapInArrow(started, _ROWS)
    # the blocks of all cells are dealt out evenly, to a task a core or to tasks of a few blocks
    counts = [f["blocks"] for f in facts.values()]
    before = F.create_map(*[F.lit(v) for c, n in zip(facts, np.cumsum([0, *counts]).tolist()) for v in (c, n)])
    tasks = max(1, min(sum(counts), max(rows.sparkSession.sparkContext.defaultParallelism, -(-sum(counts) // BLOCKS_A_TASK))))
    return blocks.repartitionById(tasks, ((before[F.col("cell")] + F.col("block")) % tasks).cast("int")), facts


# ---- rounds

def _joined(rows: list[dict]) -> dict:
    """The arrays of a cell's blocks as those of one block, by id."""
    blocks = [_arrays(r) for r in sorted(rows, key=lambda r: r["block"])]
    if len(blocks) == 1:
        return blocks[0]
    out = {k: np.concatenate([a[k].T if k == "x" else a[k] for a in blocks], axis=-1) for k in blocks[0]}
    by_id = np.argsort(out["ids"], kind="stable")
    for k, v in out.items():
        out[k] = np.take(v, by_id, axis=-1)
    return out | {"x": out["x"].T}


def _alone(cells: dict[str, Params], turn: int, n: int):
    """A task's cells, ``n`` rounds further (fewer if a cell's rounds or patience end)."""

    def run(batches):
        mine: dict[str, list[dict]] = {}
        for b in batches:
            for row in b.to_pylist():
                mine.setdefault(row["cell"], []).append(row)
        for cell in list(mine):
            p, a = cells[cell], _joined(mine.pop(cell))
            train, held = np.flatnonzero(a["part"] == 0), np.flatnonzero(a["part"] == 1)
            margin, trees, found = a["margin"].copy(), [], []
            by_row = np.ascontiguousarray(a["x"][train])
            x, y, ids = np.asfortranarray(by_row), a["y"][train], a["ids"][train]
            for r in range(turn, min(turn + n, p.rounds)):
                tree = grown_alone(p, r, x, y, ids, margin[train], by_row)
                margin += added(tree, a["x"])
                trees.append(tree)
                if len(held):
                    found.append(-average_precision(margin[held], a["y"][held]) if p.metric == "average_precision"
                                 else float(losses(margin[held], a["y"][held]).mean()))
            for k in range(0, max(1, len(margin)), BLOCK_ROWS):  # the first block tells the trees
                part = {name: v[k:k + BLOCK_ROWS] for name, v in (a | {"margin": margin}).items()}
                yield _batch([{"cell": cell, "block": k // BLOCK_ROWS, "trees": "" if k else json.dumps(trees), "losses": [] if k else found}
                              | {name: (v.T if name == "x" else v).tobytes() for name, v in part.items()}], _STATE)
    return run


def _decoded(rows):
    for row in rows:
        yield row["cell"], _arrays(row)


def _sums(cells: dict[str, Params], turn: int, later: dict[str, list], growing: dict[str, tuple], keys: dict[tuple, int]):
    """(number of the cell and node in ``keys``, sums) of the wanted nodes of each growing cell, one a task; of
    nodes to be grown whole the rows instead, (bins, g, h) a block."""

    def run(blocks):
        total: dict[str, np.ndarray] = {}
        for cell, a in blocks:
            if cell not in growing:
                continue
            p, x = cells[cell], a["x"]
            tree, wanted, whole = growing[cell]
            margin = a["margin"] + sum((added(t, x) for t in later[cell]), np.zeros(len(x)))
            g, h = derivatives(margin, a["y"], p.pos_weight)
            places = [tree["node"].index(v) for v in wanted]
            at = rows_of(tree, x, np.flatnonzero((a["part"] == 0) & (uniform(a["ids"], p.seed, turn) < p.row_share)), places)
            features = features_of(p, turn, x.shape[1])
            part = x if len(features) == x.shape[1] else x[:, features]
            for v, place in zip(wanted, places):
                if v in whole and len(at[place]):
                    yield keys[cell, v], (part[at[place]], g[at[place]], h[at[place]])
            if len(whole) == len(wanted):
                continue
            got = sums_of(part, g, h, [at[place] for v, place in zip(wanted, places) if v not in whole], p.bins + 1)
            total[cell] = total[cell] + got if cell in total else got
        for cell, s in total.items():
            for v, one in zip((v for v in growing[cell][1] if v not in growing[cell][2]), s):
                yield keys[cell, v], one
    return run


def _splits(cells: dict[str, Params], turn: int, widths: dict[str, int], names: list[tuple]):
    """(cell, node, (g, h, n), best splits and children of the node and those below it) from what :func:`_sums`
    gives of a task's nodes (``names``: cell, node, depth); sums are added up as they come and tell the node's
    own split alone."""

    def run(sums):
        total: dict[int, np.ndarray] = {}
        rows: dict[int, list] = {}
        for key, s in sums:
            if isinstance(s, tuple):
                rows.setdefault(key, []).append(s)
            else:
                total[key] = total[key] + s if key in total else s
        for key, t in total.items():
            cell, node, _ = names[key]
            split = best_splits(t[None], features_of(cells[cell], turn, widths[cell]), cells[cell])[0]
            yield cell, node, tuple(float(v) for v in t[:, 0].sum(-1)), {0: split}, {}
        for key, blocks in rows.items():
            cell, node, depth = names[key]
            p = cells[cell]
            part, g, h = (np.concatenate(c) for c in zip(*blocks))
            top = Growth(replace(p, depth=p.depth - depth) if p.depth >= 0 else p, float(g.sum()), float(h.sum()), len(g))
            grown(top, np.asfortranarray(part), features_of(p, turn, widths[cell]), g, h, np.arange(len(g)))
            yield cell, node, top.stats[0], top.split, top.child
    return run


def _together(rows: DataFrame, cells: dict[str, Params], turn: int, n: int, widths: dict[str, int]) -> dict[str, list]:
    """The trees of ``n`` rounds of all cells, each pass one job for all of them.

    There are hundreds of passes and each is short, so they are RDD jobs over the decoded blocks: planning
    a query and starting its stages one by one would take longer than the sums."""
    blocks = rows.rdd.mapPartitions(_decoded).persist(StorageLevel.MEMORY_AND_DISK)
    cores = max(1, blocks.context.defaultParallelism)
    later: dict[str, list] = {c: [] for c in cells}
    small = {}
    for c, p in cells.items():  # a node's rows that weigh no more than the tasks' sums of it
        d = len(features_of(p, turn, widths[c]))
        small[c] = min(ROWS_WHOLE, blocks.getNumPartitions() * 24 * d * (p.bins + 1) // (d + 16))
    for r in range(turn, turn + n):
        live = [c for c, p in cells.items() if r < p.rounds]
        growth: dict[str, Growth | None] = dict.fromkeys(live)
        wants: dict[str, list[int]] = {c: [0] for c in live}
        while wants:
            root = {"node": [0], "feature": [-1], "bin": [0], "left": [-1], "right": [-1], "value": [0.0]}
            growing = {c: (growth[c].tree(True) if growth[c] else root, w, {v for v in w if growth[c] and growth[c].stats[v][2] <= small[c]})
                       for c, w in wants.items()}
            names = [(c, v, growth[c].depth[v] if growth[c] else 0) for c, w in wants.items() for v in w]
            sums = blocks.mapPartitions(_sums(cells, r, later, growing, {k[:2]: i for i, k in enumerate(names)}))
            found = sums.partitionBy(min(len(names), cores), int).mapPartitions(_splits(cells, r, widths, names))
            for c, v, stats, splits, children in found.collect():  # one row a cell and node
                if growth[c] is None:
                    growth[c] = Growth(cells[c], *stats)
                    if not growth[c]._may_split(0):
                        splits = {0: None}
                growth[c].adopt(v, splits, children)
            wants = {c: w for c in wants if growth[c] is not None and (w := growth[c].wanted())}
        for c in live:
            later[c].append(growth[c].tree(False) if growth[c] else Growth(cells[c], 0.0, 0.0, 0).tree(False))
    blocks.unpersist()
    return later


def _moved(later: dict[str, list]):
    """Blocks with their margins after the new trees, and the sum and count of each round's validation losses."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                a = _arrays(row)
                held = np.flatnonzero(a["part"] == 1)
                margin, found = a["margin"].copy(), []
                for tree in later[row["cell"]]:
                    margin = margin + added(tree, a["x"])
                    found.append(float(losses(margin[held], a["y"][held]).sum()))
                yield _batch([row | {"margin": margin.tobytes(), "trees": "", "losses": [float(len(held)), *found]}], _STATE)
    return run


def _held_scores(later: dict[str, list]):
    """(cell, round, score, y) of each validation row and round."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                a = _arrays(row)
                held = np.flatnonzero(a["part"] == 1)
                margin = a["margin"][held].copy()
                for i, tree in enumerate(later[row["cell"]]):
                    margin = margin + added(tree, a["x"][held])
                    yield pa.RecordBatch.from_arrays([pa.array([row["cell"]] * len(held), pa.string()), pa.array(np.full(len(held), i)),
                                                      pa.array(margin), pa.array(a["y"][held].astype(np.int64))],
                                                     names=["cell", "round", "score", "y"])
    return run


def fit_cells(rows: DataFrame, cells: dict[str, Params], state: str | None = None, block_rows: int | None = None,
              rounds_alone: int = ROUNDS_ALONE, rounds_together: int = ROUNDS_TOGETHER, sets: dict[str, str] | None = None) -> dict[str, Boosted]:
    """The model of each cell of ``rows`` (cell, id, part: 0 training, 1 validation, y, x array).

    ``state``: a shared folder; blocks of rounds that it holds are not fitted again. With ``patience`` a cell
    stops that many rounds after its best validation loss and its model is cut to the best round. ``sets``: the name
    that a cell's rows have in the column ``cell``, where cells share rows (its own name otherwise). ``block_rows``: rows
    of a block instead of BLOCK_ROWS, and the most of a cell that one task fits."""
    spark = rows.sparkSession
    ship_package(spark)
    state = state or scratch_path(spark, "boosting")
    at = _written(spark, state)
    if at is None:
        blocks, facts = pack(rows.where(F.col("cell").isin(*(sets.values() if sets else cells))), cells, block_rows, sets)
        blocks.withColumn("trees", F.lit("")).withColumn("losses", F.array().cast("array<double>")).write.mode("overwrite").parquet(
            f"{state}/rows-0")
        book = {"at": 0, "cells": {c: {"rows": f["rows"], "alone": f["alone"], "start": f["start"], "edges": [e.tolist() for e in f["edges"]],
                                       "trees": [], "losses": [], "stopped": False} for c, f in facts.items()}}
        _write_book(spark, state, book)
    else:
        book = at
    while True:
        live = {c: p for c, p in cells.items() if not book["cells"][c]["stopped"] and len(book["cells"][c]["trees"]) < p.rounds}
        if not live:
            break
        book = _next_block(spark, state, book, live, rounds_alone, rounds_together)
    out = {}
    for c, p in cells.items():
        f = book["cells"][c]
        model = Boosted(f["trees"][:p.rounds], [np.asarray(e) for e in f["edges"]], f["start"], p, f["losses"][:p.rounds])
        out[c] = model.first(best_round(model.losses, p.patience)[0]) if p.patience is not None and model.losses else model
    return out


def _next_block(spark: SparkSession, state: str, book: dict, live: dict[str, Params], rounds_alone: int, rounds_together: int) -> dict:
    """One block of rounds of the live cells, written."""
    turn = min(len(book["cells"][c]["trees"]) for c in live)
    live = {c: p for c, p in live.items() if len(book["cells"][c]["trees"]) == turn}  # others were asked for fewer rounds before
    alone = {c: p for c, p in live.items() if book["cells"][c]["alone"]}
    many = {c: p for c, p in live.items() if c not in alone}
    n = rounds_together if many else rounds_alone
    rows = spark.read.schema(_STATE).parquet(f"{state}/rows-{book['at']}")
    written = f"{state}/rows-{book['at'] + 1}"
    parts = []
    if alone:
        # a task a cell: a cell's block of rounds is the unit of work; the longest begin first (a leaf takes about as long as 500 rows)
        first = sorted(alone, key=lambda c: (-book["cells"][c]["rows"] - 500 * alone[c].leaves, c))
        order = F.create_map(*[F.lit(v) for i, c in enumerate(first) for v in (c, i)])
        mine = rows.where(F.col("cell").isin(*alone)).repartitionById(len(alone), order[F.col("cell")])
        parts.append(mine.mapInArrow(_alone(alone, turn, n), _STATE))
    precise: dict[tuple, float] = {}
    if many:
        mine = rows.where(F.col("cell").isin(*many))
        later = _together(mine, many, turn, n, {c: len(book["cells"][c]["edges"]) for c in many})
        by_rank = [c for c, p in many.items() if p.metric == "average_precision"]
        if by_rank:
            from notewise.operators import metrics as me
            held = mine.where(F.col("cell").isin(*by_rank)).mapInArrow(_held_scores(later), "cell string, round long, score double, y long")
            ap = me.average_precision(me.pr_curve(held, group_cols=["cell", "round"]), ["cell", "round"])
            precise = {(r["cell"], r["round"]): -float(r["average_precision"] or 0) for r in ap.collect()}  # cells x rounds
        parts.append(mine.mapInArrow(_moved(later), _STATE))
    idle = [c for c in book["cells"] if c not in live]
    if idle:
        parts.append(rows.where(F.col("cell").isin(*idle)).withColumn("trees", F.lit("")).withColumn("losses", F.array().cast("array<double>")))
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(written)
    # what the driver reads back: the new trees of cells of one block, and a few sums a block
    new = {"at": book["at"] + 1, "cells": {c: f | {"trees": list(f["trees"]), "losses": list(f["losses"])} for c, f in book["cells"].items()}}
    got = spark.read.schema(_STATE).parquet(written).select("cell", "trees", "losses").where(F.col("cell").isin(*live))
    sums: dict[str, np.ndarray] = {}
    for r in got.toLocalIterator():
        f = new["cells"][r["cell"]]
        if r["cell"] in alone:
            f["trees"] += json.loads(r["trees"]) if r["trees"] else []
            f["losses"] += list(r["losses"])
        else:
            sums[r["cell"]] = sums.get(r["cell"], 0) + np.asarray(r["losses"])
    for c in many:
        new["cells"][c]["trees"] += later[c]
        if sums[c][0]:
            rank = many[c].metric == "average_precision"
            new["cells"][c]["losses"] += [precise[c, i] if rank else float(s / sums[c][0]) for i, s in enumerate(sums[c][1:])]
    for c, p in live.items():
        f = new["cells"][c]
        f["stopped"] = p.patience is not None and bool(f["losses"]) and best_round(f["losses"], p.patience)[1]
    _write_book(spark, state, new, book)
    _drop(spark, f"{state}/rows-{book['at']}")
    return new


def _write_book(spark: SparkSession, state: str, book: dict, before: dict | None = None) -> None:
    """What a block of rounds added to the models of the books ``before``; the newest complete book counts, with all before it."""
    lines = []
    for c, f in book["cells"].items():
        if before is not None:
            old = before["cells"][c]
            f = {"stopped": f["stopped"], "trees": f["trees"][len(old["trees"]):], "losses": f["losses"][len(old["losses"]):]}
        lines.append((book["at"], c, json.dumps(f)))
    spark.createDataFrame(lines, "at int, cell string, facts string").coalesce(1).write.mode("overwrite").parquet(f"{state}/book-{book['at']}")


def _written(spark: SparkSession, state: str) -> dict | None:
    """The newest book of a state folder whose rows are there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(x.split("-")[1]) for x in names if x.startswith("book-") and f"rows-{x.split('-')[1]}" in names
            and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{state}/{x}/_SUCCESS"))]
    if not done:
        return None
    at = max(done)
    lines = spark.read.parquet(*[f"{state}/book-{i}" for i in range(at + 1)]).collect()  # a line a cell and block of rounds
    cells: dict[str, dict] = {}
    for r in sorted(lines, key=lambda r: r["at"]):
        f, new = cells.setdefault(r["cell"], {"trees": [], "losses": []}), json.loads(r["facts"])
        cells[r["cell"]] = f | new | {"trees": f["trees"] + new["trees"], "losses": f["losses"] + new["losses"]}
    return {"at": at, "cells": cells}


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---- one model

def as_rows(df: DataFrame, cell: str, part: int, features: str = "features", label: str = "y", key: str = "note_id") -> DataFrame:
    """Rows of one cell as :func:`fit_cells` takes them; ``features`` is an array or an ML vector."""
    x = F.col(features)
    if df.schema[features].dataType.typeName() != "array":
        x = vector_to_array(x)
    x = F.transform(x.cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan"))))
    return df.select(F.lit(cell).alias("cell"), F.col(key).cast("long").alias("id"), F.lit(part).alias("part"),
                     F.col(label).cast("int").alias("y"), x.alias("x"))


def fit(train: DataFrame, params: Params, validation: DataFrame | None = None, state: str | None = None, **columns) -> Boosted:
    rows = as_rows(train, "one", 0, **columns)
    if validation is not None:
        rows = rows.unionByName(as_rows(validation, "one", 1, **columns))
    return fit_cells(rows, {"one": params}, state)["one"]


def _column(df: DataFrame, features: str):
    is_array = df.schema[features].dataType.typeName() == "array"
    return F.col(features).cast("array<double>") if is_array else vector_to_array(F.col(features))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def predict(model: Boosted, df: DataFrame, features: str = "features", out_col: str = "score") -> DataFrame:
    """``df`` with the probability of class 1; the model (bounded by trees x leaves) is broadcast once."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-shared.value.margins(_matrix(x)))) if len(x) else [], dtype="float64")
    return df.withColumn(out_col, score(_column(df, features)))


def predict_cells(models: dict, rows: DataFrame) -> DataFrame:
    """cell, id, y, score of rows (cell, id, part, y, x), each by its own cell's model (anything with ``margins``)."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            names = np.array(b.column("cell").to_pylist(), dtype=object)
            for cell in dict.fromkeys(names):
                part = b.filter(pa.array(names == cell))
                x = np.array(part.column("x").to_pylist(), dtype=np.float64)
                score = 1 / (1 + np.exp(-shared.value[cell].margins(x)))
                yield pa.RecordBatch.from_arrays([part.column("cell"), part.column("id"), part.column("y"), pa.array(score)],
                                                 names=["cell", "id", "y", "score"])
    return rows.select("cell", "id", "y", "x").mapInArrow(run, "cell string, id long, y int, score double")


def importance(model: Boosted, spark: SparkSession) -> DataFrame:
    """feature, gain (total of its splits), splits, importance (share of all gain), the greatest first."""
    gain, splits = np.zeros(len(model.edges)), np.zeros(len(model.edges), dtype=int)
    for t in model.trees:
        for f, g in zip(t["feature"], t["gain"]):
            if f >= 0:
                gain[f] += g
                splits[f] += 1
    total = gain.sum() or 1.0
    rows = [(i, float(g), int(s), float(g / total)) for i, (g, s) in enumerate(zip(gain, splits))]
    return spark.createDataFrame(rows, "feature int, gain double, splits int, importance double").orderBy(F.desc("gain"), "feature")


def settings(model: Boosted) -> dict:
    return asdict(model.params)
