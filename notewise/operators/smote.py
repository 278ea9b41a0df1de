"""SMOTE: exact k nearest minority neighbours and synthetic interpolation.

Neighbour search compares blocks of rows, and only those that can matter:

1. every row is keyed by its nearest pivot (chosen farthest-first from a bounded sample) and its
   distance to it; ranges of (pivot, distance) are cut into blocks of at most ``block_rows`` rows,
   so a crowd of near rows fills blocks of its own, whatever its size;
2. a block's vectors are packed into one row (ids and one matrix) with the least and greatest
   distance of its rows to every pivot; by the triangle inequality two blocks are at least as far
   apart as these ranges are, for the pivot that tells most;
3. each block is searched in itself first, which bounds its rows' k-th distances (for a block of
   few rows, the nearest blocks' sizes and ranges do);
4. a pair of blocks is joined only where the bound between them doesn't exceed the greatest k-th
   distance of one of them, and searched only in the directions that need it, with numpy
   (float64, row chunks); only each row's local top-k is emitted;
5. a window per query row keeps the global top-k.

In the worst case (no structure at all) that is every pair of blocks once. What the driver and the
tasks that list the pairs hold is two numbers a pivot and block (of 4,096 rows by default).

Distances are ranked by ``round(distance, 9)`` then neighbour id, so the
result is exact and reproducible by SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.functions.numeric import hash_fraction, hash_unit, interpolate_vector
from notewise.operators.sampling import exact_sample
from notewise.session import materialize, ship_package

NEIGHBOR_SCHEMA = "i long, j long, distance double"


def _exact_rows(qv, qi, cv, ci, k):
    """Full exact k-NN for a few query rows (direct differences)."""
    out_i, out_j, out_d = [], [], []
    for r in range(len(qi)):
        d = np.sqrt(((cv - qv[r]) ** 2).sum(axis=1))
        d[ci == qi[r]] = np.inf
        order = np.lexsort((ci, np.round(d, 9)))
        order = order[np.isfinite(d[order])][:k]
        out_i.append(np.full(len(order), qi[r], np.int64))
        out_j.append(ci[order])
        out_d.append(d[order])
    return out_i, out_j, out_d


def _local_topk(k: int, extra: int = 8, chunk: int = 512, tol: float = 1e-6):
    """Exact local top-k of each query row against one candidate block.

    A matrix product (``|a|^2 + |b|^2 - 2ab``) shortlists ``k + extra``
    candidates per row; their distances are recomputed exactly and ranked by
    (distance rounded to 9 places, id). A row whose shortlist boundary lies
    within ``tol`` of its k-th exact distance (ties, duplicates) is redone
    with the full exact computation, so the result never depends on the
    shortlist size."""
    def run(qi: np.ndarray, qv: np.ndarray, ci: np.ndarray, cv: np.ndarray) -> pd.DataFrame:
        empty = pd.DataFrame({"i": pd.Series([], dtype="int64"), "j": pd.Series([], dtype="int64"),
                              "distance": pd.Series([], dtype="float64")})
        cn = (cv * cv).sum(axis=1)
        n_c = len(ci)
        m = min(k + extra, n_c)
        out_i, out_j, out_d = [], [], []
        for s in range(0, len(qi), chunk):
            qs, ids = qv[s:s + chunk], qi[s:s + chunk]
            g = (qs * qs).sum(axis=1)[:, None] + cn[None, :] - 2.0 * (qs @ cv.T)
            g[ids[:, None] == ci[None, :]] = np.inf
            cand = np.argpartition(g, m - 1, axis=1)[:, :m] if m < n_c else \
                np.broadcast_to(np.arange(n_c), (len(ids), n_c))
            diff = qs[:, None, :] - cv[cand]
            d = np.sqrt(np.einsum("abk,abk->ab", diff, diff))
            d[ci[cand] == ids[:, None]] = np.inf
            order = np.lexsort((ci[cand], np.round(d, 9)), axis=1)[:, :k]
            rows = np.arange(len(ids))[:, None]
            d_top, j_top = d[rows, order], ci[cand][rows, order]
            # Safe when every candidate left out is farther than the k-th kept.
            kth = d_top[:, -1]
            if m < n_c:
                g_out = np.take_along_axis(g, cand, axis=1).max(axis=1)
                unsafe = np.sqrt(np.maximum(g_out, 0.0)) <= kth + tol
            else:
                unsafe = np.zeros(len(ids), bool)
            safe = ~unsafe
            ds, js = d_top[safe], j_top[safe]
            ii = np.broadcast_to(ids[safe][:, None], ds.shape)
            keep = np.isfinite(ds)
            out_i.append(ii[keep])
            out_j.append(js[keep])
            out_d.append(ds[keep])
            if unsafe.any():
                a, b, c_ = _exact_rows(qs[unsafe], ids[unsafe], cv, ci, k)
                out_i += a
                out_j += b
                out_d += c_
        if not out_i:
            return empty
        return pd.DataFrame({"i": np.concatenate(out_i), "j": np.concatenate(out_j),
                             "distance": np.concatenate(out_d)})
    return run


#: Rows that pivots are chosen from, and how many pivots.
SAMPLE_ROWS, PIVOTS = 2048, 32


def _farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of x, each the farthest from those before it."""
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _keyed(base: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """i, v with the nearest pivot p and the distance r to it."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = _to_pivots(np.stack(pdf["v"].to_numpy()).astype(np.float64), pivots)
                yield pd.DataFrame({"i": pdf["i"], "v": pdf["v"], "p": d.argmin(axis=1).astype(np.int32), "r": d.min(axis=1)})
    return base.mapInPandas(run, f"i long, v array<{kind}>, p int, r double")


def _blocks(keyed: DataFrame, n_blocks: int, block_rows: int, pivots: np.ndarray, number) -> DataFrame:
    """One row a block: b, ids, mat, lo and hi (least and greatest distance to each pivot)."""

    def packed(b, ids, vectors):
        x = np.stack(vectors).astype(number)
        d = _to_pivots(x.astype(np.float64), pivots) if len(pivots) else np.zeros((1, 0))
        return pd.DataFrame({"b": [b], "ids": [np.array(ids, np.int64).tobytes()], "mat": [x.tobytes()],
                             "lo": [d.min(axis=0).tobytes()], "hi": [d.max(axis=0).tobytes()]})

    def run(batches):
        number_of, at, ids, vectors = TaskContext.get().partitionId() << 32, None, [], []
        for pdf in batches:
            for i, v, p in zip(pdf["i"], pdf["v"], pdf["p"]):
                if ids and (p != at or len(ids) >= block_rows):
                    yield packed(number_of, ids, vectors)
                    number_of, ids, vectors = number_of + 1, [], []
                at = p
                ids.append(i)
                vectors.append(v)
        if ids:
            yield packed(number_of, ids, vectors)

    if n_blocks > 1:
        dealt = keyed.repartitionByRange(n_blocks, "p", "r", "i")
    else:
        dealt = keyed.repartition(F.pmod(F.xxhash64("i"), F.lit(1)))  # at most a block of rows, by one key
    return dealt.sortWithinPartitions("p", "r", "i").mapInPandas(run, "b long, ids binary, mat binary, lo binary, hi binary")


def _facts(packed: DataFrame, reach: DataFrame) -> dict:
    """Per block, in order of b: ids, rows, reach, and the ranges of distances to the pivots (one row a block)."""
    t = packed.select("b", "lo", "hi", (F.length("ids") / 8).cast("long").alias("rows")).join(reach, "b").orderBy("b").toArrow()
    lo, hi = (np.array([np.frombuffer(v) for v in t[c].to_pylist()]) for c in ("lo", "hi"))
    return {"b": t["b"].to_numpy(), "rows": t["rows"].to_numpy(), "reach": t["reach"].to_numpy(), "lo": lo, "hi": hi}


def _bounded_reach(packed: DataFrame, facts: dict, k: int) -> np.ndarray:
    """The reach of each block, at most the distance within which the blocks nearest to it hold k other rows."""

    def run(batches):
        for pdf in batches:
            out = []
            for b in pdf["b"]:
                at = int(np.searchsorted(facts["b"], b))
                most = (facts["hi"][at] + facts["hi"]).min(axis=1)  # no two rows of the blocks are farther apart
                order = np.argsort(most, kind="stable")
                rows = facts["rows"].copy()
                rows[at] -= 1
                enough = np.flatnonzero(np.cumsum(rows[order]) >= k)
                out.append(min(facts["reach"][at], most[order[enough[0]]] if len(enough) else np.inf))
            yield pd.DataFrame({"b": pdf["b"], "reach": out})
    got = packed.select("b").mapInPandas(run, "b long, reach double").orderBy("b").toArrow()  # one row a block
    return got["reach"].to_numpy()


def _pairs_to_search(packed: DataFrame, reach: DataFrame, k: int) -> DataFrame:
    """a, b, ab, ba: pairs of different blocks, and which of them may hold neighbours of the other's rows."""
    facts = _facts(packed, reach)
    ids, lo, hi = facts["b"], facts["lo"], facts["hi"]
    far = _bounded_reach(packed, facts, k) * (1 + 1e-9) + 1e-8  # rounding never hides a tie

    def run(batches):
        for pdf in batches:
            for b in pdf["b"]:
                at = int(np.searchsorted(ids, b))
                later = slice(at + 1, None)
                bound = np.maximum(np.maximum(lo[at] - hi[later], lo[later] - hi[at]).max(axis=1), 0)
                ab, ba = bound <= far[at], bound <= far[later]
                hit = np.flatnonzero(ab | ba)
                yield pd.DataFrame({"a": b, "b": ids[later][hit], "ab": ab[hit], "ba": ba[hit]})
    return packed.select("b").mapInPandas(run, "a long, b long, ab boolean, ba boolean")


def smote_neighbors(rows: DataFrame, id_col: str = "note_id", vec_col: str = "embedding",
                    k: int = 5, block_rows: int = 4096, seed=17, stats: dict | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean) of every row among ``rows``
    (excluding itself): columns i, j, r (1..k), distance.

    ``stats``, if given, receives the number of blocks, of pairs of blocks that are searched and of all pairs."""
    spark = rows.sparkSession
    ship_package(spark)
    kind = rows.schema[vec_col].dataType.elementType.simpleString()
    number = np.float32 if kind == "float" else np.float64
    base = materialize(rows.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")))
    n = base.count()
    if not n:
        return spark.createDataFrame([], "i long, j long, r int, distance double")
    if n > block_rows:
        sample = base.orderBy(hash_unit(seed, F.col("i")), "i").limit(SAMPLE_ROWS).toPandas()
        pivots = _farthest_first(np.stack(sample["v"].to_numpy()).astype(np.float64), PIVOTS)
        packed = materialize(_blocks(_keyed(base, pivots, kind), -(-n // block_rows), block_rows, pivots, number))
    else:  # one block: no pair to rule out
        packed = _blocks(base.withColumns({"p": F.lit(0), "r": F.lit(0.0)}), 1, block_rows, np.zeros((0, 0)), number)
    local_topk = _local_topk(k)

    def unpack(ids, mat):
        i = np.frombuffer(ids, np.int64)
        return i, np.frombuffer(mat, number).reshape(len(i), -1).astype(np.float64)

    def alone(batches):
        for pdf in batches:
            for b, ids, mat in pdf.itertuples(index=False):
                block = unpack(ids, mat)
                got = local_topk(*block, *block)
                yield got.assign(b=b)[["b", "i", "j", "distance"]]
                few = np.setdiff1d(block[0], got["i"].unique()) if k else block[0]
                yield pd.DataFrame({"b": b, "i": few, "j": pd.array([None] * len(few), dtype="Int64"),
                                    "distance": np.full(len(few), np.inf)})

    w = Window.partitionBy("i").orderBy(F.round("distance", 9), F.col("j"))

    def ranked(local: DataFrame) -> DataFrame:
        return (local.withColumn("r", F.row_number().over(w))
                     .where(F.col("r") <= k)
                     .select("i", "j", F.col("r").cast("int").alias("r"), "distance"))

    own = packed.select("b", "ids", "mat").mapInPandas(alone, f"b long, {NEIGHBOR_SCHEMA}")
    if n <= block_rows:
        if stats is not None:
            stats.update(blocks=1, pairs=0, all_pairs=0)
        return ranked(own.where("j is not null").select("i", "j", "distance"))
    own = materialize(own)
    kth = own.groupBy("b", "i").agg(F.max("distance").alias("far"), F.count("j").alias("n"))
    reach = kth.groupBy("b").agg(F.max(F.when(F.col("n") < k, float("inf")).otherwise(F.col("far"))).alias("reach"))
    pairs = _pairs_to_search(packed, reach, k)
    if stats is not None:
        pairs = materialize(pairs)
        n_blocks = packed.count()
        stats.update(blocks=n_blocks, pairs=pairs.count(), all_pairs=n_blocks * (n_blocks - 1) // 2)
    first = packed.select(F.col("b").alias("a"), F.col("ids").alias("qi"), F.col("mat").alias("qm"))
    met = pairs.join(first, "a").join(packed.select("b", "ids", "mat"), "b").select("ab", "ba", "qi", "qm", "ids", "mat")

    def run(batches):
        for pdf in batches:
            for ab, ba, qi, qm, ci, cm in pdf.itertuples(index=False):
                one, other = unpack(qi, qm), unpack(ci, cm)
                if ab:
                    yield local_topk(*one, *other)
                if ba:
                    yield local_topk(*other, *one)

    local = own.where("j is not null").select("i", "j", "distance").unionByName(met.mapInPandas(run, NEIGHBOR_SCHEMA))
    return ranked(local)


def smote_oversample(df: DataFrame, id_col: str = "note_id", vec_col: str = "embedding",
                     label_col: str = "y", minority=1, k: int = 5, seed=42,
                     neighbors: DataFrame | None = None) -> DataFrame:
    """Synthetic minority rows until both classes have the majority's size.

    Each minority row is the parent of ``q = floor(need / m)`` synthetic rows,
    plus one for an exact seeded sample of ``need - q * m`` parents. Each
    synthetic row takes a hash-picked neighbour among the parent's k and a
    hash-derived gap u in [0, 1): ``x + u * (nn - x)``.
    Returns (i, copy, j, u, embedding) for the synthetic rows only.
    """
    mino = materialize(df.where(F.col(label_col) == minority).select(
        F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")))
    n_min = mino.count()
    n_maj = df.where(F.col(label_col) != minority).count()  # reads the label column alone
    if n_min == 1 and n_maj > 1:
        raise ValueError("SMOTE needs at least two minority rows: one row has no neighbour")
    m, big_m = F.lit(n_min).cast("long"), F.lit(n_maj).cast("long")
    need = F.greatest(big_m - m, F.lit(0))
    q = F.floor(need / m).cast("long") if n_min else F.lit(0).cast("long")
    rem = need - q * m
    parents = exact_sample(mino, "i", rem, seed=f"{seed}:extra", out_col="extra")
    parents = parents.withColumn("copies", q + F.col("extra"))
    syn = (parents.where(F.col("copies") > 0)
                  .select("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
    kk = F.lit(max(1, min(k, n_min - 1)))
    syn = syn.select("i", "copy",
                     (F.pmod(hash_unit(seed, "i", "copy", F.lit("nn")), kk) + 1).cast("int").alias("r"),
                     hash_fraction(seed, "i", "copy", F.lit("u")).alias("u"))
    nb = neighbors if neighbors is not None else smote_neighbors(
        mino.withColumnRenamed("i", "note_id").withColumnRenamed("v", "embedding"), k=k)
    syn = syn.join(nb.select("i", "r", "j"), ["i", "r"])
    xv = mino.select("i", F.col("v").alias("x"))
    nv = mino.select(F.col("i").alias("j"), F.col("v").alias("n"))
    syn = syn.join(xv, "i").join(nv, "j")
    return syn.select("i", "copy", "j", "u", interpolate_vector("x", "n", F.col("u")).alias(vec_col))


def smote_balance(df: DataFrame, id_col: str = "note_id", vec_col: str = "embedding",
                  label_col: str = "y", minority=1, k: int = 5, seed=42) -> DataFrame:
    """Original rows plus synthetic minority rows (``synthetic`` = 1, with the
    ``source_id`` and ``copy`` they come from)."""
    syn = smote_oversample(df, id_col, vec_col, label_col, minority, k, seed)
    orig = df.select(F.col(id_col).cast("long").alias(id_col),
                     F.col(vec_col).cast("array<double>").alias(vec_col),
                     F.col(label_col), F.lit(0).alias("synthetic"))
    # (source_id, copy) is a synthetic row's exact key; its id is a negative hash of it.
    new_id = -F.pmod(F.xxhash64("i", "copy"), F.lit(1 << 62)) - 1
    new = syn.select(new_id.alias(id_col), F.col(vec_col),
                     F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col),
                     F.lit(1).alias("synthetic"), F.col("i").alias("source_id"), F.col("copy").cast("int").alias("copy"))
    orig = orig.withColumns({"source_id": F.lit(None).cast("long"), "copy": F.lit(None).cast("int")})
    return orig.unionByName(new)
