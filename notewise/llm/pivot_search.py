"""Exact top-k inner-product search with a pivot-distance index.

Vectors become integers floor(``scale`` * x). With one more coordinate, sqrt(M^2 - |x|^2) (M the largest
length in the table; 0 for a query), the largest inner products are the smallest distances:
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so distances obey the triangle inequality and inner products are
found through them.

Index: every vector is keyed by its nearest pivot and its distance r to it; the table is dealt by ranges
of (pivot, r), so a pivot near a third of all vectors is cut like any other, and lies in shards of at
most ``shard_rows`` rows; a shard is a run of annuli (pivot, r from lo to hi). A query at distance d from
an annulus's pivot is at least max(0, lo - d, d - hi) from all its vectors, which bounds their scores.

Search: each query first visits the shard whose annuli bound highest and brings back its k-th score; then
it goes on to every other shard that may still hold a score as high, no other, and the k best of all are
kept. In a shard the annuli are expanded by falling bound, for a block of queries at once, and the
expansion stops where no query's bound reaches its k-th score; ties are kept, so the result is exact.
Shards grow with the table (a 256th of its rows, from 2,048 to 131,072), so that a query is sent to
few of them; a shard's vectors fit in a task (131,072 vectors 64 wide: 67 MB, held up to three times).

Pivots are chosen farthest-first from a sample of at most ``sample_rows`` rows by hash of the id; every
vector is indexed, and a poor choice costs time, never results. What the driver holds is that sample, and
one line a shard and pivot. Scores are exact: float64 where M^2 and the queries' lengths allow it
(products below 2^53), else 64-bit integers.

Cases: a vector that is null, or holds null or non-finite components, takes no part, nor does one with a
null id, or one whose scaled length is 2^31 or more (its scores might leave 64 bits); a shorter vector is
filled up with zeros (an empty one scores 0 with all); repeated rows (equal ids) are candidates each, but
none of them for a query of that id; equal queries of one id are one query, different ones answer each
under that id; equal scores go by the smaller id; with fewer than k candidates all are returned, and none
for an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.llm.staging import staged

SAMPLE_ROWS = 4096
PIVOTS = 64
ANNULUS = 128  # rows
QUERY_BLOCK = 256
_LIMIT = 2.0 ** 62
_LOWEST = np.iinfo(np.int64).min


def shard_rows_for(n: int) -> int:
    return min(131_072, max(2_048, -(-n // 256)))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x (array of long) and sq (its squared length) of the vectors that take part."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < 2.0 ** 31), F.lit(False)))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    v = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    sq = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("id", v.alias("x")).withColumn("sq", sq).where(F.col("sq") < _LIMIT)


def _matrix(col, width: int) -> np.ndarray:
    """Rows of a list column as int64, filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if n and (sizes == width).all():
        return flat.reshape(n, width).astype(np.int64)
    out = np.zeros((n, width), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < width  # a query may be wider than the table; the rest meets zeros
    out[np.repeat(np.arange(n), sizes)[keep], at[keep]] = flat[keep]
    return out


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (x, lift) to the pivots (last coordinate: theirs)."""
    y = np.concatenate([x.astype(np.float64), lift[:, None]], axis=1)
    sq = (y ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * (y @ pivots.T)
    return np.sqrt(np.maximum(sq, 0))


def farthest_first(y: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of y, each the farthest from those before it; the first is the one nearest to the mean."""
    chosen = [int(((y - y.mean(0)) ** 2).sum(1).argmin())]
    far = ((y - y[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((y - y[chosen[-1]]) ** 2).sum(1))
    return y[chosen]


class Index:
    """Rows (shard, pivot, r, id, x, sq), written once, with the pivots and one line (shard, pivot, lo, hi, n) a shard and pivot."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, top: float, width: int, lines: np.ndarray):
        self.rows, self.pivots, self.top, self.width, self.lines = rows, pivots, top, width, lines


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
          pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, shard_rows: int | None = None) -> Index | None:
    """The index of a table; None if no vector takes part."""
    base = staged(scaled(vectors, id_col, vector_col, scale), "search-vectors")
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("top"), F.max(F.size("x")).alias("width")).first()
    if not facts["n"]:
        return None
    n, top, width = facts["n"], facts["top"], facts["width"]
    size = shard_rows or shard_rows_for(n)
    sample = base.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(sample_rows).toArrow()
    x = _matrix(sample["x"], width)
    lift = np.sqrt(np.maximum(top - sample["sq"].to_numpy(), 0))
    chosen = farthest_first(np.concatenate([x.astype(np.float64), lift[:, None]], axis=1), pivots)

    def keyed(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.slice(i, 4096)
                d = _distances(_matrix(part.column("x"), width),
                               np.sqrt(np.maximum(top - part.column("sq").to_numpy(), 0)), chosen)
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p]), *part.columns],
                                                 names=["pivot", "r", "id", "x", "sq"])

    rows = base.select("id", "x", "sq").mapInArrow(keyed, "pivot int, r double, id long, x array<bigint>, sq double")
    rows = rows.repartitionByRange(max(1, -(-n // size)), "pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")
    pos = F.monotonically_increasing_id()  # partition and row in it
    rows = rows.withColumn("pos", pos)
    part, row = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    rows = staged(rows.select((part * (1 << 20) + F.floor(row / size)).alias("shard"), "pivot", "r", "id", "x", "sq"), "search-index")
    lines = rows.groupBy("shard", "pivot").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).orderBy("shard", "pivot").toArrow()
    lines = np.stack([lines[c].to_numpy().astype(np.float64) for c in ("shard", "pivot", "lo", "hi")], axis=1)
    return Index(rows, chosen, top, width, lines)


def _bounds(d: np.ndarray, q_sq: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: float) -> np.ndarray:
    """For each query (distances d to the pivots) and annulus: no vector in it scores more."""
    near = d[:, pivot]
    gap = np.maximum(np.maximum(lo[None, :] - near, near - hi[None, :]), 0)
    both = q_sq[:, None] + top
    return (both - gap ** 2) / 2 + (0.5 + 1e-9 * both)  # the rest covers the rounding of the distances


def _visits(queries: DataFrame, index: Index, home: bool) -> DataFrame:
    """(shard, query columns) for each shard that a query visits: its best one, or all others that may hold a score as high."""
    pivots, top, width, lines = index.pivots, index.top, index.width, index.lines
    shards, first = np.unique(lines[:, 0].astype(np.int64), return_index=True)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), QUERY_BLOCK):
                part = b.slice(i, QUERY_BLOCK)
                x, sq = _matrix(part.column("x"), width), part.column("sq").to_numpy()
                d = _distances(x, np.zeros(len(x)), pivots)
                # a wider query's further components add to both sides
                d = np.sqrt(d ** 2 + np.maximum(sq - (x.astype(np.float64) ** 2).sum(1), 0)[:, None])
                best = np.maximum.reduceat(_bounds(d, sq, lines[:, 1].astype(int), lines[:, 2], lines[:, 3], top), first, axis=1)
                at_home = best.argmax(1)
                if home:
                    q, s = np.arange(len(x)), at_home
                else:
                    seed = part.column("seed").fill_null(_LOWEST).to_numpy(zero_copy_only=False)
                    go = best >= seed[:, None]
                    go[np.arange(len(x)), at_home] = False
                    q, s = np.nonzero(go)
                if len(q):
                    rows = part.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([pa.array(shards[s]), *(rows.column(c) for c in ("key", "query", "x", "sq", "seed"))],
                                                     names=["shard", "key", "query", "x", "sq", "seed"])

    return queries.select("key", "query", "x", "sq", "seed").mapInArrow(
        run, "shard long, key long, query long, x array<bigint>, sq double, seed long")


class _Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, seed: np.ndarray):
        self.k, self.kth = k, seed.copy()
        self.found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def add(self, q: int, score: np.ndarray, ids: np.ndarray):
        score, ids = np.concatenate([self.found[q][0], score]), np.concatenate([self.found[q][1], ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.found[q] = score[order], ids[order]
        if len(order) == self.k:
            self.kth[q] = max(self.kth[q], score[order[-1]])


class _Shard:
    """A shard's vectors in memory, cut into annuli."""

    def __init__(self, parts: list, index: tuple, k: int):
        self.pivots, self.top, self.width, self.k = *index, k
        table = pa.Table.from_batches(parts)
        order = np.lexsort((table["id"].to_numpy(), table["r"].to_numpy(), table["pivot"].to_numpy()))
        x = _matrix(table["x"], self.width)[order]
        self.ids, r, pivot = table["id"].to_numpy()[order], table["r"].to_numpy()[order], table["pivot"].to_numpy()[order]
        starts = np.flatnonzero(np.diff(pivot, prepend=-1))
        ends = np.append(starts[1:], len(pivot))
        self.cut = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(starts, ends)])
        self.end = np.append(self.cut[1:], len(pivot))
        self.pivot, self.lo, self.hi = pivot[self.cut], r[self.cut], r[self.end - 1]
        self.exact = self.top < 2.0 ** 53
        self.x = x.astype(np.float64) if self.exact else x

    def visit(self, names: np.ndarray, q: np.ndarray, sq: np.ndarray, seed: np.ndarray) -> _Best:
        d = _distances(q, np.zeros(len(q)), self.pivots)
        d = np.sqrt(d ** 2 + np.maximum(sq - (q.astype(np.float64) ** 2).sum(1), 0)[:, None])
        bound = _bounds(d, sq, self.pivot, self.lo, self.hi, self.top)
        best = _Best(len(q), self.k, seed)
        floats = self.exact and float(np.sqrt(sq.max())) * np.sqrt(self.top) < 2.0 ** 53
        y = q.astype(np.float64) if floats else q
        tops = bound.max(0)
        for a in np.argsort(-tops, kind="stable"):
            if tops[a] < best.kth.min():
                break
            who = np.flatnonzero(bound[:, a] >= best.kth)
            if not len(who):
                continue
            rows = slice(self.cut[a], self.end[a])
            x = self.x[rows] if floats else self.x[rows].astype(np.int64)
            score = (y[who] @ x.T).astype(np.int64)
            hit = (score >= best.kth[who, None]) & (self.ids[rows][None, :] != names[who, None])
            for i in np.flatnonzero(hit.any(1)):
                best.add(who[i], score[i, hit[i]], self.ids[rows][hit[i]])
        return best


def _search(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """(key, query, id, score): up to k best of each (query, shard) of ``visits``, none below the query's seed."""
    none = F.lit(None)
    mixed = index.rows.select("shard", F.lit(0).alias("kind"), "pivot", "r", "id", "x", "sq", none.cast("long").alias("seed"),
                              none.cast("long").alias("key"))
    mixed = mixed.unionByName(visits.select("shard", F.lit(1).alias("kind"), none.cast("int").alias("pivot"),
                                            none.cast("double").alias("r"), F.col("query").alias("id"), "x", "sq", "seed", "key"))
    mixed = mixed.repartition("shard").sortWithinPartitions("shard", "kind")
    facts = index.pivots, index.top, index.width

    def run(batches):
        number, parts, shard = None, [], None
        for b in batches:
            where, kinds = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            borders = np.flatnonzero((np.diff(where, prepend=where[:1]) != 0) | (np.diff(kinds, prepend=kinds[:1]) != 0))
            for i, j in zip(np.append(0, borders), np.append(borders, len(b))):
                if i == j:
                    continue
                if where[i] != number:
                    number, parts, shard = where[i], [], None
                piece = b.slice(i, j - i)
                if kinds[i] == 0:
                    parts.append(piece)
                    continue
                if shard is None:
                    shard, parts = _Shard(parts, facts, k), []
                out = [[], [], [], []]
                for s in range(0, len(piece), QUERY_BLOCK):
                    part = piece.slice(s, QUERY_BLOCK)
                    names = part.column("id").to_numpy()
                    best = shard.visit(names, _matrix(part.column("x"), facts[2]), part.column("sq").to_numpy(),
                                       part.column("seed").fill_null(_LOWEST).to_numpy(zero_copy_only=False))
                    for key, name, (score, ids) in zip(part.column("key").to_numpy(), names, best.found):
                        for col, v in zip(out, (np.full(len(ids), key), np.full(len(ids), name), ids, score)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "query", "id", "score"])

    return mixed.mapInArrow(run, "key long, query long, id long, score long")


def top_k(index: Index | None, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the index with the highest inner product with each query."""
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = scaled(queries, id_col, vector_col, scale).select(F.col("id").alias("query"), "x", "sq")
    asked = asked.dropDuplicates(["query", "x"]).withColumn("key", F.monotonically_increasing_id())
    asked = staged(asked.withColumn("seed", F.lit(None).cast("long")), "search-queries")
    home = staged(_search(index, _visits(asked, index, True), k), "search-home")
    # up to k rows a query here, and up to k for each other shard that it visits
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    seeds = home.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("seed")).where(F.col("n") == k)
    seeded = asked.drop("seed").join(seeds.select("key", "seed"), "key", "left")
    rest = _search(index, _visits(seeded, index, False), k)
    best = home.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                       F.col("id").alias("vec_id"), "score")
