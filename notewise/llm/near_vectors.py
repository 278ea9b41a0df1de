"""Embedding near-dedup with spherical caps.

Vectors that may link (equal label and width) are rotated at random and cut
into two halves; each half has ``k`` random unit codewords, and the k * k
pairs of codewords are the filter directions (a random product code). A
vector's caps are all directions whose inner product with it exceeds the
height that ``CAPS`` random directions in k * k exceed, found from the sorted
scores of its halves without visiting the others; a vector that exceeds fewer
than ``LEAST`` takes its best ``LEAST``. k grows with the square root of the
number of vectors without a limit, so the caps' loads don't grow. ``CODES``
independent codes (rotation and codewords of their own) list their caps; vectors
meet if they share a cap of any code.

Equal vectors (same label) form a class; only classes go on. Vectors that
share a cap meet and their cosines are computed in double precision; a pair
is counted in the first cap group it shares, so link counts are exact for all
pairs that share a cap. Random pairs, 64 wide, at cosine exactly 0.98 that share
no cap: of one code 1 of 120,000 at k = 1,024, 7 of 80,000 at 8,192 and 2 of
10,000 at 32,768; of both codes none of 60,000, 40,000 and 5,000.

Cases: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, has no links; so has one with a null id;
repeated rows (equal ids) count as copies of each other; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm import groups, textbuf
from notewise.llm.staging import staged

CAPS = 40
LEAST = 24
CODES = 2
_TOP = 48  # scores of a half that are combined at first
_SCORES = 1 << 22  # scores of a half held at a time


def codewords(n: int) -> int:
    """Codewords of a half: four times as many directions of a code as its cap entries of n vectors."""
    return int(max(64, 1 << int(np.ceil(np.log2(np.sqrt(max(n, 1) * CAPS * 4))))))


@lru_cache(maxsize=4)
def code(width: int, k: int, number: int = 0):
    """Rotation and the codewords of both halves of a code."""
    rng = np.random.default_rng([7 + number, width, k])
    turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
    cut = max(width // 2, 1)
    halves = []
    for size in (cut, max(width - cut, 1)):
        w = rng.standard_normal((k, size))
        halves.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return turn, cut, halves


def caps(x: np.ndarray, k: int, number: int = 0) -> list[np.ndarray]:
    """Direction numbers (sorted) of each row of unit vectors in a code; codes have numbers of their own."""
    width = x.shape[1]
    turn, cut, (w1, w2) = code(width, k, number)
    y = x @ turn
    second = y[:, cut:] if width > 1 else np.zeros((len(y), 1))
    a, b = y[:, :cut] @ w1.T, second @ w2.T
    # a direction is (w1, w2) / sqrt(2); its inner product has a deviation of about 1 / sqrt(width)
    height = NormalDist().inv_cdf(1 - CAPS / k ** 2) / np.sqrt(width) * np.sqrt(2)
    top = min(_TOP, k)
    ia = np.argpartition(-a, top - 1, axis=1)[:, :top]
    ib = np.argpartition(-b, top - 1, axis=1)[:, :top]
    va, vb = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
    sums = (va[:, :, None] + vb[:, None, :]).reshape(len(y), -1)
    least = min(LEAST, sums.shape[1])
    bar = np.minimum(height, -np.partition(-sums, least - 1, axis=1)[:, least - 1])
    out = []
    for r in range(len(y)):
        if top < k and max(va[r].min() + vb[r].max(), va[r].max() + vb[r].min()) >= bar[r]:
            found = _exceeding(a[r], b[r], bar[r])  # exceeds beyond the top scores
        else:
            hit = np.flatnonzero(sums[r] >= bar[r])
            found = ia[r][hit // top] * np.int64(k) + ib[r][hit % top]
        out.append(np.sort(found) + np.int64(number) * k * k)
    return out


def _exceeding(a: np.ndarray, b: np.ndarray, bar: float) -> np.ndarray:
    """Pairs (numbered i * len(b) + j) with a[i] + b[j] >= bar; visits no other pair but those within rounding."""
    order = np.argsort(-b)
    n = np.searchsorted(-b[order], a - bar + 1e-12, side="right")  # among the first n of ``order`` are all that exceed with a[i]
    i, j = np.repeat(np.arange(len(a)), n), order[textbuf.ragged(np.zeros(len(a), np.int64), n)]
    exceeds = a[i] + b[j] >= bar  # bar may be one of these sums; a[i] - bar, rounded, may miss it
    return i[exceeds] * np.int64(len(b)) + j[exceeds]


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _caps_of(classes: DataFrame, k: int) -> DataFrame:
    """(place, cap, id): place stands for label and width."""

    def run(batches):
        for b in batches:
            vectors = b.column(2).to_pylist()
            width = np.array([len(v) for v in vectors])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                step = max(1, min(512, _SCORES // k))
                for s, number in product(range(0, len(at), step), range(CODES)):
                    part = at[s:s + step]
                    got = caps(unit([vectors[i] for i in part]), k, number)
                    n = np.array([len(g) for g in got])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(b.column(1).to_numpy()[part], n)), pa.array(np.concatenate(got)),
                         pa.array(np.repeat(b.column(0).to_numpy()[part], n))], names=["place", "cap", "id"])

    return classes.select("id", "place", "vector").mapInArrow(run, "place long, cap long, id long")


def _met(batches, least: float):
    """Per group: (ids, sizes, linked pairs that are counted here, all linked pairs).

    A pair is counted in the smallest bucket that both are in."""
    for t in groups.runs(batches):
        x = unit(t["vector"].to_pylist())
        near = ((x @ x.T) >= least) & groups.pairs_to_try(t)
        if not near.any():
            continue
        bucket = t["bucket"][0].as_py()
        mine = [[e for e in own if e < bucket] for own in t["buckets"].to_pylist()]
        seen, place = np.unique(np.array([e for own in mine for e in own], dtype=np.int64), return_inverse=True)
        first = near
        if len(seen):
            has = np.zeros((len(x), len(seen)), dtype=np.float32)
            has[np.repeat(np.arange(len(x)), [len(own) for own in mine]), place] = 1
            first = near & ~((has @ has.T) > 0)
        yield t["id"].to_numpy(), t["size"].to_numpy(), first, near


def _counts_and_links(met: DataFrame, least: float) -> DataFrame:
    """(a, n, b): n linked vectors counted for a, or (b not null) a link a - b of a spanning forest."""

    def run(batches):
        for ids, size, first, near in _met(batches, least):
            both = first | first.T
            n = (both * size[None, :]).sum(axis=1)
            some = np.flatnonzero(n)
            a, b = np.nonzero(near)
            tree = groups.forest(len(ids), a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], ids[[x for x, _ in tree]]])),
                 pa.array(np.concatenate([n[some], np.zeros(len(tree), n.dtype)]).astype(np.int64)),
                 pa.array([None] * len(some) + ids[[y for _, y in tree]].tolist(), pa.int64())], names=["a", "n", "b"])

    return met.mapInArrow(run, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
            & F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
            & F.exists("vector", lambda v: v != 0))
    fine = F.coalesce(fine, F.lit(False))
    # -0.0 and 0.0 are one component
    rows = rows.withColumn("vector", F.when(fine, F.transform("vector", lambda v: v + F.lit(0.0))))
    key = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2")]
    keyed = staged(rows.select("vec_id", F.when(F.col("vector").isNotNull(), key[0]).alias("h1"),
                               F.when(F.col("vector").isNotNull(), key[1]).alias("h2")), "vector-keys")
    classes = staged(
        rows.where("vector is not null").select("vec_id", "vector", *key, F.xxhash64("label", F.size("vector")).alias("place"))
        .groupBy("h1", "h2", "place").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"),
                                          F.first("vector").alias("vector")), "vector-classes")
    entries = staged(_caps_of(classes, codewords(classes.count())), "vector-caps")
    kept = groups.distinct_groups(entries, ["place", "cap"])
    kept = staged(entries.join(kept, ["place", "cap"]).select("bucket", "n", "id"), "vector-groups")
    lists = kept.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))  # at most a vector's caps
    members = groups.in_blocks(kept.join(classes.select("id", "size", "vector"), "id").join(lists, "id"))
    met = groups.meet(members.select("bucket", "lo", "hi", "side", "id", "size", "buckets", "vector"))
    found = staged(_counts_and_links(met, least), "vector-links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    links = groups.components(found.where("b is not null").select("a", "b"), "vector-components")
    of_class = classes.join(counts, "id", "left").join(links, "id", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    out = keyed.join(of_class, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
