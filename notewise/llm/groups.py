"""Shared parts of the near-duplicate operators: candidate groups and linked components.

Members of a group meet in one task in blocks of at most about ``BLOCK``
members: a larger group is dealt into blocks by hash, and every pair of blocks
is a task of its own, so memory is bounded whatever the group's size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.staging import drop_staged, staged

BLOCK = 1024
#: A set of ids is broadcast up to this many (8 bytes each); beyond it the join is shuffled.
MAX_BROADCAST_IDS = 2_000_000


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``ids`` (distinct, staged)."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return df.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one column of ``ids`` (staged)."""
    name = "_without"
    while name in df.columns:
        name += "_"
    ids = ids.select(F.col(ids.columns[0]).alias(name))
    few = ids.count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, df[key] == F.col(name), "left_anti")


def distinct_groups(members: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` -> (bucket, n) of the groups of two members or more; of groups with the same
    members only one stays. ``members``: keys and an ``id``, each pair once.

    Two 64-bit sums over hashes of the ids stand for the members."""
    sizes = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("b")).where("n > 1")
    one = sizes.groupBy("n", "a", "b").agg(F.min(F.struct(*keys)).alias("k"))
    return one.select(*[F.col("k")[k].alias(k) for k in keys], "n",
                      F.xxhash64(*[F.col("k")[k] for k in keys]).alias("bucket"))


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows with (bucket, n, id, ..) once per pair of blocks they take part in: adds lo, hi, side.

    Groups of up to BLOCK members have one block (lo = hi = 0)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("_nb", blocks).withColumn("side", F.pmod(F.hash(F.lit(7), "id"), F.col("_nb")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return (rows.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other"))
            .drop("_other", "_nb"))


def meet(rows: DataFrame) -> DataFrame:
    """Deal rows so that those of one (bucket, lo, hi) follow each other in one task."""
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def runs(batches, n_keys: int = 3):
    """Tables of the rows that agree on the first ``n_keys`` (long or int) columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy() for i in range(n_keys)]
        cut = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            cut[1:] |= k[1:] != k[:-1]
        if held and any(held[-1].column(i)[-1].as_py() != int(k[0]) for i, k in enumerate(keys)):
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for start, end in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, b.slice(start, end - start)])
            held = []
        held.append(b.slice(edges[-2], edges[-1] - edges[-2]))
    if held:
        yield pa.Table.from_batches(held)


def pairs_to_try(table: pa.Table) -> np.ndarray:
    """Square mask of the pairs (i < j) that this pair of blocks stands for."""
    n = table.num_rows
    mask = np.triu(np.ones((n, n), dtype=bool), 1)
    if table["lo"][0].as_py() != table["hi"][0].as_py():
        side = table["side"].to_numpy()
        mask &= side[:, None] != side[None, :]
    return mask


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links (a[i], b[i]) as connect what they all connect."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id that has a link; component is the smallest id it can reach.

    ``edges``: (a, b). Alternating large-star and small-star rounds over the
    links: each node's links move to its smallest neighbour until every
    component is one star; a round is two joins of links with minima, and a
    component of n ids needs about log2(n) rounds."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = staged(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), name)
        state = done.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(now)
        now = done
        if state == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = state
