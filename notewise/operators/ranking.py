"""Order-statistics primitives that never put a whole table in one task.

``hash_rank_cutoffs``
    Exact "first k units by (hash, id)" per stratum. Units are spread over
    2^bits hash buckets; a count per (stratum, bucket) is a small table whose
    running sum locates, for each k, the one bucket that holds the k-th unit.
    Only that bucket's units are ranked with a window, so each window task
    holds about n / 2^bits units. The result is a cutoff ``(h*, id*)`` per
    stratum and k; membership is then a plain predicate on any row that
    carries the unit id, so no join back to the unit list is needed.

``running_totals``
    Inclusive running sums along an ordered key, per group. The key is cut
    into buckets (at approximate quantiles, or at equal widths per group);
    bucket sums (at most ``n_buckets`` rows per group) get an exclusive
    running sum, which is broadcast back as an offset, and a window inside
    each bucket finishes the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise.functions.numeric import hash_unit
from notewise.session import BROADCAST_MAX_ROWS, materialize


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join on ``keys`` where null meets null, so a null group or class is a group like any other."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = left.join(F.broadcast(r) if small else r, on, how)
    return out.drop(*[f"_r_{k}" for k in keys])


#: Rows that one window task should hold; bucket counts follow from it.
BUCKET_ROWS = 50_000


def bucket_count(rows: int) -> int:
    """Buckets for ``rows`` rows; more of them only mean more, smaller tasks."""
    return min(100_000, max(16, -(-rows // BUCKET_ROWS)))


def hash_rank_cutoffs(units: DataFrame, unit_col: str, strata: Sequence[str],
                      ks: Callable[[Column], list[Column]], seed=42, bits: int = 16) -> DataFrame:
    return _cutoffs(units, unit_col, strata, ks, seed, bits)[0]


def _cutoffs(units: DataFrame, unit_col: str, strata: Sequence[str],
             ks: Callable[[Column], list[Column]], seed=42, bits: int = 16) -> tuple[DataFrame, bool]:
    """Cutoffs for the k smallest ``(hash(seed:unit), unit)`` per stratum.

    ``units`` must hold each unit once per stratum. ``ks(n)`` maps the
    stratum size column ``n`` to a list of k expressions, each at most n (one
    per cutoff; they may use windows over the bucket table, e.g.
    ``min(n) over ()``). Returns one row per stratum that has a nonempty cut,
    with ``_n`` and, for each cutoff j, ``_k{j}``, ``_h{j}``, ``_u{j}``;
    missing strata or fields mean "k = 0" (nothing inside the cut).
    """
    keys = list(strata)
    h = hash_unit(seed, F.col(unit_col))
    u = units.select(*keys, F.col(unit_col).alias("_u"), h.alias("_h"))
    u = u.withColumn("_b", F.shiftright(F.col("_h"), 32 - bits))

    # (stratum, bucket) counts: at most 2^bits rows per stratum. Stratum size
    # and the k's are windows over this small table, so no join is needed.
    cnt = u.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w_cum = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cnt = (cnt.withColumn("_cum", F.sum("_c").over(w_cum))
              .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))))
    k_exprs = ks(F.col("_n"))
    cnt = cnt.select(*keys, "_b", "_c", "_cum", "_n",
                     *[F.floor(k).cast("bigint").alias(f"_k{j}") for j, k in enumerate(k_exprs)])

    # For each cutoff j: the bucket holding the k-th unit and its rank inside it.
    bound = None
    for j in range(len(k_exprs)):
        kj = F.col(f"_k{j}")
        bj = (cnt.where((F.col("_cum") - F.col("_c") < kj) & (kj <= F.col("_cum")))
                 .select(*keys, F.lit(j).alias("_j"), "_b", (kj - (F.col("_cum") - F.col("_c"))).alias("_r"),
                         "_n", kj.alias("_k")))
        bound = bj if bound is None else bound.unionByName(bj)

    # Rank only the units of boundary buckets (about n / 2^bits per stratum).
    # strata x cutoffs rows: broadcast after a size check. The per-stratum
    # cutoff table is never larger, so the same check covers its join.
    bound = materialize(bound)
    small = bound.count() <= BROADCAST_MAX_ROWS
    edge = null_safe_join(u, bound, keys + ["_b"], small=small)
    w_edge = Window.partitionBy(*keys, "_j").orderBy("_h", "_u")
    edge = (edge.withColumn("_rn", F.row_number().over(w_edge))
                .where(F.col("_rn") == F.col("_r")))
    n = len(k_exprs)
    out = edge.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when(F.col("_j") == j, F.col("_k"))).alias(f"_k{j}") for j in range(n)],
        *[F.max(F.when(F.col("_j") == j, F.col("_h"))).alias(f"_h{j}") for j in range(n)],
        *[F.max(F.when(F.col("_j") == j, F.col("_u"))).alias(f"_u{j}") for j in range(n)])
    return out, small


def tier_column(h: Column, unit: Column, n_cutoffs: int, get=F.col) -> Column:
    """Number of cutoffs a row lies beyond (0 = within the first k0).
    ``get(name)`` reads a cutoff field (a joined column or a scalar subquery field)."""
    total = None
    for j in range(n_cutoffs):
        k, n = get(f"_k{j}"), get("_n")
        hj, uj = get(f"_h{j}"), get(f"_u{j}")
        within = F.coalesce((k >= n) | ((k > 0) & ((h < hj) | ((h == hj) & (unit <= uj)))), F.lit(False))
        beyond = F.when(within, 0).otherwise(1)
        total = beyond if total is None else total + beyond
    return total


def assign_tiers(rows: DataFrame, cutoffs: DataFrame, unit_col: str, strata: Sequence[str],
                 n_cutoffs: int, seed=42, out_col: str = "tier", small: bool | None = None) -> DataFrame:
    """Attach the tier of each row's unit (rows may repeat a unit).

    Per-stratum cutoffs (one row per stratum) are joined on the strata,
    broadcast after a size check; without strata the single cutoff row is a
    scalar subquery, so the rows are only filtered/projected, never joined.
    """
    h = hash_unit(seed, F.col(unit_col))
    if not strata:
        fields = [c for c in cutoffs.columns if c.startswith("_")]
        s = cutoffs.select(F.struct(*fields).alias("s")).scalar()
        return rows.withColumn(out_col, tier_column(h, F.col(unit_col), n_cutoffs, lambda f: s[f]))
    if small is None:
        cutoffs = materialize(cutoffs)
        small = cutoffs.count() <= BROADCAST_MAX_ROWS
    joined = null_safe_join(rows, cutoffs, list(strata), "left", small)
    joined = joined.withColumn(out_col, tier_column(h, F.col(unit_col), n_cutoffs))
    return joined.drop(*[x for x in cutoffs.columns if x.startswith("_")])


def rank_tiers(df: DataFrame, unit_col: str, strata: Sequence[str],
               ks: Callable[[Column], list[Column]], seed=42, out_col: str = "tier",
               bits: int = 16, units: DataFrame | None = None,
               unique_units: bool = False) -> DataFrame:
    """One-call form: cutoffs over ``units`` (default: distinct units of df),
    tiers attached to every row of ``df``.

    The unit list (strata + id: a narrow projection) is checkpointed because
    the cutoff steps read it twice; ``df`` itself is then read once more by
    the final predicate, so a wide input is never copied. With
    ``unique_units`` (``unit_col`` is a key of ``df``) no distinct is needed."""
    if units is None:
        units = df.select(*strata, unit_col)
        if not unique_units:
            units = units.distinct()
    units = materialize(units)
    cut, small = _cutoffs(units, unit_col, strata, ks, seed, bits)
    n = len(ks(F.col("_n")))
    return assign_tiers(df, cut, unit_col, strata, n, seed, out_col, small)


def quantile_edges(df: DataFrame, key: str, n_buckets: int, accuracy: int = 10000) -> list[float]:
    """``n_buckets - 1`` approximate quantiles of ``key`` (deduplicated), from
    one bounded-memory sketch aggregate. The edges are fixed once as
    literals, so every branch of a plan buckets rows identically."""
    qs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), qs, accuracy).alias("e")).first()
    return sorted({float(e) for e in (row["e"] or []) if e is not None})


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str],
                   group_cols: Sequence[str] = (), descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_", bucketing: str = "auto") -> DataFrame:
    """Inclusive running sums of ``value_cols`` ordered by ``order_col``.

    Rows that tie on the order key get the same total (range frame). The
    key is cut into at most ``n_buckets`` buckets per group, at approximate
    quantiles (``bucketing='quantile'``, the default, so a key crowded into
    a narrow range still gives balanced buckets) or at equal widths
    (``'width'``). Bucket sums get an exclusive running sum that is
    broadcast back as offsets; a window inside each bucket finishes the sum.
    Without groups the edges are literals and ``Bucketizer`` assigns buckets
    by binary search; with groups each group's edges are a checkpointed
    array (groups x buckets values) and the bucket is the number of
    edges not above the key. Without ``n_buckets`` there is one per
    ``BUCKET_ROWS`` rows (of the largest group); ``df`` is then counted, so
    pass a written table. Rows with a null key are left out.
    """
    from pyspark.ml.feature import Bucketizer
    keys = list(group_cols)
    key = F.col(order_col).cast("double")
    df = df.where(F.col(order_col).isNotNull())
    if n_buckets is None:
        largest = (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) if keys else df.count()
        n_buckets = bucket_count(largest)
    mode = "quantile" if bucketing == "auto" else bucketing
    small = True  # ungrouped: the offsets table has at most n_buckets rows
    if mode == "quantile" and keys:
        nbg = n_buckets
        qs = [i / nbg for i in range(1, nbg)]
        edges = materialize(df.groupBy(*keys).agg(F.percentile_approx(key, qs, max(10000, 10 * nbg)).alias("_edges")))
        # One row per group; the offsets table has at most groups x buckets.
        small = edges.count() * nbg <= BROADCAST_MAX_ROWS
        d = null_safe_join(df, edges, keys, small=small)
        b = F.size(F.filter("_edges", lambda e: e <= key)).cast("int")
        d = d.withColumn("_bk", (F.lit(nbg - 1) - b) if descending else b).drop("_edges")
    elif mode == "quantile":
        edges = quantile_edges(df, order_col, n_buckets, max(10000, 10 * n_buckets))
        nb = len(edges) + 1
        splits = [float("-inf")] + edges + [float("inf")]
        d = df.withColumn("_key", key)
        d = Bucketizer(splits=splits, inputCol="_key", outputCol="_bkd", handleInvalid="keep").transform(d)
        b = F.col("_bkd").cast("int")
        d = d.withColumn("_bk", (F.lit(nb - 1) - b) if descending else b).drop("_key", "_bkd")
    else:
        if keys:
            stats = materialize(df.groupBy(*keys).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")))
            small = stats.count() * n_buckets <= BROADCAST_MAX_ROWS
            d = null_safe_join(df, stats, keys, small=small)
            lo, hi = F.col("_lo"), F.col("_hi")
        else:
            st = df.agg(F.struct(F.min(key).alias("lo"), F.max(key).alias("hi"))).scalar()
            d, lo, hi = df, st["lo"], st["hi"]
        span = hi - lo
        frac = F.when(span > 0, (key - lo) / span).otherwise(F.lit(0.0))
        b = F.least(F.floor(frac * n_buckets), F.lit(n_buckets - 1)).cast("int")
        if descending:
            b = F.lit(n_buckets - 1) - b
        d = d.withColumn("_bk", b)
        if keys:
            d = d.drop("_lo", "_hi")

    bt = d.groupBy(*keys, "_bk").agg(*[F.sum(v).alias(f"_bs_{v}") for v in value_cols])
    w_off = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = bt.select(*keys, "_bk", *[F.coalesce(F.sum(f"_bs_{v}").over(w_off), F.lit(0))
                                    .alias(f"_off_{v}") for v in value_cols])
    # Offsets: n_buckets rows in total without groups (hinted); per group,
    # groups x buckets rows (broadcast after a size check).
    d = null_safe_join(d, off, keys + ["_bk"], small=small or not keys)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_in = (Window.partitionBy(*keys, "_bk").orderBy(order)
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    for v in value_cols:
        d = d.withColumn(f"{prefix}{v}", F.col(f"_off_{v}") + F.sum(v).over(w_in))
    return d.drop("_bk", *[f"_off_{v}" for v in value_cols])
