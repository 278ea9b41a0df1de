"""Seeded, exact-size samples and splits.

Row-level splits and under-sampling take ``unit_col`` to be a key of the
input (one row per unit); group splits and :func:`exact_sample` accept
repeated units.

Every sample here is "the first k units by (hash(seed:unit), unit)" inside
its stratum, computed with :mod:`notewise.operators.ranking`. So a sample is
deterministic, has exactly the requested size, does not depend on
partitioning, and equals the SQL
``row_number() over (partition by stratum order by h, unit) <= k``.

Sizes use ``round`` (half away from zero) of ``fraction * n``.
``randomSplit`` / ``sampleBy`` are not used: both are Bernoulli (sizes vary)
and depend on partition layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise.operators.ranking import rank_tiers


def _strata(stratify) -> list[str]:
    if stratify is None:
        return []
    return [stratify] if isinstance(stratify, str) else list(stratify)


def exact_sample(df: DataFrame, unit_col: str, k, stratify=None, seed=42,
                 out_col: str | None = None) -> DataFrame:
    """Exactly ``k`` units per stratum (all of them if fewer).

    ``k`` is an int, a Column (e.g. a scalar subquery) or a callable of the
    stratum size column ``n``. With ``out_col`` the rows are flagged instead
    of filtered.
    """
    if callable(k) and not isinstance(k, Column):
        kfun = lambda n: [k(n)]
    else:
        kc = k if isinstance(k, Column) else F.lit(int(k))
        kfun = lambda n: [F.least(kc, n)]
    t = rank_tiers(df, unit_col, _strata(stratify), kfun, seed=seed, out_col="_tier")
    if out_col:
        return t.withColumn(out_col, (F.col("_tier") == 0).cast("int")).drop("_tier")
    return t.where(F.col("_tier") == 0).drop("_tier")


def split_random(df: DataFrame, unit_col: str, test_fraction: float = 0.2, seed=42,
                 split_col: str = "split") -> DataFrame:
    """Unstratified exact split: round(test_fraction * n) units go to 'test'."""
    t = rank_tiers(df, unit_col, [], lambda n: [F.round(n * F.lit(test_fraction))],
                   seed=seed, out_col="_tier", unique_units=True)
    return t.withColumn(split_col, F.when(F.col("_tier") == 0, "test").otherwise("train")).drop("_tier")


def split_stratified(df: DataFrame, unit_col: str, label_col: str, test_fraction: float = 0.2,
                     seed=42, split_col: str = "split") -> DataFrame:
    """Per class, round(test_fraction * n_c) units go to 'test', the rest to 'train'."""
    t = rank_tiers(df, unit_col, [label_col], lambda n: [F.round(n * F.lit(test_fraction))],
                   seed=seed, out_col="_tier", unique_units=True)
    return t.withColumn(split_col, F.when(F.col("_tier") == 0, "test").otherwise("train")).drop("_tier")


def split_three_way(df: DataFrame, unit_col: str, label_col: str, holdout_fraction: float = 0.2,
                    val_share: float = 0.5, seed=42, split_col: str = "split") -> DataFrame:
    """80/10/10 by two stratified cuts: per class the first round(0.2 n)
    units are held out; the first round(0.5 * held-out) of them are 'val',
    the rest 'test'."""
    def ks(n):
        hold = F.round(n * F.lit(holdout_fraction))
        return [F.round(hold * F.lit(val_share)), hold]
    t = rank_tiers(df, unit_col, [label_col], ks, seed=seed, out_col="_tier", unique_units=True)
    s = (F.when(F.col("_tier") == 0, "val").when(F.col("_tier") == 1, "test").otherwise("train"))
    return t.withColumn(split_col, s).drop("_tier")


def split_by_group(df: DataFrame, group_col: str, test_fraction: float = 0.2, seed=42,
                   split_col: str = "split") -> DataFrame:
    """All rows of a group (e.g. a subject) land on the same side. Groups, not
    rows, are sampled; the decision is a predicate on the group's hash, so
    rows are never joined back to a group list."""
    units = df.select(group_col).distinct()
    t = rank_tiers(df, group_col, [], lambda n: [F.round(n * F.lit(test_fraction))],
                   seed=seed, out_col="_tier", units=units)
    return t.withColumn(split_col, F.when(F.col("_tier") == 0, "test").otherwise("train")).drop("_tier")


def undersample_majority(df: DataFrame, unit_col: str, label_col: str, seed=42,
                         split_col: str | None = "split", apply_to: str = "train") -> DataFrame:
    """Random under-sampling: every class is cut to the smallest class size.

    Only rows whose ``split_col`` equals ``apply_to`` are resampled; other
    splits pass through untouched. With ``split_col=None`` the whole frame is
    resampled. One ranking over (split, class) decides all rows.
    """
    strata = [label_col] if split_col is None else [split_col, label_col]
    here = F.lit(True) if split_col is None else F.coalesce(F.col(split_col) == apply_to, F.lit(False))

    def smallest(n):  # over the table of (stratum, bucket) counts; other splits keep all their rows
        return [F.when(here, F.min(F.when(here, n)).over(Window.partitionBy())).otherwise(n)]
    kept = rank_tiers(df, unit_col, strata, smallest, seed=seed, out_col="_tier", unique_units=True)
    return kept.where(F.col("_tier") == 0).drop("_tier")
