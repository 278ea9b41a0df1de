"""Case/control cohort construction.

The build reads the notes twice, however large they are:

    pass 1: notes -> per-subject match flag (one hash aggregate, partial per
            task), checkpointed: one row per subject
            -> matched subjects / negative pool / cohort size
            -> exact seeded sample of the pool (hash-rank cutoff, no global sort)
            -> cohort subjects with label
    pass 2: notes of the cohort (join on subject_id)

Subject sets are DataFrames and never reach the driver. Joins on the subject
key are left to the planner: a small cohort is broadcast by AQE at runtime,
a large one is a sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.numeric import hash_unit
from notewise.functions.text import contains_any
from notewise.operators.ranking import hash_rank_cutoffs, running_totals, tier_column
from notewise.operators.sampling import exact_sample
from notewise.session import materialize


def subject_flags(notes: DataFrame, keywords: Iterable[str], text_col: str = "text",
                  subject_col: str = "subject_id", whole_word: bool = False) -> DataFrame:
    """One row per subject with ``matched`` = 1 if any of its notes matches."""
    hit = contains_any(text_col, list(keywords), whole_word).cast("int")
    return notes.groupBy(subject_col).agg(F.max(hit).alias("matched"))


def cohort_match(notes: DataFrame, keywords: Iterable[str], text_col: str = "text",
                 subject_col: str = "subject_id", whole_word: bool = False) -> DataFrame:
    """COH-1: distinct subjects with at least one matching note."""
    return (notes.where(contains_any(text_col, list(keywords), whole_word))
                 .select(subject_col).distinct())


def cohort_match_bounded(rows: DataFrame, predicate: Column, chunk_size: int, k: int,
                         subject_col: str = "subject_id", order_col: str = "ord") -> DataFrame:
    """COH-2: a scan in fixed-size chunks that stops after the chunk in which
    the number of distinct matched subjects reaches ``k``.

    Chunk = ``floor(position / chunk_size)``, where the position of a row (from
    0, over all rows, matched or not) is the number of rows with a smaller
    order key: keys may have gaps, rows with equal keys share the first one's
    place, rows with a null key are left out. Positions come from a bucketed
    running sum over the counts per key, not from a global sort. Each matched
    subject's first chunk is a per-subject min; the stop chunk is the k-th
    smallest first chunk; all subjects first seen at or before it are kept, so
    the result may exceed k, exactly like a chunk loop. If k is never reached
    all are kept.
    """
    numbered = rows.where(F.col(order_col).isNotNull())
    keyed = materialize(numbered.groupBy(F.col(order_col).alias("_ord")).agg(F.count(F.lit(1)).alias("_n")))
    placed = running_totals(keyed, "_ord", ["_n"], prefix="_upto")
    chunk = F.floor((F.col("_upto_n") - F.col("_n")) / F.lit(chunk_size)).cast("bigint")
    hits = numbered.where(predicate).select(F.col(order_col).alias("_ord"), subject_col)
    first = (hits.join(placed.select("_ord", chunk.alias("_chunk")), "_ord")
                 .groupBy(subject_col).agg(F.min("_chunk").alias("first_chunk")))
    # One row per matched subject, read by two steps: scan the events once.
    first = materialize(first)
    # The k-th smallest first chunk is the chunk in which the count reaches k.
    stop = _kth_smallest(first, "first_chunk", k).scalar()
    return (first.where(stop.isNull() | (F.col("first_chunk") <= stop))
                 .select(subject_col, "first_chunk"))


def _kth_smallest(df: DataFrame, key: str, k: int) -> DataFrame:
    """One-row table ``stop_chunk`` = k-th smallest ``key`` (null if fewer
    than k rows). Two levels: a count per key value, then a running sum over
    distinct key values via the bucketed running total."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(per_key, key, ["_c"], descending=False, prefix="cum")
    return cum.where(F.col("cum_c") >= k).agg(F.min(key).alias("stop_chunk"))


def cohort_size(n_matched: Column, pool_size: Column, prevalence: float) -> list[Column]:
    """COH-3 arithmetic: target = int(n / prevalence), negatives = target - n,
    clamped to the pool with the shortfall reported."""
    target = F.floor(n_matched / F.lit(prevalence)).cast("bigint")
    wanted = target - n_matched
    taken = F.least(wanted, pool_size)
    return [n_matched.alias("n_matched"), target.alias("target"), wanted.alias("neg_wanted"),
            pool_size.alias("pool"), taken.alias("neg_taken"), (wanted - taken).alias("shortfall")]


def cohort_size_table(flags: DataFrame, prevalence: float) -> DataFrame:
    counts = flags.agg(F.sum("matched").cast("bigint").alias("_m"),
                       F.sum(1 - F.col("matched")).cast("bigint").alias("_p"))
    return counts.select(*cohort_size(F.col("_m"), F.col("_p"), prevalence))


def cohort_subjects(flags: DataFrame, prevalence: float, seed=42,
                    subject_col: str = "subject_id") -> DataFrame:
    """COH-4 + union: matched subjects (y = 1) plus an exact seeded sample of
    the pool (y = 0) sized by :func:`cohort_size`. ``flags`` comes from
    :func:`subject_flags`; it is checkpointed once (one row per subject), so
    the text scan behind it is not repeated by the size, cutoff and final
    steps."""
    flags = materialize(flags)
    pool = flags.where(F.col("matched") == 0).select(subject_col)
    n_neg = cohort_size_table(flags, prevalence).select("neg_taken").scalar()
    cut = hash_rank_cutoffs(pool, subject_col, [], lambda n: [F.least(n_neg, n)], seed=seed)
    s = cut.select(F.struct("_n", "_k0", "_h0", "_u0")).scalar()
    h = hash_unit(seed, F.col(subject_col))
    in_sample = tier_column(h, F.col(subject_col), 1, lambda f: s[f]) == 0
    return (flags.where((F.col("matched") == 1) | in_sample)
                 .select(subject_col, F.col("matched").alias("y")))


def bounded_flags(rows: DataFrame, predicate: Column, chunk_size: int, k: int,
                  subject_col: str = "subject_id", order_col: str = "ord") -> DataFrame:
    """Per-subject flags where ``matched`` means "in the bounded match set"
    (:func:`cohort_match_bounded`): the faithful form, in which subjects first
    matched after the stop chunk fall into the negative pool."""
    matched = cohort_match_bounded(rows, predicate, chunk_size, k, subject_col, order_col)
    subjects = rows.select(subject_col).distinct()
    return (subjects.join(matched.select(subject_col, F.lit(1).alias("_m")), subject_col, "left")
                    .select(subject_col, F.coalesce(F.col("_m"), F.lit(0)).alias("matched")))


def negative_pool(all_subjects: DataFrame, matched: DataFrame, subject_col: str = "subject_id") -> DataFrame:
    return all_subjects.select(subject_col).distinct().join(matched.select(subject_col), subject_col, "left_anti")


def sample_negatives(pool: DataFrame, n: Column | int, seed=42, subject_col: str = "subject_id") -> DataFrame:
    """Exactly n pool members (all if fewer), seeded, without replacement."""
    return exact_sample(pool, subject_col, n, seed=seed)


def semi_join(notes: DataFrame, ids: DataFrame, subject_col: str = "subject_id") -> DataFrame:
    return notes.join(ids.select(subject_col), subject_col, "left_semi")


def label_existence(notes: DataFrame, positives: DataFrame, subject_col: str = "subject_id",
                    label_col: str = "y") -> DataFrame:
    """1 if the note's subject is in ``positives`` else 0 (left join + coalesce)."""
    pos = positives.select(subject_col).distinct().withColumn("_pos", F.lit(1))
    return (notes.join(pos, subject_col, "left")
                 .withColumn(label_col, F.coalesce(F.col("_pos"), F.lit(0)))
                 .drop("_pos"))


def case_control_cohort(notes: DataFrame, keywords: Iterable[str], prevalence: float, seed=42,
                        text_col: str = "text", subject_col: str = "subject_id") -> DataFrame:
    """Every note of the matched and the sampled control subjects, with the
    subject's label ``y``: the full labelled cohort in one plan."""
    flags = subject_flags(notes, keywords, text_col, subject_col)
    cohort = cohort_subjects(flags, prevalence, seed, subject_col)
    return notes.join(cohort, subject_col, "inner")
