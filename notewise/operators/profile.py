"""Corpus and table profiles: counts, describe, histograms, word frequencies.

All are hash aggregations with map-side partial aggregation, so a hot key
(one subject holding a third of the notes, one very common word) is combined
inside each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.functions.text import clean_text
from notewise.session import materialize


def distinct_subjects(df: DataFrame, subject_col: str = "subject_id") -> DataFrame:
    return df.select(subject_col).distinct()


def count_distinct_subjects(df: DataFrame, subject_col: str = "subject_id",
                            approx_rsd: float | None = None) -> DataFrame:
    """Number of unique subjects; ``approx_rsd`` switches to HyperLogLog++."""
    if approx_rsd is not None:
        agg = F.approx_count_distinct(subject_col, approx_rsd)
    else:
        agg = F.count_distinct(subject_col)
    return df.agg(agg.cast("bigint").alias("n_subjects"))


def notes_per_subject(df: DataFrame, subject_col: str = "subject_id") -> DataFrame:
    return df.groupBy(subject_col).agg(F.count(F.lit(1)).alias("n_notes"))


#: Size of the KLL sketch behind the quartiles' brackets (rank error well below BRACKET), and half a bracket's width in ranks.
SKETCH_K, BRACKET = 4096, 0.002
QUARTILES = (0.25, 0.5, 0.75)


def describe_numeric(df: DataFrame, col: str, approx_accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max, of the values that aren't null or NaN.

    Two passes over the column, written once, and no shuffle of it: the first takes the moments and a bounded
    sketch, which brackets each quartile; the second counts what lies below, between and above the brackets and
    keeps the counts of the values inside (less than 2% of the ranks), among which the exact ones are found by
    running totals in each bracket. Should a bracket miss its quartile, it is widened and the second pass repeated.
    ``approx_accuracy`` takes the quartiles from a bounded sketch instead.
    """
    x = F.col("x")
    # filtered after it is written: pushed below, the filter would compute the column a second time
    values = materialize(df.select(F.col(col).cast("double").alias("x"))).where(x.isNotNull() & ~F.isnan("x"))
    moments = [F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
               F.max("x").alias("max")]
    if approx_accuracy is not None:
        out = values.agg(*moments, F.percentile_approx("x", list(QUARTILES), approx_accuracy).alias("q"))
        return _described(out, [F.col("q")[i] for i in range(3)])
    width = BRACKET
    while True:
        sides = [min(max(p + s * width, 0.0), 1.0) for p in QUARTILES for s in (-1, 1)]
        sketch = F.kll_sketch_agg_double("x", SKETCH_K)
        got = values.agg(*moments, F.when(F.count("x") > 0, F.kll_sketch_get_quantile_double(
            sketch, F.array(*map(F.lit, sides)))).alias("cuts")).first()
        n = got["count"]
        ranks = [(n - 1) * p for p in QUARTILES]
        cuts = [got["min"] if s == 0 else got["max"] if s == 1 else c for s, c in zip(sides, got["cuts"] or [])]
        found = _at_ranks(values, cuts, ranks) if n else [(None, None)] * 3
        if found is not None:
            q = [a if a is None else float(a + (r - int(r)) * (b - a)) for r, (a, b) in zip(ranks, found)]
            row = (n, got["mean"], got["std"], got["min"], *q, got["max"])
            return df.sparkSession.createDataFrame([row], DESCRIPTION)
        width = min(1.0, 8 * width)


DESCRIPTION = "count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


def _described(one: DataFrame, quartiles: Sequence) -> DataFrame:
    return one.select("count", "mean", "std", "min", *[q.alias(n) for q, n in zip(quartiles, ("p25", "p50", "p75"))], "max")


def _at_ranks(values: DataFrame, cuts: Sequence[float], ranks: Sequence[float]) -> list[tuple] | None:
    """The values at the ranks' floor and ceiling, if they lie inside cuts[0]..cuts[1], cuts[2]..cuts[3], ..; else None."""
    x = F.col("x")
    region = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):  # even regions lie before a bracket, odd ones inside
        region = F.when(x <= cuts[i] if i % 2 else x < cuts[i], i).otherwise(region)
    inside = region % 2 == 1
    parts = materialize(values.groupBy(region.alias("region"), F.when(inside, x).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["region"]: r["n"] for r in parts.groupBy("region").agg(F.sum("n").alias("n")).collect()}  # at most 7 rows
    wanted = sorted({int(v) for r in ranks for v in (r, -(-r // 1))})
    start, of = 0, {}
    for k in range(len(cuts) + 1):
        for w in wanted:
            if start <= w < start + sizes.get(k, 0):
                of[w] = k
        start += sizes.get(k, 0)
    if any(of[w] % 2 == 0 for w in wanted):
        return None
    # a bracket holds some thousandths of the ranks
    inside_so_far = F.sum("n").over(Window.partitionBy("region").orderBy("x"))
    before = {k: sum(sizes.get(j, 0) for j in range(k)) for k in range(len(cuts) + 1)}
    placed = parts.where("region % 2 = 1").withColumn("upto", inside_so_far)
    got = placed.agg(*[F.min(F.when((F.col("region") == of[w]) & (F.col("upto") + before[of[w]] > w), x)).alias(f"v{i}")
                       for i, w in enumerate(wanted)]).first()
    at = dict(zip(wanted, got))
    return [(at[int(r)], at[int(-(-r // 1))]) for r in ranks]


def count_positive(df: DataFrame, y_col: str = "y") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(y_col).cast("bigint").alias("positives"))


def class_balance(df: DataFrame, y_col: str = "y", group_cols: Sequence[str] = ()) -> DataFrame:
    """Negatives, positives and their ratio, the positive-class weight."""
    y = F.col(y_col)
    out = df.groupBy(*group_cols).agg(
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("negatives"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("positives"))
    return out.withColumn("pos_weight", F.try_divide(F.col("negatives").cast("double"),
                                                     F.col("positives").cast("double")))


def table_profile(df: DataFrame) -> DataFrame:
    """One pass: row count and non-null count per column, then unpivoted to
    one row per column with its position and type."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.col(f"`{f.name}`")).alias(f"_nn{i}") for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).cast("bigint").alias("position"),
                     F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.col(f"_nn{i}").alias("non_null"))
            for i, f in enumerate(fields)]
    return (wide.select(F.col("_rows").alias("n_rows"), F.explode(F.array(*rows)).alias("c"))
                .select("c.column_name", "c.position", "c.dtype", "c.non_null", "n_rows"))


def words(df: DataFrame, text_col: str = "text", stopwords: Iterable[str] | None = None,
          cleaned: bool = False) -> DataFrame:
    """One row per word occurrence after cleaning and stop-word removal."""
    txt = F.col(text_col) if cleaned else clean_text(text_col)
    # Cleaned text: single spaces, no edges -> plain split; the filter after
    # the explode is whole-stage codegen'd and the stop list an InSet lookup.
    w = F.col("word")
    keep = w != F.lit("")
    if stopwords is not None:
        keep = keep & ~w.isin(list(stopwords))
    return (df.where(F.col(text_col).isNotNull())
              .select(F.explode(F.split(txt, " ")).alias("word")).where(keep))


def word_count(df: DataFrame, text_col: str = "text", stopwords: Iterable[str] | None = None,
               cleaned: bool = False) -> DataFrame:
    """Corpus word frequency (word, count)."""
    return (words(df, text_col, stopwords, cleaned)
            .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def top_words(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n most common words; ties broken by the word (TakeOrderedAndProject:
    a per-partition top-n, then one merge of n x partitions rows)."""
    return counts.orderBy(F.col("count").desc(), F.col("word").asc()).limit(n)


def word_weights(counts: DataFrame, max_words: int = 200) -> DataFrame:
    """Frequencies scaled by the largest, for the top ``max_words`` words:
    the table a word-cloud renderer draws from."""
    top = top_words(counts, max_words)
    # The peak is the first of the top rows: a window over at most
    # ``max_words`` rows, so the word count is computed once.
    from pyspark.sql import Window
    return top.withColumn("weight", F.col("count") / F.max("count").over(Window.partitionBy()))


def length_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed, as
    numpy draws it, of integers or fractions. Empty bins are listed with
    count 0."""
    spark = df.sparkSession
    # One pass over the input: counts per distinct value (a small table for
    # lengths and counts), checkpointed; range and bins come from it.
    per_value = materialize(df.where(F.col(col).isNotNull())
                              .groupBy(F.col(col).cast("double").alias("x"))
                              .agg(F.count(F.lit(1)).alias("n")))
    x = F.col("x")
    rng = per_value.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = rng["lo"], rng["hi"]
    span = hi - lo
    idx = F.when(span > 0, F.least(F.floor((x - lo) * F.lit(bins) / span), F.lit(bins - 1))) \
           .otherwise(F.lit(bins // 2))
    counts = per_value.groupBy(idx.cast("bigint").alias("bin")).agg(F.sum("n").alias("count"))
    # Edges: with a single value numpy widens the range to [v - 0.5, v + 0.5].
    lo_e = F.when(span > 0, lo.cast("double")).otherwise(lo - 0.5)
    width = F.when(span > 0, span.cast("double") / bins).otherwise(F.lit(1.0) / bins)
    all_bins = spark.range(bins).select(F.col("id").alias("bin"))
    return (all_bins.join(F.broadcast(counts), "bin", "left")
            .select("bin", (lo_e + F.col("bin") * width).alias("lo_edge"),
                    (lo_e + (F.col("bin") + 1) * width).alias("hi_edge"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))
