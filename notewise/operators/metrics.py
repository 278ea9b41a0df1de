"""Binary-classification evaluation as DataFrames.

Input is a scored table with a 0/1 truth column and a score (probability of
class 1); optional ``group_cols`` evaluate many (learner, encoder, ...)
combinations in the same jobs.

Curve-based metrics first collapse rows to distinct scores (a hash aggregate
with map-side combine), then take running sums along the score with
:func:`notewise.operators.ranking.running_totals`, which never sorts all
scores in one task. ROC-AUC (ties count one half), average precision (step
sum of recall increase x precision) and the F1-optimal threshold all read
that one curve table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.numeric import apply_threshold, f1_exact, f1_smoothed, safe_div
from notewise.operators.ranking import null_safe_join, running_totals
from notewise.session import BROADCAST_MAX_ROWS, materialize


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one aggregation (rows = truth, columns = prediction)."""
    yy, pp = F.col(y), F.col(pred)

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return df.groupBy(*group_cols).agg(
        n((yy == 0) & (pp == 0)).alias("tn"), n((yy == 0) & (pp == 1)).alias("fp"),
        n((yy == 1) & (pp == 0)).alias("fn"), n((yy == 1) & (pp == 1)).alias("tp"))


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred", group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def report_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted
    averages from the four counts; zero denominators give 0."""
    p0, r0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    p1, r1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    f0, f1 = f1_exact(p0, r0), f1_exact(p1, r1)
    s0, s1 = (tn + fp).cast("double"), (tp + fn).cast("double")
    tot = s0 + s1
    acc = safe_div(tp + tn, tot)

    def w(a, b):
        return safe_div(a * s0 + b * s1, tot)
    cells = [
        ("0", "precision", p0), ("0", "recall", r0), ("0", "f1-score", f0), ("0", "support", s0),
        ("1", "precision", p1), ("1", "recall", r1), ("1", "f1-score", f1), ("1", "support", s1),
        ("accuracy", "f1-score", acc), ("accuracy", "support", tot),
        ("macro avg", "precision", (p0 + p1) / 2), ("macro avg", "recall", (r0 + r1) / 2),
        ("macro avg", "f1-score", (f0 + f1) / 2), ("macro avg", "support", tot),
        ("weighted avg", "precision", w(p0, p1)), ("weighted avg", "recall", w(r0, r1)),
        ("weighted avg", "f1-score", w(f0, f1)), ("weighted avg", "support", tot),
    ]
    return [F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for c, m, v in cells]


def classification_report(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long report table (group..., class, metric, value) from confusion counts."""
    cells = report_columns(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return (counts.select(*group_cols, F.explode(F.array(*cells)).alias("c"))
                  .select(*group_cols, "c.class", "c.metric", "c.value"))


def score_groups(scored: DataFrame, score: str = "score", y: str = "y",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: positives dp and negatives dn at it."""
    return scored.groupBy(*group_cols, score).agg(
        F.sum(F.col(y).cast("bigint")).alias("dp"),
        F.sum((1 - F.col(y)).cast("bigint")).alias("dn"))


def pr_curve(scored: DataFrame, score: str = "score", y: str = "y",
             group_cols: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Precision and recall with threshold = each distinct score (``score >=
    threshold`` counts as positive), plus tp, fp, the counts at the score and
    the smoothed F1 ``2pr / (p + r + 1e-8)``. The end point (precision 1,
    recall 0) has no threshold and is not a row."""
    # Distinct scores are read by four steps (range, bucket sums, windows,
    # totals): checkpoint them so the scoring behind them runs once.
    return curve_of_groups(materialize(score_groups(scored, score, y, group_cols)), score, group_cols, n_buckets)


def curve_of_groups(g: DataFrame, score: str = "score", group_cols: Sequence[str] = (),
                    n_buckets: int | None = None) -> DataFrame:
    """:func:`pr_curve` from its distinct scores (group columns, score, dp, dn), a written table."""
    k = running_totals(g, score, ["dp", "dn"], group_cols, descending=True,
                       n_buckets=n_buckets, prefix="cum_")
    if group_cols:
        totals = g.groupBy(*group_cols).agg(F.sum("dp").alias("np"), F.sum("dn").alias("nn"))
        totals = materialize(totals)
        k = null_safe_join(k, totals, list(group_cols), small=totals.count() <= BROADCAST_MAX_ROWS)
        np_, nn_ = F.col("np"), F.col("nn")
    else:
        t = g.agg(F.struct(F.sum("dp").alias("np"), F.sum("dn").alias("nn"))).scalar()
        k = k.withColumn("np", t["np"]).withColumn("nn", t["nn"])
        np_, nn_ = F.col("np"), F.col("nn")
    tp, fp = F.col("cum_dp"), F.col("cum_dn")
    precision = tp / (tp + fp)
    recall = F.when(np_ == 0, F.lit(1.0)).otherwise(tp / np_)
    return k.select(*group_cols, F.col(score).alias("threshold"), "dp", "dn",
                    tp.alias("tp"), fp.alias("fp"), np_.alias("np"), nn_.alias("nn"),
                    precision.alias("precision"), recall.alias("recall"),
                    f1_smoothed(precision, recall).alias("f1"))


def roc_auc(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Area under ROC with tied scores at half weight:
    sum over distinct scores of (tp - dp/2) * dn, over P * N."""
    contrib = (F.col("tp") - F.col("dp") / 2.0) * F.col("dn")
    return curve.groupBy(*group_cols).agg(
        (F.sum(contrib) / (F.max("np") * F.max("nn"))).alias("roc_auc"))


def average_precision(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under the PR curve: sum of (dp / P) * precision."""
    return curve.groupBy(*group_cols).agg(
        F.sum(F.col("dp") / F.col("np") * F.col("precision")).alias("average_precision"))


def best_threshold(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Threshold with the highest smoothed F1; ties go to the lowest
    threshold. A max over a (f1, -threshold) struct: partial aggregation per
    task, no window over the curve."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_t"),
                          F.col("precision"), F.col("recall")))
    out = curve.groupBy(*group_cols).agg(best.alias("b"))
    return out.select(*group_cols, (-F.col("b.neg_t")).alias("threshold"), F.col("b.f1").alias("f1"),
                      F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def counts_at_best(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of ``score > threshold`` at the best threshold, from its own row of the
    curve: the rows at the threshold itself (dp, dn) are not above it. The scores aren't read again."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_t"), F.col("tp"), F.col("fp"),
                          F.col("dp"), F.col("dn"), F.col("np"), F.col("nn")))
    b = curve.groupBy(*group_cols).agg(best.alias("b")).select(*group_cols, "b.*")
    tp, fp = F.col("tp") - F.col("dp"), F.col("fp") - F.col("dn")
    return b.select(*group_cols, (F.col("nn") - fp).cast("bigint").alias("tn"), fp.cast("bigint").alias("fp"),
                    (F.col("np") - tp).cast("bigint").alias("fn"), tp.cast("bigint").alias("tp"))


def classify(scored: DataFrame, threshold, score: str = "score", inclusive: bool = False,
             out_col: str = "pred") -> DataFrame:
    """Hard labels ``score > threshold``; ``threshold`` may be a number, a
    Column (e.g. a scalar subquery of :func:`best_threshold`) or a column name."""
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    return scored.withColumn(out_col, apply_threshold(score, t, inclusive))


def threshold_sweep(scored: DataFrame, thresholds: dict, score: str = "score", y: str = "y") -> DataFrame:
    """Confusion counts and accuracy for several named thresholds in a single
    pass over the scores (conditional sums, then one row per policy)."""
    sy = F.col(y)
    aggs = []
    for name, t in thresholds.items():
        tc = t if isinstance(t, Column) else F.lit(float(t))
        p = F.col(score) > tc

        def n(cond):
            return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
        aggs.append(F.struct(F.lit(name).alias("policy"), tc.cast("double").alias("threshold"),
                             n((sy == 0) & ~p).alias("tn"), n((sy == 0) & p).alias("fp"),
                             n((sy == 1) & ~p).alias("fn"), n((sy == 1) & p).alias("tp")))
    wide = scored.agg(*[a.alias(f"p{i}") for i, a in enumerate(aggs)])
    rows = wide.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(aggs))])).alias("r"))
    out = rows.select("r.*")
    return out.withColumn("accuracy", safe_div(F.col("tp") + F.col("tn"),
                                               F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def evaluate(scored: DataFrame, threshold=None, score: str = "score", y: str = "y",
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Long metrics table: accuracy, roc_auc, average_precision, threshold and
    the classification report, per group. ``threshold=None`` tunes it (best
    smoothed F1 on this same table, like the reference's recipes v3+)."""
    curve = pr_curve(scored, score, y, group_cols)
    auc = roc_auc(curve, group_cols)
    ap = average_precision(curve, group_cols)
    if threshold is None:
        bt = best_threshold(curve, group_cols).select(*group_cols, F.col("threshold").alias("_t"))
    else:
        tcol = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        bt = scored.select(*group_cols).distinct().withColumn("_t", tcol)
    if group_cols:
        bt = materialize(bt)
        labelled = null_safe_join(scored, bt, list(group_cols), small=bt.count() <= BROADCAST_MAX_ROWS)
    else:
        labelled = scored.withColumn("_t", bt.select("_t").scalar())
    labelled = labelled.withColumn("pred", apply_threshold(score, F.col("_t")))
    counts = confusion_matrix(labelled, y, "pred", group_cols)
    rep = classification_report(counts, group_cols)
    def long(df, metric, col):
        return df.select(*group_cols, F.lit("all").alias("class"), F.lit(metric).alias("metric"),
                         F.col(col).cast("double").alias("value"))
    return (rep.unionByName(long(auc, "roc_auc", "roc_auc"))
               .unionByName(long(ap, "average_precision", "average_precision"))
               .unionByName(long(bt, "threshold", "_t")))
