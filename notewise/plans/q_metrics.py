"""Queries for evaluation operators.

Model-free fixture: ``score = round(sum of all dimensions, 2)`` and ``y = (label = 0)``
(see :func:`notewise.sources.tables.scored_rows`). The leaderboard treats
embedding dimensions 0-63 as learners and labels 0-9 as encoders (640 rows).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notewise.functions.numeric import apply_threshold, sigmoid
from notewise.operators import metrics as me
from notewise.plans.catalog import query
from notewise.plans.sqlbits import curve_sql, scored_sql
from notewise.session import materialize
from notewise.sources import io
from notewise.sources.tables import scored_rows, table

CURVE = curve_sql(scored_sql())
BEST_SQL = (f"WITH {CURVE}, b AS (SELECT score AS t FROM c ORDER BY "
            f"2 * precision * recall / (precision + recall + 1e-8) DESC, score ASC LIMIT 1)")
PRED_SQL = f"{BEST_SQL}, p AS (SELECT s.*, CAST(s.score > b.t AS INTEGER) AS pred FROM s, b)"
COUNTS_SQL = (f"{PRED_SQL}, cm AS (SELECT "
              "CAST(SUM(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
              "CAST(SUM(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
              "CAST(SUM(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
              "CAST(SUM(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM p)")


def _div(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST(({a}) AS DOUBLE) / ({b}) END"


def _f1(p, r):
    return _div(f"2.0 * ({p}) * ({r})", f"({p}) + ({r})")


def report_cells_sql(src: str = "cm", extra_cols: str = "") -> str:
    """Unpivoted classification report from tn/fp/fn/tp columns of ``src``."""
    p0, r0 = _div("tn", "tn + fn"), _div("tn", "tn + fp")
    p1, r1 = _div("tp", "tp + fp"), _div("tp", "tp + fn")
    f0, f1 = _f1(p0, r0), _f1(p1, r1)
    s0, s1, tot = "CAST(tn + fp AS DOUBLE)", "CAST(tp + fn AS DOUBLE)", "CAST(tn + fp + tp + fn AS DOUBLE)"

    def w(a, b):
        return _div(f"({a}) * {s0} + ({b}) * {s1}", tot)
    cells = [
        ("0", "precision", p0), ("0", "recall", r0), ("0", "f1-score", f0), ("0", "support", s0),
        ("1", "precision", p1), ("1", "recall", r1), ("1", "f1-score", f1), ("1", "support", s1),
        ("accuracy", "f1-score", _div("tp + tn", tot)), ("accuracy", "support", tot),
        ("macro avg", "precision", f"(({p0}) + ({p1})) / 2"), ("macro avg", "recall", f"(({r0}) + ({r1})) / 2"),
        ("macro avg", "f1-score", f"(({f0}) + ({f1})) / 2"), ("macro avg", "support", tot),
        ("weighted avg", "precision", w(p0, p1)), ("weighted avg", "recall", w(r0, r1)),
        ("weighted avg", "f1-score", w(f0, f1)), ("weighted avg", "support", tot),
    ]
    return " UNION ALL ".join(
        f"SELECT {extra_cols}'{c}' AS class, '{m}' AS metric, round({v}, 6) AS value FROM {src}"
        for c, m, v in cells)


def _scored(spark, sf):
    return scored_rows(spark, sf)


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _tuned(spark, sf):
    s = _scored(spark, sf)
    best = me.best_threshold(me.pr_curve(s)).select("threshold").scalar()
    return s, best


@query("pr_curve", f"WITH {CURVE} SELECT score AS threshold, CAST(dp AS BIGINT) AS dp, CAST(dn AS BIGINT) AS dn, "
       "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, "
       "round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-8), 6) AS f1 FROM c")
def q_pr_curve(spark, sf):
    """Precision/recall/F1 at every distinct score (two-level running sum)."""
    c = me.pr_curve(_scored(spark, sf))
    return _r6(c.select("threshold", "dp", "dn", "tp", "fp", "precision", "recall", "f1"),
               {"precision", "recall", "f1"})


@query("f1_smoothed", f"WITH {CURVE} SELECT score AS threshold, "
       "round(2 * precision * recall / (precision + recall + 1e-8), 6) AS f1 FROM c")
def q_f1_smoothed(spark, sf):
    c = me.pr_curve(_scored(spark, sf))
    return c.select("threshold", F.round("f1", 6).alias("f1"))


@query("best_threshold", f"WITH {CURVE} SELECT score AS threshold, round(2 * precision * recall / "
       "(precision + recall + 1e-8), 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c "
       "ORDER BY 2 * precision * recall / (precision + recall + 1e-8) DESC, score ASC LIMIT 1")
def q_best_threshold(spark, sf):
    """Threshold with the highest smoothed F1 (lowest threshold on ties)."""
    b = me.best_threshold(me.pr_curve(_scored(spark, sf)))
    return _r6(b, {"f1", "precision", "recall"})


@query("roc_auc", f"WITH {CURVE} SELECT round(SUM((tp - dp / 2.0) * dn) / (MAX(np) * MAX(nn)), 6) AS roc_auc FROM c")
def q_roc_auc(spark, sf):
    """ROC-AUC with ties at half weight, from the distinct-score curve."""
    return me.roc_auc(me.pr_curve(_scored(spark, sf))).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("average_precision", f"WITH {CURVE} SELECT round(SUM(dp / np * precision), 6) AS average_precision FROM c")
def q_average_precision(spark, sf):
    """Average precision: step sum of recall increase times precision."""
    ap = me.average_precision(me.pr_curve(_scored(spark, sf)))
    return ap.select(F.round("average_precision", 6).alias("average_precision"))


@query("apply_threshold", f"{PRED_SQL} SELECT note_id, y, score, pred FROM p")
def q_apply_threshold(spark, sf):
    """Hard labels at the tuned threshold, strict ``score > t``."""
    s, best = _tuned(spark, sf)
    return s.select("note_id", "y", "score", apply_threshold("score", best).alias("pred"))


@query("confusion_matrix", f"{COUNTS_SQL} SELECT tn, fp, fn, tp FROM cm")
def q_confusion_matrix(spark, sf):
    return me.counts_at_best(me.pr_curve(_scored(spark, sf)))


@query("accuracy", f"{PRED_SQL} SELECT round(AVG(CAST(pred = y AS DOUBLE)), 6) AS accuracy FROM p")
def q_accuracy(spark, sf):
    c = me.counts_at_best(me.pr_curve(_scored(spark, sf)))
    right, rows = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return c.select(F.round(right / rows, 6).alias("accuracy"))


@query("classification_report", f"{COUNTS_SQL} {report_cells_sql()}")
def q_classification_report(spark, sf):
    """Per-class precision/recall/F1/support, accuracy, macro and weighted rows."""
    rep = me.classification_report(me.counts_at_best(me.pr_curve(_scored(spark, sf))))
    return rep.withColumn("value", F.round("value", 6))


@query("threshold_sweep", f"""{BEST_SQL}
SELECT policy, round(t, 6) AS threshold, tn, fp, fn, tp, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6)
       AS accuracy FROM (
  SELECT x.policy, x.t,
         CAST(SUM(CASE WHEN s.y = 0 AND NOT s.score > x.t THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(SUM(CASE WHEN s.y = 0 AND s.score > x.t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(SUM(CASE WHEN s.y = 1 AND NOT s.score > x.t THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(SUM(CASE WHEN s.y = 1 AND s.score > x.t THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM s, (SELECT 'fixed_0.5' AS policy, 0.5 AS t UNION ALL SELECT 'fixed_0.3', 0.3
           UNION ALL SELECT 'tuned', t FROM b) x
  GROUP BY x.policy, x.t)""")
def q_threshold_sweep(spark, sf):
    """The three threshold policies (0.5, 0.3, tuned) in one pass."""
    s, best = _tuned(spark, sf)
    out = me.threshold_sweep(s, {"fixed_0.5": 0.5, "fixed_0.3": 0.3, "tuned": best})
    return _r6(out, {"threshold", "accuracy"})


@query("sigmoid", "SELECT vec_id AS note_id, list_transform(CAST(embedding AS DOUBLE[]), "
       "lambda x: round(1.0 / (1.0 + exp(-x)), 6)) AS p FROM embeddings")
def q_sigmoid(spark, sf):
    """Logit -> probability on every embedding dimension."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("note_id"),
                    F.transform("embedding", lambda x: F.round(sigmoid(x.cast("double")), 6)).alias("p"))


LEADERBOARD_SQL = """
WITH s AS (SELECT e.vec_id, d.learner, x.encoder, CAST(e.label = x.encoder AS INTEGER) AS y,
                  round(CAST(e.embedding[d.learner + 1] AS DOUBLE), 2) AS score
           FROM embeddings e, range(64) AS d(learner), range(10) AS x(encoder)),
     g AS (SELECT learner, encoder, score, SUM(y) AS dp, COUNT(*) - SUM(y) AS dn FROM s GROUP BY ALL),
     k AS (SELECT *, SUM(dp) OVER (PARTITION BY learner, encoder ORDER BY score DESC) AS tp FROM g),
     t AS (SELECT learner, encoder, SUM(dp) AS np, SUM(dn) AS nn FROM g GROUP BY ALL),
     a AS (SELECT learner, encoder, round(SUM((tp - dp / 2.0) * dn) / (MAX(np) * MAX(nn)), 6) AS roc_auc
           FROM k JOIN t USING (learner, encoder) GROUP BY ALL)
SELECT CAST(encoder AS BIGINT) AS encoder, CAST(learner AS BIGINT) AS learner, roc_auc,
       CAST(row_number() OVER (PARTITION BY encoder ORDER BY roc_auc DESC, learner) AS BIGINT) AS rank,
       CAST(row_number() OVER (ORDER BY roc_auc DESC, encoder, learner) AS BIGINT) AS overall_rank
FROM a"""


def leaderboard(results, metric: str = "roc_auc", by: str = "encoder", who: str = "learner"):
    """Rank learners within each encoder, and all pairs overall, by a rounded
    metric (ties by name). ``results`` has one row per (encoder, learner), so
    the overall window runs over that small table."""
    w = Window.partitionBy(by).orderBy(F.col(metric).desc(), F.col(who))
    w_all = Window.orderBy(F.col(metric).desc(), F.col(by), F.col(who))
    return (results.withColumn("rank", F.row_number().over(w).cast("bigint"))
                   .withColumn("overall_rank", F.row_number().over(w_all).cast("bigint")))


@query("leaderboard", LEADERBOARD_SQL)
def q_leaderboard(spark, sf):
    """All (dimension, label) pairs scored by ROC-AUC and ranked per label. Rows are
    counted by (dimension, score, label) before any pair is made; each label's positives
    and negatives at a score follow from those counts."""
    e = table(spark, sf, "embeddings")
    rows = (e.select("label", F.posexplode("embedding").alias("learner", "v"))
             .groupBy(F.col("learner").cast("bigint").alias("learner"), F.round(F.col("v").cast("double"), 2).alias("score"))
             .pivot("label", list(range(10))).count())
    total = sum((F.coalesce(F.col(str(i)), F.lit(0)) for i in range(1, 10)), F.coalesce(F.col("0"), F.lit(0)))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("encoder"),
                                         F.coalesce(F.col(str(i)), F.lit(0)).alias("dp")) for i in range(10)]))
    g = rows.select("learner", "score", total.alias("n"), pairs.alias("p")).select(
        "learner", F.col("p.encoder").alias("encoder"), "score", F.col("p.dp").alias("dp"), (F.col("n") - F.col("p.dp")).alias("dn"))
    groups = ["learner", "encoder"]
    auc = me.roc_auc(me.curve_of_groups(materialize(g), "score", groups), groups)
    auc = auc.withColumn("roc_auc", F.round("roc_auc", 6))
    return leaderboard(auc).select("encoder", "learner", "roc_auc", "rank", "overall_rank")


@query("write_metrics", f"""{COUNTS_SQL},
  auc AS (SELECT SUM((tp - dp / 2.0) * dn) / (MAX(np) * MAX(nn)) AS v FROM c),
  ap AS (SELECT SUM(dp / np * precision) AS v FROM c),
  cells AS ({report_cells_sql()}
     UNION ALL SELECT 'all', 'roc_auc', round(v, 6) FROM auc
     UNION ALL SELECT 'all', 'average_precision', round(v, 6) FROM ap
     UNION ALL SELECT 'all', 'threshold', round(t, 6) FROM b)
SELECT 'fixture' AS gen, 'sum' AS learner, 'label0' AS encoder, metric, class, value FROM cells""")
def q_write_metrics(spark, sf):
    """Full evaluation (report, AUC, AP, tuned threshold) appended to the
    metrics table partitioned by generation, read back."""
    ev = me.evaluate(_scored(spark, sf))
    ev = ev.select(F.lit("fixture").alias("gen"), F.lit("sum").alias("learner"),
                   F.lit("label0").alias("encoder"), "metric", "class", F.round("value", 6).alias("value"))
    back = io.write_metrics(ev, mode="overwrite")
    return back.select("gen", "learner", "encoder", "metric", "class", "value")
