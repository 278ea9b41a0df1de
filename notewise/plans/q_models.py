"""Model queries: scores, classes, importances, attributions and metrics of fitted models.

What a fitted model returns isn't an SQL expression; tests/test_models.py derives the values a second way
(plain boosting, finite differences, enumeration of subsets, permuted columns, recomputed metrics).

Fixture: ``embeddings`` (64-wide vectors, y = (label = 0)).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.operators import attribution, boosting
from notewise.operators import metrics as me
from notewise.operators import models as mo
from notewise.operators.features import hashed_tfidf
from notewise.plans import recipes as rc
from notewise.plans.catalog import query
from notewise.plans.q_cohort import KEYWORDS, PREVALENCE
from notewise.sources.tables import conversation_notes, document_notes, label_rows, table

N_FEATURES = 64


def _data(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("note_id"), (F.col("label") == 0).cast("int").alias("y"),
                    "embedding")


def _model(spark, sf, gen, learner):
    """(model, prepared rows), fitted anew in each query."""
    prepared = rc.prepare(_data(spark, sf), rc.RECIPES[gen], learner=learner)
    return rc.fit(prepared, rc.RECIPES[gen], learner), prepared


@query("train_gbt")
def q_train_gbt(spark, sf):
    """Boosted trees, recipe v2 (stratified split, class weight, 100 rounds): the test rows' class-1 probability."""
    model, rows = _model(spark, sf, "v2", "gbt")
    return rc.predict(model, rows.where(F.col("split") == "test")).select("note_id", "y", "score")


@query("train_mlp")
def q_train_mlp(spark, sf):
    """Feed-forward network 64-256-64-1, recipe v2 (positives weighted in the loss): as ``train_gbt``."""
    model, rows = _model(spark, sf, "v2", "mlp")
    return rc.predict(model, rows.where(F.col("split") == "test")).select("note_id", "y", "score")


@query("early_stopping")
def q_early_stopping(spark, sf):
    """Recipe v5 boosted trees cut to the best round on the validation split (patience 50): the trees kept,
    the rounds fitted, the best validation loss and the validation ROC-AUC."""
    model, rows = _model(spark, sf, "v5", "gbt")
    scored = rc.predict(model, rows.where(F.col("split") == "val"))
    return me.roc_auc(me.pr_curve(scored)).select(
        F.lit(len(model.trees)).alias("n_trees"), F.lit(len(model.losses)).alias("n_rounds"),
        F.lit(min(model.losses)).alias("best_loss"), "roc_auc")


@query("predict_score")
def q_predict_score(spark, sf):
    """Class-1 probability of every row from the v1 boosted-tree model."""
    model, rows = _model(spark, sf, "v1", "gbt")
    return rc.predict(model, rows).select("note_id", "split", "score")


@query("predict_class")
def q_predict_class(spark, sf):
    """The v1 depth-wise model's own hard decision for every row: 1 where class 1 is the likelier."""
    model, rows = _model(spark, sf, "v1", "xgb")
    return rc.predict(model, rows).select("note_id", "split", (F.col("score") > 0.5).cast("int").alias("pred"))


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Gain, splits and share of all gain of each feature in the v2 boosted trees."""
    model, _ = _model(spark, sf, "v2", "gbt")
    return boosting.importance(model, spark)


@query("attribution_summary")
def q_attribution_summary(spark, sf):
    """Mean |Shapley value| of each feature over the test rows, and the mean value."""
    model, rows = _model(spark, sf, "v2", "gbt")
    return attribution.shapley_summary(model, rows.where(F.col("split") == "test"), "embedding")


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    """Test ROC-AUC with each feature permuted, and the drop from the unpermuted rows."""
    model, rows = _model(spark, sf, "v2", "gbt")
    return mo.permutation_importance(model, mo.with_features(rows.where(F.col("split") == "test")), N_FEATURES)


GRID_GENS, GRID_LEARNERS = ("v1", "v2", "v3", "v4", "v5"), ("gbt", "xgb", "mlp")


@query("experiment_grid")
def q_experiment_grid(spark, sf):
    """All five generations x three learners x two encoders (the vectors; TF-IDF of the labelled notes): 30 cells,
    one row a metric."""
    notes = document_notes(spark, sf).select("note_id", "text")
    labels = label_rows(spark, sf).select("note_id", (F.col("quality") == 0).cast("int").alias("y"))
    text = hashed_tfidf(notes.join(labels.select("note_id"), "note_id", "left_semi"), dim=64).join(labels, "note_id")
    return rc.experiment_grid({"fixture": (_data(spark, sf), N_FEATURES),
                               "hashed_tfidf": (text.select("note_id", "y", "embedding"), 64)}, GRID_GENS, GRID_LEARNERS)


@query("notes_to_metrics")
def q_notes_to_metrics(spark, sf):
    """From raw notes to metrics in one path (cohort, TF-IDF, two side columns, subject-level split, recipe v2)."""
    notes = conversation_notes(spark, sf)
    notes = notes.select("subject_id", (F.col("subject_id") * 100_000 + F.col("note_id")).alias("note_id"), "text",
                         F.col("note_id").cast("int").alias("turn"), "role")
    return rc.notes_to_metrics(notes, KEYWORDS, PREVALENCE, side_cols=("turn", "role"))
