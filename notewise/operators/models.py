"""Model fitting, scoring and attribution on Spark ML.

Learners: ``GBTClassifier`` for the boosted-tree recipes and
``MultilayerPerceptronClassifier`` for the feed-forward ones. Both train
with distributed aggregation over the executors; the fitted model object is
driver-side (its size is bounded by trees x nodes or by the layer sizes,
never by the data).

Differences from the reference's libraries, by necessity:
* GBT: ``num_leaves``/L1/L2 have no counterpart; column sampling is per
  node (``featureSubsetStrategy``); ``weightCol`` weights impurity and leaf
  values, close to but not equal to ``scale_pos_weight``.
* Early stopping: :func:`train_gbt_early` keeps the rounds up to the best
  validation loss and stops once ``patience`` rounds bring no better one.
* MLP: sigmoid hidden units, softmax output, L-BFGS or GD; no dropout,
  batch norm, Adam or class weights (``MultilayerPerceptronClassifier`` has
  no ``weightCol``), so class balance comes from resampling.
* Attribution: path attribution (change of node mean along each row's path,
  times the tree weight), which sums exactly to the raw margin. It is not
  TreeSHAP.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.functions.numeric import hash_unit
from notewise.session import materialize, scratch_path, ship_package


def with_features(df: DataFrame, vec_col: str = "embedding", out_col: str = "features") -> DataFrame:
    return df.withColumn(out_col, array_to_vector(F.col(vec_col).cast("array<double>")))


#: Training rows that one task should hold; a boosting round is a job or more per tree
#: level, so tasks that hold a handful of rows cost more than they compute.
ROWS_PER_TASK = 50_000


def train_gbt(train: DataFrame, label: str = "y", features: str = "features", weight: str | None = None,
              max_iter: int = 100, step_size: float = 0.1, max_depth: int = 5,
              subsampling_rate: float = 1.0, feature_subset: str = "all", seed: int = 42,
              max_bins: int = 32, cache_node_ids: bool | None = None):
    """Fit a binary boosted-tree model with all ``max_iter`` rounds.

    Node-id caching (with a checkpoint every 10 trees to keep lineage short)
    pays off for deep trees; by default it is on from depth 8."""
    if cache_node_ids is None:
        cache_node_ids = max_depth >= 8
    gbt = GBTClassifier(labelCol=label, featuresCol=features, maxIter=max_iter, stepSize=step_size,
                        maxDepth=max_depth, subsamplingRate=subsampling_rate,
                        featureSubsetStrategy=feature_subset, seed=seed, maxBins=max_bins,
                        cacheNodeIds=cache_node_ids, checkpointInterval=10)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.fit(train.withColumn(label, F.col(label).cast("double")))


def dealt_by_size(rows: DataFrame, n_rows: int) -> DataFrame:
    """Training rows in tasks of about ROWS_PER_TASK."""
    return rows.repartition(max(1, -(-n_rows // ROWS_PER_TASK)))


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the lowest loss before ``patience`` rounds without a better one, whether it stopped there)."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def train_gbt_early(train: DataFrame, validation: DataFrame, label: str = "y", max_iter: int = 1000,
                    patience: int = 50, **settings):
    """Boosted trees kept up to the round of the lowest validation log loss.

    Rounds are fitted 2 x ``patience`` at first and then twice as many (a
    round depends on its seed and the rounds before, so a longer fit begins
    with the same trees), until ``patience`` rounds after the best one are
    known or ``max_iter`` is reached; the model is cut to its best prefix.
    All prefixes' losses come from one pass over the validation rows."""
    validation = validation.withColumn(label, F.col(label).cast("double"))
    n = min(max_iter, 2 * patience)
    while True:
        model = train_gbt(train, label=label, max_iter=n, **settings)
        rounds, stopped = best_round(model.evaluateEachIteration(validation), patience)
        if stopped or n >= max_iter:
            return first_trees(model, rounds, train.sparkSession)
        n = min(max_iter, 2 * n)


def first_trees(model, n: int, spark):
    """The model of the first ``n`` trees."""
    if n >= model.getNumTrees:
        return model
    sc, java = spark.sparkContext, model._java_obj
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    cut = java.copyValues(cut, java.extractParamMap())
    return type(model)(cut)


def train_mlp(train: DataFrame, n_features: int, hidden: Sequence[int] = (256, 64), label: str = "y",
              features: str = "features", max_iter: int = 10, solver: str = "gd",
              step_size: float = 0.03, block_size: int = 128, seed: int = 42):
    """Fit a feed-forward network ``[n_features, *hidden, 2]``."""
    mlp = MultilayerPerceptronClassifier(labelCol=label, featuresCol=features,
                                         layers=[n_features, *hidden, 2], maxIter=max_iter,
                                         solver=solver, stepSize=step_size, blockSize=block_size,
                                         seed=seed)
    return mlp.fit(train.withColumn(label, F.col(label).cast("double")))


def predict_score(model, df: DataFrame, out_col: str = "score") -> DataFrame:
    """Probability of class 1."""
    out = model.transform(df)
    return out.withColumn(out_col, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def predict_class(model, df: DataFrame, out_col: str = "pred") -> DataFrame:
    """The model's own hard decision (argmax of the probability)."""
    out = model.transform(df)
    return out.withColumn(out_col, F.col("prediction").cast("int")).drop(
        "rawPrediction", "probability", "prediction")


def feature_importance(model, spark, top_n: int | None = None) -> DataFrame:
    """Global importances of a tree model as (feature, importance), ranked; all of
    them unless ``top_n``. One entry per feature: bounded by the model, not the data."""
    imp = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "feature int, importance double")
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(top_n) if top_n else df


def _tree_tables(model, sp):
    """Nodes of every tree from the model's own saved form (Parquet), as
    numpy arrays per tree: feature, threshold, left, right, prediction."""
    path = scratch_path(sp, "gbt-model")
    model.write().overwrite().save(path)
    nodes = (sp.read.parquet(f"{path}/data")
               .select("treeID", F.col("nodeData.id").alias("id"),
                       F.col("nodeData.prediction").alias("pred"),
                       F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                       F.col("nodeData.split.featureIndex").alias("feat"),
                       F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"))
               .toPandas())
    weights = list(model.treeWeights)
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        feat = np.full(n, -1, np.int64)
        thr = np.zeros(n)
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        pred = np.zeros(n)
        ids = g["id"].to_numpy()
        feat[ids] = g["feat"].to_numpy()
        thr[ids] = [t[0] if len(t) else 0.0 for t in g["thr"]]
        left[ids], right[ids] = g["left"].to_numpy(), g["right"].to_numpy()
        pred[ids] = g["pred"].to_numpy()
        trees.append((weights[int(tid)], feat, thr, left, right, pred))
    return trees


def _contributions(trees, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bias, contributions) of each row: what each split on a row's path changed in the margin."""
    n, d = x.shape
    contrib, bias, rows = np.zeros((n, d)), np.zeros(n), np.arange(n)
    for w, feat, thr, left, right, pred in trees:
        node = np.zeros(n, np.int64)
        bias += w * pred[0]
        while (live := left[node] >= 0).any():
            r, nd = rows[live], node[live]
            f = feat[nd]
            child = np.where(x[r, f] <= thr[nd], left[nd], right[nd])
            np.add.at(contrib, (r, f), w * (pred[child] - pred[nd]))
            node[live] = child
    return bias, contrib


def _margins(trees, x: np.ndarray) -> np.ndarray:
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for w, feat, thr, left, right, pred in trees:
        node = np.zeros(len(x), np.int64)
        while (live := left[node] >= 0).any():
            nd = node[live]
            node[live] = np.where(x[rows[live], feat[nd]] <= thr[nd], left[nd], right[nd])
        out += w * pred[node]
    return out


def path_attribution(model, df: DataFrame, features: str = "features", key: str = "note_id") -> DataFrame:
    """Per-row additive contributions of each feature to the raw margin
    (plus ``bias``) for a GBT model, computed in Arrow batches. The tree
    arrays (bounded by the model) are broadcast once."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(_tree_tables(model, df.sparkSession))

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
            bias, contrib = _contributions(shared.value, x)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "bias": bias, "contrib": list(contrib)})
    src = df.select(key, vector_to_array(features).alias("x"))
    return src.mapInPandas(run, f"{key} long, bias double, contrib array<double>")


def attribution_summary(model, df: DataFrame, features: str = "features", top_n: int | None = None) -> DataFrame:
    """(feature, mean_abs, margin_gap): mean absolute contribution per feature, all of them unless
    ``top_n``. Sums are taken inside each batch, one row per feature and batch; ``margin_gap`` is the
    largest difference between a row's margin and its bias plus contributions (0 but for rounding)."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(_tree_tables(model, df.sparkSession))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
                bias, contrib = _contributions(shared.value, x)
                gap = float(np.abs(bias + contrib.sum(axis=1) - pdf["margin"].to_numpy()).max())
                yield pd.DataFrame({"feature": np.arange(x.shape[1]), "total": np.abs(contrib).sum(axis=0),
                                    "n": len(pdf), "gap": gap})
    # the classifier's raw prediction is (-margin, margin)
    raw = model.transform(df).select(vector_to_array(features).alias("x"),
                                     vector_to_array("rawPrediction")[1].alias("margin"))
    sums = raw.mapInPandas(run, "feature int, total double, n long, gap double")
    out = sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs"), F.max("gap").alias("margin_gap"))
    out = out.orderBy(F.col("mean_abs").desc(), "feature")
    return out.limit(top_n) if top_n else out


def permutation_importance(model, df: DataFrame, n_features: int, label: str = "y", key: str = "note_id",
                           features: str = "features", seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """Drop in ROC-AUC when one feature's values are permuted across rows.

    The permutation is a cyclic shift by one inside hash blocks of about
    ``block_rows`` rows (ordered by hash), so it is seeded, partition
    independent and needs no global ordering. A batch of rows with their
    partners is scored once per feature by the tree arrays; what leaves the
    batch is a count per (feature, score, label), from which the curves of all
    features are built together. Feature -1 is the unpermuted baseline.
    """
    from notewise.operators.metrics import curve_of_groups, roc_auc
    ship_package(df.sparkSession)
    base = df.select(key, label, vector_to_array(features).alias("x"))
    n_rows = base.agg(F.count(F.lit(1))).scalar()
    n_blocks = F.greatest(F.lit(1), F.ceil(n_rows / F.lit(block_rows)))
    b = base.withColumn("_h", hash_unit(seed, F.col(key))).withColumn("_blk", F.pmod(F.col("_h"), n_blocks))
    w = Window.partitionBy("_blk").orderBy("_h", key)
    wl = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = b.withColumn("px", F.coalesce(F.lead("x").over(w), F.first("x").over(wl)))
    own = hasattr(model, "margins")  # otherwise a Spark ML model, read from its saved form
    shared = df.sparkSession.sparkContext.broadcast(model if own else _tree_tables(model, df.sparkSession))

    def run(batches):
        margins = shared.value.margins if own else lambda x: _margins(shared.value, x)
        for pdf in batches:
            if not len(pdf):
                continue
            x, px = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("x", "px"))
            y = pdf["y"].to_numpy()
            for f in range(-1, n_features):
                z = x
                if f >= 0:
                    z = x.copy()
                    z[:, f] = px[:, f]
                score, at = np.unique(np.round(margins(z), 12), return_inverse=True)
                dp = np.bincount(at, y, len(score)).astype(np.int64)
                yield pd.DataFrame({"feature": f, "score": score, "dp": dp, "dn": np.bincount(at, minlength=len(score)) - dp})

    counts = b.select(F.col(label).cast("int").alias("y"), "x", "px").mapInPandas(run, "feature int, score double, dp long, dn long")
    g = materialize(counts.groupBy("feature", "score").agg(F.sum("dp").alias("dp"), F.sum("dn").alias("dn")))
    auc = materialize(roc_auc(curve_of_groups(g, "score", ["feature"]), ["feature"]))
    base_auc = auc.where("feature = -1").select("roc_auc").scalar()
    return auc.where("feature >= 0").select("feature", F.col("roc_auc").alias("permuted_auc"),
                                            (base_auc - F.col("roc_auc")).alias("auc_drop"))
