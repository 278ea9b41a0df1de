"""Training recipes v1-v5 and the experiment grid.

A recipe is data: how to split, how to rebalance, whether to weight the
positive class, which threshold policy to use and the learner settings.
:func:`run_recipe` turns one (recipe, learner, encoder) into a long metrics
table; :func:`experiment_grid` fits all cells of encoder x generation x learner
together (the cells share their jobs) and evaluates them in one pass.

Generations, in the reference's words:
v1 plain split, no weight, threshold 0.5; v2 stratified, class weight,
threshold 0.3; v3 v2 + F1-tuned threshold; v4 SMOTE before the split (and
``v4_train_only``, SMOTE on the training split only); v5 80/10/10 split,
under-sampled train, early stopping and threshold tuning on validation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.operators import boosting, network
from notewise.operators import metrics as me
from notewise.operators import sampling as sa
from notewise.operators.cohort import case_control_cohort
from notewise.operators.features import align_embeddings, fuse_features, hashed_tfidf
from notewise.operators.smote import smote_balance
from notewise.session import materialize, scratch_path

#: Histogram bins a feature.
BINS = 64
#: Rounds without a better validation loss after which a recipe stops.
PATIENCE = 50

# The learner settings of each generation. "gbt" and "xgb" are the two
# boosted-tree columns of the published grid: best-first trees of at most so many leaves,
# and trees grown to a depth (leaves = 2 ** depth, so that depth alone ends growth) with
# those libraries' defaults where a generation says nothing. They differ in v1's split
# and in which generations stop early.
_LEAFWISE = dict(rounds=100, step=0.1, leaves=31, min_rows=20, min_hessian=1e-3)
_LEAFWISE_SLOW = dict(rounds=1000, step=0.01, leaves=64, l1=0.1, l2=0.1, row_share=0.8, feature_share=0.8, min_rows=20, min_hessian=1e-3)
_DEPTHWISE = dict(rounds=100, step=0.3, depth=6, leaves=64, l2=1.0, min_rows=1, min_hessian=1.0, start="zero")
_DEPTHWISE_SLOW = dict(rounds=1000, step=0.01, l1=0.1, l2=0.1, row_share=0.8, feature_share=0.8, min_rows=1, min_hessian=1.0, start="zero")
_NET = dict(hidden=(256, 64), dropout=(0.3, 0.0), epochs=10, step=1e-4)
_NET_DEEP = dict(hidden=(512, 256, 64), dropout=(0.4, 0.3, 0.0), batch_norm=True, epochs=20, step=1e-4)
_V4 = dict(split="stratified", weight=True, threshold="tuned", tune_on="test", early_stop_on="test",
           gbt=dict(_LEAFWISE_SLOW, depth=10, patience=PATIENCE), xgb=dict(_DEPTHWISE_SLOW, depth=8, leaves=256), mlp=_NET_DEEP)
_V5 = dict(split="three_way", resample="undersample_train", weight=True, threshold="tuned", tune_on="val", early_stop_on="val",
           gbt=dict(_LEAFWISE_SLOW, depth=10, patience=PATIENCE),
           xgb=dict(_DEPTHWISE_SLOW, depth=10, leaves=1024, l1=0.0, l2=1.0, patience=PATIENCE, metric="average_precision"), mlp=_NET_DEEP)
RECIPES = {
    "v1": dict(split="random", resample=None, weight=False, threshold=0.5, gbt=_LEAFWISE, xgb=_DEPTHWISE, xgb_split="stratified",
               mlp=_NET),
    "v2": dict(split="stratified", resample=None, weight=True, threshold=0.3, gbt=_LEAFWISE, xgb=_DEPTHWISE, mlp=_NET),
    "v3": dict(split="stratified", resample=None, weight=True, threshold="tuned", tune_on="test", gbt=_LEAFWISE_SLOW,
               xgb=dict(_DEPTHWISE_SLOW, depth=6, leaves=64), mlp=_NET),
    "v4": dict(_V4, resample="smote_all"),
    "v4_train_only": dict(_V4, resample="smote_train"),
    "v5": dict(_V5, eval_on="val"),
    # v5 with the threshold tuned on validation and metrics on the untouched
    # test split (the reference leaves its test split unused).
    "v5_test": dict(_V5, eval_on="test"),
}


def prepare(data: DataFrame, recipe: dict, seed: int = 42, learner: str = "gbt", group_col: str | None = None) -> DataFrame:
    """Split and rebalance: rows (note_id, y, embedding, split), written by split.

    ``group_col`` (a subject id) keeps all rows of a group on one side; it
    replaces the recipe's own two-way split."""
    rs = recipe.get("resample")
    if rs == "smote_all":
        data = smote_balance(data, "note_id", "embedding", "y", minority=1, seed=seed).drop("synthetic", "source_id", "copy")
    kind = recipe.get(f"{learner}_split", recipe["split"])
    if group_col is not None and kind != "three_way":
        s = sa.split_by_group(data, group_col, 0.2, seed)
    elif kind == "random":
        s = sa.split_random(data, "note_id", 0.2, seed)
    elif kind == "stratified":
        s = sa.split_stratified(data, "note_id", "y", 0.2, seed)
    else:
        s = sa.split_three_way(data, "note_id", "y", 0.2, 0.5, seed)
    if rs == "smote_train":
        tr = s.where(F.col("split") == "train").drop("split")
        bal = smote_balance(tr, "note_id", "embedding", "y", minority=1, seed=seed).drop("synthetic", "source_id", "copy")
        s = bal.withColumn("split", F.lit("train")).unionByName(
            s.where(F.col("split") != "train").withColumn("embedding", F.col("embedding").cast("array<double>")))
    elif rs == "undersample_train":
        s = sa.undersample_majority(s, "note_id", "y", seed=seed + 1, split_col="split")
    path = scratch_path(s.sparkSession, "prepared")
    s.write.partitionBy("split").parquet(path)  # a reader of one split opens that folder alone
    return s.sparkSession.read.parquet(path)


def table_key(recipe: dict, learner: str) -> tuple:
    """Recipes with the same key have the same prepared rows."""
    return recipe.get(f"{learner}_split", recipe["split"]), recipe.get("resample")


def params_of(recipe: dict, learner: str, pos_weight: float):
    """The learner's settings; positives weigh negatives / positives of the training rows where the recipe says so."""
    weight = pos_weight if recipe["weight"] else 1.0
    if learner == "mlp":
        return network.Params(**recipe["mlp"], pos_weight=weight)
    return boosting.Params(**recipe[learner], bins=BINS, pos_weight=weight)


def pos_weights(tables: dict) -> dict:
    """Negatives / positives of the training rows of each prepared table, in one job."""
    each = [t.where(F.col("split") == "train").select(F.lit(i).alias("i"), "y") for i, t in enumerate(tables.values())]
    sums = reduce(DataFrame.unionByName, each).groupBy("i").agg(F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos"))
    got = {r["i"]: r["neg"] / max(r["pos"], 1) for r in sums.collect()}  # one row a table
    return {k: got.get(i, 1.0) for i, k in enumerate(tables)}


def fit_all(cells: dict, tables: dict, weights: dict, state: str | None = None) -> dict:
    """The model of each cell; ``cells``: name -> (table key, recipe, learner). All cells of a kind share their jobs."""
    models = {}
    for kind in (boosting, network):
        mine = {c: v for c, v in cells.items() if (v[2] == "mlp") == (kind is network)}
        if not mine:
            continue
        params = {c: params_of(recipe, learner, weights[t]) for c, (t, recipe, learner) in mine.items()}
        rows, first, sets = [], {}, {}
        for c, (t, recipe, _) in mine.items():
            held = recipe["early_stop_on"] if getattr(params[c], "patience", None) is not None else None
            sets[c] = first.setdefault((t, held), c) if kind is boosting else c  # boosted cells of the same rows share them
            if sets[c] == c:
                rows.append(boosting.as_rows(tables[t].where(F.col("split") == "train"), c, 0, "embedding"))
                if held is not None:
                    rows.append(boosting.as_rows(tables[t].where(F.col("split") == held), c, 1, "embedding"))
        rows = reduce(DataFrame.unionByName, rows)
        models |= kind.fit_cells(rows, params, state, sets=sets) if kind is boosting else kind.fit_cells(rows, params)
    return models


def fit(prepared: DataFrame, recipe: dict, learner: str, n_features: int | None = None):
    """Fit the recipe's learner on the training split."""
    tables = {0: prepared}
    return fit_all({"one": (0, recipe, learner)}, tables, pos_weights(tables))["one"]


def predict(model, df: DataFrame, features: str = "embedding", out_col: str = "score") -> DataFrame:
    """``df`` with the probability of class 1, of either kind of model."""
    kind = boosting if isinstance(model, boosting.Boosted) else network
    return kind.predict(model, df, features, out_col)


def scored_cells(cells: dict, tables: dict, models: dict, split_of) -> DataFrame:
    """cell, id, y, score of each cell's rows of one split, written once."""
    rows = [boosting.as_rows(tables[t].where(F.col("split") == split_of(recipe)), c, 2, "embedding") for c, (t, recipe, _) in cells.items()]
    return materialize(boosting.predict_cells(models, reduce(DataFrame.unionByName, rows)))


def evaluate_all(cells: dict, tables: dict, models: dict) -> DataFrame:
    """cell, metric, class, value of all cells: one scoring, and one evaluation a threshold policy."""
    def eval_split(recipe):
        return recipe.get("eval_on", "test")
    out = []
    fixed = {c: v for c, v in cells.items() if v[1]["threshold"] != "tuned"}
    same = {c: v for c, v in cells.items() if c not in fixed and v[1]["tune_on"] == eval_split(v[1])}
    other = {c: v for c, v in cells.items() if c not in fixed and c not in same}
    for part, tuned in ((fixed, False), (same, True)):
        if part:
            policy = None if tuned else F.create_map(*[F.lit(x) for c, v in part.items() for x in (c, float(v[1]["threshold"]))])[F.col("cell")]
            out.append(me.evaluate(scored_cells(part, tables, models, eval_split), policy, group_cols=["cell"]))
    if other:  # the threshold comes from another split
        tuning = scored_cells(other, tables, models, lambda recipe: recipe["tune_on"])
        best = {r["cell"]: float(r["threshold"]) for r in me.best_threshold(me.pr_curve(tuning, group_cols=["cell"]), ["cell"]).collect()}
        policy = F.create_map(*[F.lit(x) for c in other for x in (c, best.get(c, 0.5))])[F.col("cell")]  # one number a cell
        out.append(me.evaluate(scored_cells(other, tables, models, eval_split), policy, group_cols=["cell"]))
    return reduce(DataFrame.unionByName, out)


def _long(metrics: DataFrame) -> DataFrame:
    part = F.split("cell", "\\|", 3)
    return metrics.select(part[0].alias("gen"), part[1].alias("learner"), part[2].alias("encoder"), "metric", "class", "value")


def run_recipe(data: DataFrame, gen: str, learner: str, encoder: str, n_features: int | None = None,
               seed: int = 42, prepared: DataFrame | None = None, group_col: str | None = None) -> DataFrame:
    """Long metrics table (gen, learner, encoder, metric, class, value)."""
    recipe = RECIPES[gen]
    tables = {0: prepare(data, recipe, seed, learner, group_col) if prepared is None else prepared}
    cells = {f"{gen}|{learner}|{encoder}": (0, recipe, learner)}
    return _long(evaluate_all(cells, tables, fit_all(cells, tables, pos_weights(tables))))


def experiment_grid(encoders: dict[str, tuple[DataFrame, int]], gens=("v1", "v2", "v3", "v4", "v5"),
                    learners=("gbt", "xgb", "mlp"), parallel: int = 4, group_col: str | None = None,
                    state: str | None = None) -> DataFrame:
    """Every (encoder, generation, learner) cell as one long metrics table.

    ``encoders``: name -> (rows with note_id, y, embedding; width). Cells that split and
    resample alike share their prepared rows, and up to ``parallel`` tables are prepared at
    once (a driver thread each; the scheduler shares the executors). All boosted cells are
    fitted in the same jobs, and all networks in the same jobs. ``state``: a shared folder from
    which an interrupted run of the boosted cells goes on."""
    from concurrent.futures import ThreadPoolExecutor

    encoders = {e: (materialize(data), width) for e, (data, width) in encoders.items()}  # every table reads them again, some often
    cells, wanted = {}, {}
    for e in encoders:
        for g in gens:
            for lr in learners:
                key = (e, *table_key(RECIPES[g], lr))
                cells[f"{g}|{lr}|{e}"] = key, RECIPES[g], lr
                wanted.setdefault(key, (RECIPES[g], lr))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        tables = dict(zip(wanted, pool.map(lambda k: prepare(encoders[k[0]][0], wanted[k][0], 42, wanted[k][1], group_col), wanted)))
    return _long(evaluate_all(cells, tables, fit_all(cells, tables, pos_weights(tables), state)))


def notes_to_metrics(notes: DataFrame, keywords, prevalence: float, gen: str = "v2", learner: str = "mlp",
                     dim: int = 64, side_cols=(), seed: int = 42) -> DataFrame:
    """The whole path: notes -> labelled cohort -> cleaned text -> vectors -> aligned by note with the
    labels, fused with ``side_cols`` -> split by subject -> fitted -> metrics.

    ``notes``: subject_id, note_id (unique over all notes), text and the side columns."""
    cohort = materialize(case_control_cohort(notes, keywords, prevalence, seed))
    vectors = hashed_tfidf(cohort, dim=dim)
    labelled = align_embeddings(vectors, cohort.select("note_id", "subject_id", F.col("y").cast("int").alias("y"), *side_cols))
    fused = fuse_features(labelled, "embedding", side_cols, "fused").select(
        "note_id", "subject_id", "y", F.col("fused").alias("embedding"))
    return run_recipe(fused, gen, learner, "hashed_tfidf", dim + len(side_cols), seed, group_col="subject_id")
