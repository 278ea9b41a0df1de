"""Queries for splits, resampling and SMOTE.

Fixture: ``embeddings`` with unit ``vec_id`` and ``y = (label = 0)`` (the
minority class); ``conversations`` for the group split (group = conv_id).
"""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from notewise.functions.numeric import array_sum, interpolate_vector, vector_distance
from notewise.operators import profile as pr
from notewise.operators import sampling as sa
from notewise.operators import smote as sm
from notewise.plans.catalog import query
from notewise.plans.sqlbits import hash_sql
from notewise.sources.tables import conversation_notes, table

SEED = 42
UNDER_SEED = 7

EMB_Y = "SELECT vec_id AS note_id, CAST(label = 0 AS INTEGER) AS y FROM embeddings"


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("note_id"), (F.col("label") == 0).cast("int").alias("y"),
                    "embedding")


def _ranked_sql(src: str, unit: str, part: str, seed=SEED) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return (f"SELECT *, row_number() OVER ({over}ORDER BY {hash_sql(seed, unit)}, {unit}) AS rn, "
            f"COUNT(*) OVER ({over.strip()}) AS n FROM ({src})")


STRAT_SQL = (f"SELECT note_id, y, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split "
             f"FROM ({_ranked_sql(EMB_Y, 'note_id', 'y')})")
THREE_SQL = (f"SELECT note_id, y, CASE WHEN rn <= round(round(n * 0.2) * 0.5) THEN 'val' "
             f"WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split "
             f"FROM ({_ranked_sql(EMB_Y, 'note_id', 'y')})")


@query("split_random",
       f"SELECT note_id, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split "
       f"FROM ({_ranked_sql(EMB_Y, 'note_id', '')})")
def q_split_random(spark, sf):
    """80/20 unstratified, exact sizes, seeded by the row key."""
    return sa.split_random(_emb(spark, sf).select("note_id"), "note_id", 0.2, SEED)


@query("split_stratified", STRAT_SQL)
def q_split_stratified(spark, sf):
    """80/20 per class with exact per-class counts."""
    return sa.split_stratified(_emb(spark, sf).select("note_id", "y"), "note_id", "y", 0.2, SEED)


@query("split_three_way", THREE_SQL)
def q_split_three_way(spark, sf):
    """80/10/10 train/val/test by two stratified cuts."""
    return sa.split_three_way(_emb(spark, sf).select("note_id", "y"), "note_id", "y", 0.2, 0.5, SEED)


@query("split_by_group",
       f"WITH g AS ({_ranked_sql('SELECT DISTINCT conv_id FROM conversations', 'conv_id', '')}) "
       f"SELECT c.conv_id AS subject_id, c.turn AS note_id, "
       f"CASE WHEN g.rn <= round(g.n * 0.2) THEN 'test' ELSE 'train' END AS split "
       f"FROM conversations c JOIN g ON c.conv_id = g.conv_id")
def q_split_by_group(spark, sf):
    """All notes of a subject on one side of an 80/20 subject split."""
    notes = conversation_notes(spark, sf).select("subject_id", "note_id")
    return sa.split_by_group(notes, "subject_id", 0.2, SEED)


@query("undersample_majority",
       f"WITH s AS ({THREE_SQL}), tr AS (SELECT * FROM s WHERE split = 'train'), "
       f"r AS ({_ranked_sql('SELECT * FROM tr', 'note_id', 'y', UNDER_SEED)}), "
       f"mn AS (SELECT MIN(n) AS k FROM r) "
       f"SELECT note_id, y, split FROM r, mn WHERE rn <= k "
       f"UNION ALL SELECT note_id, y, split FROM s WHERE split <> 'train'")
def q_undersample(spark, sf):
    """Train split cut to equal classes; val and test untouched."""
    s = sa.split_three_way(_emb(spark, sf).select("note_id", "y"), "note_id", "y", 0.2, 0.5, SEED)
    return sa.undersample_majority(s, "note_id", "y", seed=UNDER_SEED, split_col="split")


@query("class_balance",
       f"SELECT CAST(SUM(1 - y) AS BIGINT) AS negatives, CAST(SUM(y) AS BIGINT) AS positives, "
       f"round(SUM(1 - y) / SUM(y), 6) AS pos_weight FROM ({STRAT_SQL}) WHERE split = 'train'")
def q_class_balance(spark, sf):
    """Negatives / positives of the training split (the positive weight)."""
    s = sa.split_stratified(_emb(spark, sf).select("note_id", "y"), "note_id", "y", 0.2, SEED)
    out = pr.class_balance(s.where(F.col("split") == "train"), "y")
    return out.withColumn("pos_weight", F.round("pos_weight", 6))


@query("class_weight_column",
       f"WITH s AS ({STRAT_SQL}), w AS (SELECT SUM(1 - y) / SUM(y) AS pw FROM s WHERE split = 'train') "
       f"SELECT note_id, y, round(CASE WHEN y = 1 THEN pw ELSE 1.0 END, 6) AS weight FROM s, w "
       f"WHERE split = 'train'")
def q_class_weight_column(spark, sf):
    """Row weights for training: positives weighted by negatives / positives."""
    from notewise.operators.features import class_weight_column
    s = sa.split_stratified(_emb(spark, sf).select("note_id", "y"), "note_id", "y", 0.2, SEED)
    tr = s.where(F.col("split") == "train")
    out = class_weight_column(tr, "y")
    return out.select("note_id", "y", F.round("weight", 6).alias("weight"))


MINO_SQL = "SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0"
KNN_SQL = (f"WITH m AS ({MINO_SQL}), nb AS (SELECT a.i, b.i AS j, list_distance(a.e, b.e) AS distance, "
           f"row_number() OVER (PARTITION BY a.i ORDER BY round(list_distance(a.e, b.e), 9), b.i) AS r "
           f"FROM m a JOIN m b ON a.i <> b.i), knn AS (SELECT * FROM nb WHERE r <= 5)")


@query("smote_neighbors", f"{KNN_SQL} SELECT i, j, CAST(r AS INTEGER) AS r, round(distance, 6) AS distance FROM knn")
def q_smote_neighbors(spark, sf):
    """Exact 5 nearest minority neighbours of each minority row."""
    mino = _emb(spark, sf).where(F.col("y") == 1)
    nb = sm.smote_neighbors(mino, "note_id", "embedding", k=5)
    return nb.select("i", "j", "r", F.round("distance", 6).alias("distance"))


@query("vector_distance",
       "WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, "
       "generate_subscripts(embedding, 1) AS d FROM embeddings), "
       "c AS (SELECT d, AVG(v) AS m FROM u GROUP BY d) "
       "SELECT vec_id AS note_id, round(sqrt(SUM((v - m) * (v - m))), 6) AS distance FROM u JOIN c USING (d) "
       "GROUP BY vec_id")
def q_vector_distance(spark, sf):
    """Euclidean distance of every vector to the centroid (mean from a
    distributed Summarizer aggregate, used as a scalar subquery)."""
    e = _emb(spark, sf)
    centroid = (e.select(Summarizer.mean(array_to_vector("embedding")).alias("m"))
                 .select(vector_to_array("m").alias("c")).select("c").scalar())
    # Project the centroid first: subqueries may not sit inside lambdas.
    e = e.select("note_id", "embedding", centroid.alias("c"))
    return e.select("note_id", F.round(vector_distance("embedding", "c"), 6).alias("distance"))


@query("interpolate_vector",
       f"{KNN_SQL} SELECT a.i, k.j, round(list_sum(list_transform(range(1, len(a.e) + 1), "
       f"lambda t: a.e[t] + 0.5 * (b.e[t] - a.e[t]))), 6) AS total "
       f"FROM knn k JOIN m a ON k.i = a.i JOIN m b ON k.j = b.i WHERE k.r = 1")
def q_interpolate_vector(spark, sf):
    """Midpoint between each minority row and its nearest neighbour."""
    mino = _emb(spark, sf).where(F.col("y") == 1)
    nb = sm.smote_neighbors(mino, "note_id", "embedding", k=5).where(F.col("r") == 1)
    x = mino.select(F.col("note_id").alias("i"), F.col("embedding").alias("x"))
    n = mino.select(F.col("note_id").alias("j"), F.col("embedding").alias("n"))
    mid = nb.join(x, "i").join(n, "j").select("i", "j", interpolate_vector("x", "n", 0.5).alias("v"))
    return mid.select("i", "j", F.round(array_sum("v"), 6).alias("total"))


@query("smote_oversample", f"""{KNN_SQL},
  cnt AS (SELECT (SELECT COUNT(*) FROM embeddings WHERE label <> 0) AS nmaj, (SELECT COUNT(*) FROM m) AS nmin),
  par AS (SELECT i, row_number() OVER (ORDER BY {hash_sql('42:extra', 'i')}, i) AS rn FROM m),
  cp AS (SELECT par.i, CAST(floor(greatest(nmaj - nmin, 0) / nmin) AS BIGINT)
                 + CASE WHEN rn <= greatest(nmaj - nmin, 0) - floor(greatest(nmaj - nmin, 0) / nmin) * nmin
                        THEN 1 ELSE 0 END AS copies FROM par, cnt),
  syn AS (SELECT i, unnest(range(1, copies + 1)) AS copy FROM cp WHERE copies > 0),
  pick AS (SELECT syn.i, syn.copy, 1 + ({hash_sql(42, 'syn.i', 'syn.copy', "'nn'")} % least(5, nmin - 1)) AS r,
                  {hash_sql(42, 'syn.i', 'syn.copy', "'u'")} / 4294967296.0 AS u FROM syn, cnt)
SELECT p.i, CAST(p.copy AS INTEGER) AS copy, k.j, round(p.u, 6) AS u,
       round(list_sum(list_transform(range(1, len(a.e) + 1), lambda t: a.e[t] + p.u * (b.e[t] - a.e[t]))), 6) AS total,
       round(a.e[1] + p.u * (b.e[1] - a.e[1]), 6) AS first
FROM pick p JOIN knn k ON k.i = p.i AND k.r = p.r JOIN m a ON a.i = p.i JOIN m b ON b.i = k.j""")
def q_smote_oversample(spark, sf):
    """Synthetic minority rows up to the majority size, on neighbour segments."""
    syn = sm.smote_oversample(_emb(spark, sf), "note_id", "embedding", "y", minority=1, k=5, seed=SEED)
    return syn.select("i", F.col("copy").cast("int").alias("copy"), "j", F.round("u", 6).alias("u"),
                      F.round(array_sum("embedding"), 6).alias("total"),
                      F.round(F.col("embedding")[0], 6).alias("first"))
