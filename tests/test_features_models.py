"""Encoders, the external-encoder hook and one end-to-end recipe."""

import sys

import numpy as np
from conftest import SF001, SF01
from pyspark import cloudpickle
from pyspark.sql import functions as F

from notewise.functions.text import clean_text
from notewise.operators import features as fe
from notewise.plans import recipes as rc
from notewise.sources.tables import document_notes, table


def _toy_encoder():
    # Stands in for a transformer checkpoint: built once per worker.
    def encode(texts):
        out = np.zeros((len(texts), 8), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, hash(w) % 8] += 1.0
        return out
    return encode


def test_external_encoder_hook(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests/
    docs = document_notes(spark, SF001).select("note_id", clean_text("text").alias("clean_text"))
    enc = fe.ExternalEncoder("toy", _toy_encoder, dim=8, batch_size=16)
    out = enc.apply(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(len(r.embedding) == 8 and r.encoder == "toy" for r in rows)
    assert sum(sum(r.embedding) for r in rows) > 0


def test_hashed_tfidf_is_unit_length(spark):
    out = fe.hashed_tfidf(document_notes(spark, SF001), dim=64)
    norms = [float(np.linalg.norm(np.array(r.embedding))) for r in out.collect()]
    assert all(abs(n - 1.0) < 1e-5 or n == 0.0 for n in norms)


def test_fuse_features_only_when_all_present(spark):
    df = table(spark, SF001, "embeddings").select("vec_id", "embedding", F.lit(1.0).alias("age"))
    assert df.transform(lambda d: fe.fuse_features(d, extra_cols=("age", "gender"))) \
             .select(F.size("features")).first()[0] == 64
    both = df.withColumn("gender", F.lit(0.0))
    assert fe.fuse_features(both, extra_cols=("age", "gender")).select(F.size("features")).first()[0] == 66


def test_recipe_v2_mlp_metrics(spark):
    e = table(spark, SF01, "embeddings")
    data = e.select(F.col("vec_id").alias("note_id"), (F.col("label") == 0).cast("int").alias("y"), "embedding")
    m = rc.run_recipe(data, "v2", "mlp", "fixture", 64).collect()
    got = {(r["class"], r.metric) for r in m}
    assert ("accuracy", "f1-score") in got and ("all", "roc_auc") in got and ("all", "threshold") in got
    thr = [r.value for r in m if r.metric == "threshold"][0]
    assert thr == 0.3
    sup = [r.value for r in m if r["class"] == "accuracy" and r.metric == "support"][0]
    assert sup == 100  # 20% of 500 rows, stratified and exact


def test_grid_cells_are_independent(spark):
    """Two encoders with opposite labels: each cell scores with its own model."""
    e = table(spark, SF01, "embeddings")
    data = e.select(F.col("vec_id").alias("note_id"), F.element_at("embedding", 1).alias("_x"), "embedding")
    a = data.select("note_id", (F.col("_x") > 0).cast("int").alias("y"), "embedding")
    b = a.withColumn("y", 1 - F.col("y"))
    grid = rc.experiment_grid({"a": (a, 64), "b": (b, 64)}, gens=("v2",), learners=("mlp",), parallel=2)
    auc = {r.encoder: r.value for r in grid.where("metric = 'roc_auc'").collect()}
    assert set(auc) == {"a", "b"}
    for name, rows in (("a", a), ("b", b)):
        alone = rc.run_recipe(rows, "v2", "mlp", name, 64).where("metric = 'roc_auc'").first().value
        assert abs(auc[name] - alone) < 1e-6
