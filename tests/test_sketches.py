"""Sketches of distinct subjects: union of batches, error bounds, set differences; exact quartiles by brackets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.operators import profile as pr
from notewise.operators import sketches as sk


def test_union_of_batches_equals_a_sketch_of_the_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    whole = spark.range(120_000).select((F.col("id") * 7919 % 40_000).alias("subject_id"), (F.col("id") % 3).alias("site"))
    hot = whole.withColumn("subject_id", F.when(F.rand(1) < 0.33, F.lit(5)).otherwise(F.col("subject_id")))
    for i in range(4):
        table = sk.land_sketch(hot.where(F.col("subject_id") % 4 == i), f"b{i}", path, group_cols=["site"])
    table = sk.land_sketch(hot.where(F.col("subject_id") % 4 == 2), "b2", path, group_cols=["site"])  # landed twice
    assert table.count() == 12 and table.agg(F.sum("n_rows")).first()[0] == 120_000
    one = sk.sketch_batch(hot, "all")
    total = sk.count_subjects(table).first()
    assert total.n_subjects == sk.count_subjects(one).first().n_subjects  # the same registers
    exact = hot.select("subject_id").distinct().count()
    assert abs(total.n_subjects - exact) < 0.04 * exact
    by = {r.site: r.n_subjects for r in sk.count_subjects(table, ["site"]).collect()}
    want = {r.site: r.n for r in hot.groupBy("site").agg(F.count_distinct("subject_id").alias("n")).collect()}
    assert by.keys() == want.keys() and all(abs(by[k] - want[k]) < 0.04 * want[k] for k in want)


def test_intersections_and_differences(spark):
    a = sk.sketch_batch(spark.range(0, 30_000).withColumnRenamed("id", "subject_id"), "a")
    b = sk.sketch_batch(spark.range(20_000, 60_000).withColumnRenamed("id", "subject_id"), "b")
    r = sk.compare_subjects(a, b).first()
    for got, want in zip(r, (60_000, 10_000, 20_000, 30_000)):
        assert abs(got - want) < 0.04 * 60_000
    small = spark.createDataFrame([(1,), (2,), (2,), (None,)], "subject_id long")
    other = spark.createDataFrame([(2,), (9,)], "subject_id long")
    assert tuple(sk.compare_subjects(sk.sketch_batch(small, "x"), sk.sketch_batch(other, "y")).first()) == (3, 1, 1, 1)
    assert sk.count_subjects(sk.sketch_batch(small, "x")).first().n_subjects == 2


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "one", "skewed"])
def test_quartiles_are_exact(spark, kind):
    rng = np.random.default_rng(4)
    x = {"spread": rng.standard_normal(60_001), "ties": rng.integers(0, 7, 50_000).astype(float), "few": np.array([3.0, 1.0, 2.0, 8.0]),
         "one": np.array([2.5]), "skewed": np.concatenate([np.zeros(40_000), rng.random(20_000) ** 9])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(7)
    r = pr.describe_numeric(df, "x").first()
    assert r["count"] == len(x) and np.allclose([r.p25, r.p50, r.p75], np.quantile(x, [0.25, 0.5, 0.75]), atol=0, rtol=1e-15)
    assert np.isclose(r["mean"], x.mean()) and r["min"] == x.min() and r["max"] == x.max()
    assert r["std"] is None if len(x) == 1 else np.isclose(r["std"], x.std(ddof=1))


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    """With a sketch of 8 values the first brackets miss."""
    monkeypatch.setattr(pr, "SKETCH_K", 8)
    monkeypatch.setattr(pr, "BRACKET", 0.0001)
    tries = []
    real = pr._at_ranks
    monkeypatch.setattr(pr, "_at_ranks", lambda *a: tries.append(real(*a)) or tries[-1])
    x = np.random.default_rng(5).random(20_000)
    r = pr.describe_numeric(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert np.allclose([r.p25, r.p50, r.p75], np.quantile(x, [0.25, 0.5, 0.75]), atol=0, rtol=1e-15)
    assert len(tries) > 1 and tries[0] is None
