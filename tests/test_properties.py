"""Properties of the operators, checked against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from notewise.functions import text as tx
from notewise.functions.numeric import hash_unit
from notewise.operators import cohort as co
from notewise.operators import metrics as me
from notewise.operators import models as mo
from notewise.operators import profile as pr
from notewise.operators import sampling as sa
from notewise.operators import smote as sm
from notewise.operators.ranking import running_totals
from notewise.sources import io
from notewise.sources.tables import conversation_notes, table


def _emb(spark):
    e = table(spark, SF01, "embeddings")
    return e.select(F.col("vec_id").alias("note_id"), (F.col("label") == 0).cast("int").alias("y"), "embedding")


# --- text edge cases (no null / empty text exists in the fixtures) ----------

def test_text_nulls_and_empties(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  12 ab-CD  "), (4, "İstanbul 3x")], "id int, t string")
    out = {r["id"]: r for r in df.select(
        "id", tx.clean_text("t").alias("c"), tx.word_length(tx.clean_text("t")).alias("n"),
        tx.cast_text("t").alias("s"), tx.contains_any("t", ["AB"]).alias("k")).collect()}
    assert out[1]["c"] is None and out[1]["n"] == 0 and out[1]["s"] == "nan" and out[1]["k"] is False
    assert out[2]["c"] == "" and out[2]["n"] == 0
    assert out[3]["c"] == "ab cd" and out[3]["n"] == 2 and out[3]["k"] is True
    assert out[4]["c"] == "i stanbul x" or out[4]["c"] == "istanbul x"


def test_keyword_quoting_and_whole_word(spark):
    df = spark.createDataFrame([(1, "a+b here"), (2, "smash"), (3, "MASH x")], "id int, t string")
    got = sorted(r.id for r in df.where(tx.contains_any("t", ["a+b"])).collect())
    assert got == [1]
    sub = sorted(r.id for r in df.where(tx.contains_any("t", ["mash"])).collect())
    whole = sorted(r.id for r in df.where(tx.contains_any("t", ["mash"], whole_word=True)).collect())
    assert sub == [2, 3] and whole == [3]


# --- running totals vs brute force -------------------------------------------

@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_brute_force(spark, descending):
    rnd = random.Random(3)
    rows = [(g, float(rnd.randint(0, 40)) / 4, rnd.randint(0, 5)) for g in range(3) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, k double, v long").groupBy("g", "k").agg(F.sum("v").alias("v"))
    got = {(r.g, r.k): r.cum_v for r in running_totals(df, "k", ["v"], ["g"], descending, n_buckets=7).collect()}
    agg = {}
    for g, k, v in rows:
        agg[(g, k)] = agg.get((g, k), 0) + v
    for (g, k), _ in agg.items():
        want = sum(v for (g2, k2), v in agg.items() if g2 == g and (k2 >= k if descending else k2 <= k))
        assert got[(g, k)] == want


def test_running_totals_constant_key(spark):
    df = spark.createDataFrame([(1.0, 2), (1.0, 3)], "k double, v long").groupBy("k").agg(F.sum("v").alias("v"))
    assert [r.cum_v for r in running_totals(df, "k", ["v"]).collect()] == [5]


# --- exact-k sampling -------------------------------------------------------

def _brute_sample(ids, k, seed=42):
    import hashlib
    h = {i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in ids}
    return set(sorted(ids, key=lambda i: (h[i], i))[:k])


@pytest.mark.parametrize("k", [0, 1, 37, 499, 500, 900])
def test_exact_sample_brute_force(spark, k):
    df = spark.range(500).withColumnRenamed("id", "u")
    got = {r.u for r in sa.exact_sample(df, "u", k).collect()}
    assert got == _brute_sample(range(500), min(k, 500))


def test_hash_unit_matches_python(spark):
    import hashlib
    row = spark.range(3).select(hash_unit(42, F.col("id")).alias("h")).collect()
    assert [r.h for r in row] == [int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) for i in range(3)]


def test_splits_are_partition_independent(spark):
    a = _emb(spark).select("note_id", "y").repartition(1)
    b = _emb(spark).select("note_id", "y").repartition(7, "note_id")
    sa_ = {tuple(r) for r in sa.split_three_way(a, "note_id", "y").collect()}
    sb_ = {tuple(r) for r in sa.split_three_way(b, "note_id", "y").collect()}
    assert sa_ == sb_


def test_stratified_split_counts(spark):
    s = sa.split_stratified(_emb(spark).select("note_id", "y"), "note_id", "y", 0.2)
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    n0, n1 = c[(0, "train")] + c[(0, "test")], c[(1, "train")] + c[(1, "test")]
    assert c[(0, "test")] == round(0.2 * n0) and c[(1, "test")] == round(0.2 * n1)
    assert s.count() == 500 and s.select("note_id").distinct().count() == 500


def test_undersample_balances_train_only(spark):
    s = sa.split_three_way(_emb(spark).select("note_id", "y"), "note_id", "y")
    u = sa.undersample_majority(s, "note_id", "y", seed=7)
    c = {(r.y, r.split): r["count"] for r in u.groupBy("y", "split").count().collect()}
    before = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(0, "train")] == c[(1, "train")] == min(before[(0, "train")], before[(1, "train")])
    for k in before:
        if k[1] != "train":
            assert c[k] == before[k]


def test_group_split_keeps_subjects_together(spark):
    notes = conversation_notes(spark, SF01).select("subject_id", "note_id")
    s = sa.split_by_group(notes, "subject_id")
    assert s.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


# --- cohort -----------------------------------------------------------------

def test_cohort_disjoint_and_sized(spark):
    notes = conversation_notes(spark, SF01)
    flags = co.subject_flags(notes, ["edtion", "hation"])
    coh = co.cohort_subjects(flags, 0.6)
    size = co.cohort_size_table(flags, 0.6).first()
    ys = {r.y: r["count"] for r in coh.groupBy("y").count().collect()}
    assert ys[1] == size.n_matched and ys[0] == size.neg_taken
    assert coh.select("subject_id").distinct().count() == coh.count()


def test_bounded_cohort_equals_chunk_loop(spark):
    ev = table(spark, SF01, "events").select("event_id", "user_id", "event_type").orderBy("event_id").collect()
    seen, chunk, k = set(), 100, 60
    for start in range(0, len(ev), chunk):
        for r in ev[start:start + chunk]:
            if "purch" in r.event_type.lower():
                seen.add(r.user_id)
        if len(seen) >= k:
            break
    rows = table(spark, SF01, "events").select(F.col("user_id").alias("subject_id"),
                                                F.col("event_id").alias("ord"), "event_type")
    got = {r.subject_id for r in co.cohort_match_bounded(rows, tx.contains_any("event_type", ["PURCH"]),
                                                         chunk, k).collect()}
    assert got == seen


# --- metrics ----------------------------------------------------------------

def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_ap_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.3), round(rnd.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "note_id long, y int, score double")
    curve = me.pr_curve(df)
    auc = me.roc_auc(curve).first().roc_auc
    assert math.isclose(auc, _brute_auc([r[1] for r in rows], [r[2] for r in rows]), abs_tol=1e-12)
    flipped = df.withColumn("score", 1 - F.col("score"))
    auc2 = me.roc_auc(me.pr_curve(flipped)).first().roc_auc
    assert math.isclose(auc2, 1 - auc, abs_tol=1e-12)
    # step-wise average precision over descending distinct thresholds
    ths = sorted({r[2] for r in rows}, reverse=True)
    P = sum(r[1] for r in rows)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for r in rows if r[2] >= t and r[1] == 1)
        fp = sum(1 for r in rows if r[2] >= t and r[1] == 0)
        rec = tp / P
        ap += (rec - prev_r) * tp / (tp + fp)
        prev_r = rec
    assert math.isclose(me.average_precision(curve).first().average_precision, ap, abs_tol=1e-12)


def test_best_threshold_ties_go_low(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.5), (3, 1, 0.1)], "note_id long, y int, score double")
    b = me.best_threshold(me.pr_curve(df)).first()
    assert b.threshold == 0.1


# --- SMOTE ------------------------------------------------------------------

def test_smote_neighbors_brute_force_many_blocks(spark):
    e = _emb(spark).where("y = 1")
    got = {(r.i, r.r): r.j for r in sm.smote_neighbors(e, k=5, block_rows=7).collect()}
    rows = e.collect()
    ids = [r.note_id for r in rows]
    vec = np.array([r.embedding for r in rows], dtype=np.float64)
    for a, ia in enumerate(ids):
        d = np.sqrt(((vec - vec[a]) ** 2).sum(axis=1))
        order = sorted((round(d[b], 9), ids[b]) for b in range(len(ids)) if b != a)[:5]
        for r, (_, j) in enumerate(order, 1):
            assert got[(ia, r)] == j


def test_smote_balances_and_stays_on_segments(spark):
    df = _emb(spark)
    bal = sm.smote_balance(df, minority=1)
    c = {r.y: r["count"] for r in bal.groupBy("y").count().collect()}
    assert c[0] == c[1]
    syn = sm.smote_oversample(df, minority=1).collect()
    vec = {r.note_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    for r in syn[:50]:
        x, n, s = vec[r.i], vec[r.j], np.array(r.embedding)
        assert 0 <= r.u < 1
        assert np.allclose(s, x + r.u * (n - x), atol=1e-9)


# --- models -----------------------------------------------------------------

def test_path_attribution_sums_to_margin(spark):
    d = mo.with_features(_emb(spark))
    model = mo.train_gbt(d, max_iter=5, max_depth=3)
    contrib = mo.path_attribution(model, d).collect()
    raw = {r.note_id: float(r.rawPrediction[1]) for r in model.transform(d).collect()}
    for r in contrib[:100]:
        assert math.isclose(r.bias + sum(r.contrib), raw[r.note_id], abs_tol=1e-9)


# --- sources ----------------------------------------------------------------

def test_csv_scan_by_header(spark, tmp_path):
    p = tmp_path / "notes.csv"
    p.write_text('CHARTTIME,TEXT,ROW_ID,ISERROR,SUBJECT_ID\nx,"line one\nline ""two""",1,,10\ny,plain,2,,11\n')
    rows = sorted(io.scan_notes_csv(spark, str(p)).collect())
    assert rows[0].text == 'line one\nline "two"' and rows[1].subject_id == 11 and rows[0].note_id == 1
    (tmp_path / "other.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="TEXT"):
        io.scan_notes_csv(spark, str(tmp_path / "other.csv"))


def test_partitioned_embeddings_prune(spark):
    e = _emb(spark).select("note_id", F.concat(F.lit("enc"), F.col("y").cast("string")).alias("encoder"),
                           "embedding")
    back = io.write_embeddings(e)
    path = back.inputFiles()[0].rsplit("/encoder=", 1)[0]
    one = io.scan_embeddings(spark, path, "enc1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(encoder" in plan
    assert one.count() == e.where("encoder = 'enc1'").count()


@pytest.mark.parametrize("bucketing", ["quantile", "width"])
def test_running_totals_skewed_key(spark, bucketing):
    # 90% of the distinct keys crowd into a tiny range: both bucketings must
    # stay exact; quantile buckets also stay balanced.
    rnd = random.Random(11)
    keys = [rnd.random() * 1e-6 for _ in range(900)] + [rnd.random() for _ in range(100)]
    rows = [(k, 1) for k in keys]
    df = spark.createDataFrame(rows, "k double, v long")
    got = {r.k: r.cum_v for r in running_totals(df, "k", ["v"], descending=True, n_buckets=16,
                                                bucketing=bucketing).collect()}
    srt = sorted(keys, reverse=True)
    for i, k in enumerate(srt):
        assert got[k] == i + 1


def test_land_notes_round_trip(spark, tmp_path):
    notes = conversation_notes(spark, SF01).select("subject_id", "note_id", "text")
    back = io.land_notes(notes, str(tmp_path / "landed"))
    assert back.count() == notes.count()
    assert back.exceptAll(notes).count() == 0


def test_stream_running_count(spark, tmp_path):
    from notewise.streaming.cohort_stream import cohort_so_far, stream_cohort
    schema = table(spark, SF01, "events").schema
    q, out = stream_cohort(spark, SF01, schema, ["PURCH"], "event_type", "user_id",
                           glob="events.parquet", out_path=str(tmp_path / "out"),
                           checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()
    prog = cohort_so_far(spark, out)
    assert prog.select("subject_id").distinct().count() == 150
    assert prog.agg(F.max("running_total")).first()[0] == 150
    # A restart from the same checkpoint finds nothing new and writes nothing twice.
    q2, _ = stream_cohort(spark, SF01, schema, ["PURCH"], "event_type", "user_id",
                          glob="events.parquet", out_path=out, checkpoint=str(tmp_path / "ckpt"))
    q2.awaitTermination()
    assert spark.read.parquet(out).count() == 150


def test_smote_neighbors_with_duplicate_points(spark):
    # Ten identical copies of one point: ties must resolve by id exactly as
    # in the brute-force order, also when the shortlist is smaller than the tie.
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    base[5:15] = base[5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "note_id long, embedding array<double>")
    got = {(r.i, r.r): r.j for r in sm.smote_neighbors(df, k=3, block_rows=16).collect()}
    for a in range(40):
        d = np.sqrt(((base - base[a]) ** 2).sum(axis=1))
        order = sorted((round(d[b], 9), b) for b in range(40) if b != a)[:3]
        for r, (_, j) in enumerate(order, 1):
            assert got[(a, r)] == j


def test_metrics_sink_appends_by_generation(spark, tmp_path):
    rows = [("v1", "gbt", "enc", "roc_auc", "all", 0.5), ("v2", "mlp", "enc", "roc_auc", "all", 0.6)]
    m = spark.createDataFrame(rows, io.METRICS_SCHEMA)
    path = str(tmp_path / "metrics")
    io.write_metrics(m, path)
    back = io.write_metrics(m.where("gen = 'v1'"), path)
    assert back.count() == 3
    assert sorted(r.gen for r in back.select("gen").distinct().collect()) == ["v1", "v2"]
    assert "gen=v1" in " ".join(back.inputFiles())


def test_running_totals_grouped_quantile_buckets(spark):
    rnd = random.Random(13)
    keys = [rnd.random() * 1e-6 for _ in range(600)] + [rnd.random() for _ in range(60)]
    rows = [(i % 3, k, 1) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g int, k double, v long")
    got = {(r.g, r.k): r.cum_v for r in running_totals(df, "k", ["v"], ["g"], descending=True,
                                                       n_buckets=8).collect()}
    for g in range(3):
        ks = sorted((k for gg, k, _ in rows if gg == g), reverse=True)
        for i, k in enumerate(ks):
            assert got[(g, k)] == i + 1


# --- gaps, fractions, nulls -------------------------------------------------

def test_bounded_cohort_counts_rows_not_keys(spark):
    rows = [(i * 1000, i, "hit") for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, subject_id long, kind string")
    got = co.cohort_match_bounded(df, F.col("kind") == "hit", chunk_size=10, k=12)
    assert {r.subject_id: r.first_chunk for r in got.collect()} == {i: i // 10 for i in range(20)}


def test_histogram_of_fractions(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(100)], "x double")
    got = [r["count"] for r in pr.length_histogram(df, "x", 5).orderBy("bin").collect()]
    want = np.histogram([i / 100 for i in range(100)], bins=5)[0].tolist()
    assert sum(got) == 100 and max(abs(a - b) for a, b in zip(got, want)) <= 1


def test_describe_matches_numpy(spark):
    x = [random.Random(3).gauss(0, 5) for _ in range(1)] + [i * 0.37 % 7 for i in range(333)]
    r = pr.describe_numeric(spark.createDataFrame([(v,) for v in x] + [(None,)], "x double"), "x").first()
    assert r["count"] == len(x) and math.isclose(r["std"], np.std(x, ddof=1), rel_tol=1e-9)
    for name, q in (("p25", 25), ("p50", 50), ("p75", 75)):
        assert math.isclose(r[name], np.percentile(x, q), rel_tol=1e-9, abs_tol=1e-12)


def test_null_groups_and_classes_are_kept(spark):
    rows = [(g, s / 10, s % 2) for g in ("a", None) for s in range(10)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    auc = me.roc_auc(me.pr_curve(df, group_cols=["g"]), ["g"])
    assert {r.g for r in auc.collect()} == {"a", None}
    ev = me.evaluate(df, group_cols=["g"])
    assert {r.g for r in ev.select("g").distinct().collect()} == {"a", None}
    classes = spark.createDataFrame([(i, None if i < 50 else 1) for i in range(100)], "note_id long, y int")
    parts = sa.split_stratified(classes, "note_id", "y", 0.2).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in parts} == {
        (None, "test"): 10, (None, "train"): 40, (1, "test"): 10, (1, "train"): 40}


def test_counts_at_the_best_threshold(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(round(rnd.random(), 1), int(rnd.random() < 0.4)) for _ in range(300)], "score double, y int")
    curve = me.pr_curve(df)
    t = me.best_threshold(curve).first().threshold
    got = me.counts_at_best(curve).first().asDict()
    want = me.confusion_matrix(me.classify(df, F.lit(t))).first().asDict()
    assert got == want


def test_undersampling_reads_the_split_once(spark):
    rows = [(i, int(i % 5 == 0), "train" if i < 100 else "val") for i in range(150)]
    df = spark.createDataFrame(rows, "note_id long, y int, split string")
    got = sa.undersample_majority(df, "note_id", "y").groupBy("split", "y").count().collect()
    assert {(r.split, r.y): r["count"] for r in got} == {("train", 0): 20, ("train", 1): 20, ("val", 0): 40, ("val", 1): 10}


def test_smote_edge_cases(spark):
    one = spark.createDataFrame([(1, 1, [0.0, 1.0])] + [(i, 0, [1.0, float(i)]) for i in range(2, 6)],
                                "note_id long, y int, embedding array<double>")
    with pytest.raises(ValueError, match="two minority rows"):
        sm.smote_balance(one, minority=1)
    big = spark.createDataFrame([(10 ** 15 + i, int(i < 2), [float(i), 1.0]) for i in range(8)],
                                "note_id long, y int, embedding array<double>")
    out = sm.smote_balance(big, minority=1).collect()
    assert len({r.note_id for r in out}) == 12 and sum(r.y for r in out) == 6


def test_early_stopping_rule(spark):
    assert mo.best_round([3, 2, 1, 2, 3, 4], 3) == (3, True)
    assert mo.best_round([3, 2, 1, 2], 3) == (3, False)
    assert mo.best_round([1.0], 5) == (1, False)


def test_early_stopping_keeps_the_best_prefix(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        x = [rnd.gauss(0, 1) for _ in range(4)]
        rows.append((i, int(x[0] + x[1] + rnd.gauss(0, 0.5) > 0), x))
    d = mo.with_features(spark.createDataFrame(rows, "note_id long, y int, embedding array<double>")).coalesce(1)
    train, held = d.where("note_id < 300").cache(), d.where("note_id >= 300").cache()
    model = mo.train_gbt_early(train, held, max_iter=60, patience=5, max_depth=3, step_size=0.3)
    assert 1 < model.getNumTrees < 60
    whole = mo.train_gbt(train, max_iter=model.getNumTrees, max_depth=3, step_size=0.3)
    score = lambda m: [r.score for r in mo.predict_score(m, held).orderBy("note_id").collect()]
    assert np.allclose(score(model), score(whole))

    def auc(m):
        return me.roc_auc(me.pr_curve(mo.predict_score(m, held))).first().roc_auc
    assert auc(model) >= auc(mo.first_trees(whole, 1, spark))


def test_null_text_and_named_categories(spark):
    from notewise.operators import features as fe
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "")], "note_id long, text string")
    for encoder in (fe.hashed_tfidf, fe.hashed_vectors):
        got = {r.note_id: r.embedding for r in encoder(docs, dim=16).collect()}
        assert set(got) == {1, 3} and len(got[3]) == 16 and not any(got[3])
    side = spark.createDataFrame([([1.0], 40, "F"), ([1.0], None, "male"), ([1.0], 3, None)],
                                 "embedding array<double>, age int, gender string")
    assert [r.features for r in fe.fuse_features(side).collect()] == [[1.0, 40.0, 0.0], [1.0, 0.0, 1.0], [1.0, 3.0, -1.0]]
