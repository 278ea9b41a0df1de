"""The cohort stream against the batch matches; what a batch reads; restarts and the stop."""

import os

from conftest import SF01
from pyspark.sql import functions as F

from notewise.operators.cohort import cohort_match_bounded
from notewise.sources.tables import event_rows, table
from notewise.streaming import cohort_stream as cs


def in_files(spark, folder, size):
    """events in files of ``size`` rows, in order."""
    e = table(spark, SF01, "events").toPandas().sort_values("event_id")
    os.makedirs(folder)
    for i in range(0, len(e), size):
        path = f"{folder}/part-{i // size:05d}.parquet"
        e.iloc[i:i + size].astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return table(spark, SF01, "events").schema


def run(spark, folder, schema, out, ckpt, **kw):
    q, _ = cs.stream_cohort(spark, folder, schema, ["PURCH"], "event_type", "user_id", out_path=out, checkpoint=ckpt, **kw)
    q.awaitTermination()
    return q


def test_many_batches_equal_the_batch_match_and_read_no_earlier_output(spark, tmp_path):
    schema = in_files(spark, str(tmp_path / "in"), 2500)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    opened = []
    real = spark.read.__class__.parquet

    def noted(self, *paths, **kw):
        opened.extend(paths)
        return real(self, *paths, **kw)
    spark.read.__class__.parquet = noted
    try:
        run(spark, str(tmp_path / "in"), schema, out, ckpt)
    finally:
        spark.read.__class__.parquet = real
    batches = [p for p in opened if "/batch=" in p]
    assert len(batches) == len(set(batches)) >= 4  # each batch's own folder once
    assert all("/_ledger/" in p for p in opened if "/batch=" not in p)
    want = {r.user_id for r in table(spark, SF01, "events").where("event_type rlike '(?i)purch'").select("user_id").distinct().collect()}
    rows = cs.cohort_so_far(spark, out).collect()
    assert sorted(r.subject_id for r in rows) == sorted(want)
    for b in {r.batch for r in rows}:
        mine = [r for r in rows if r.batch == b]
        assert {r.new_subjects for r in mine} == {len(mine)}
        assert {r.running_total for r in mine} == {sum(r.batch <= b for r in rows)}
    # files that come later: only unseen subjects, nothing twice
    late = spark.createDataFrame([(10 ** 6, next(iter(want)), "purchase"), (10 ** 6 + 1, 999_999, "purchase")],
                                 "event_id long, user_id long, event_type string")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, str(tmp_path / "in"), schema, out, ckpt)
    got = [r.subject_id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want | {999_999})


def test_the_stop_equals_the_bounded_match(spark, tmp_path):
    schema = in_files(spark, str(tmp_path / "in"), 100)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run(spark, str(tmp_path / "in"), schema, out, ckpt, stop_at=60)
    bounded = cohort_match_bounded(event_rows(spark, SF01), F.lower("event_type").contains("purch"), 100, 60)
    want = sorted(r.subject_id for r in bounded.collect())
    assert sorted(r.subject_id for r in spark.read.parquet(out).collect()) == want and len(want) >= 60
    run(spark, str(tmp_path / "in"), schema, out, ckpt, stop_at=60)  # a restart after the end adds nothing
    assert sorted(r.subject_id for r in spark.read.parquet(out).collect()) == want


def test_a_retried_batch_replaces_its_output(spark, tmp_path):
    """The driver is lost after the output of a batch and before its commit."""
    schema = in_files(spark, str(tmp_path / "in"), 2500)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run(spark, str(tmp_path / "in"), schema, out, ckpt)
    before = sorted(r.subject_id for r in spark.read.parquet(out).collect())
    total = cs.cohort_so_far(spark, out).agg(F.max("running_total")).first()[0]
    last = max(int(x) for x in os.listdir(f"{ckpt}/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")
    run(spark, str(tmp_path / "in"), schema, out, ckpt)
    assert sorted(r.subject_id for r in spark.read.parquet(out).collect()) == before
    assert cs.cohort_so_far(spark, out).agg(F.max("running_total")).first()[0] == total
