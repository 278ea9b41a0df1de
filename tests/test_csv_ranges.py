"""Multi-line CSV read in byte ranges: equal to Spark's one-task reader and to Python's csv module."""

import csv
import random

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from notewise.sources import csv_ranges, io
from notewise.sources.tables import document_notes

SIZE_KEYS = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def split_size(spark):
    old = {k: spark.conf.get(k, None) for k in SIZE_KEYS}

    def set_to(size):
        for k, v in SIZE_KEYS.items():
            spark.conf.set(k, v or str(size))
    yield set_to
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(path, rows, rnd, end="\n", header=("ID", "TE\nXT", "C")):
    """Quotes where a field needs them, and now and then where it doesn't."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        for r in [header, *rows]:
            f.write(",".join('"' + x.replace('"', '""') + '"' if set(x) & set('",\n\r') or x and rnd.random() < 0.5 else x for x in r) + end)


def some_rows(rnd, n, letters='ab",\n é中 '):
    return [(str(i), *("".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(2))) for i in range(n)]


@pytest.mark.parametrize("size", [23, 64, 101, 700, 1 << 20])
def test_any_split_size_gives_the_multi_line_reader_s_rows(spark, split_size, tmp_path, size):
    """Small splits put a border into every kind of place: in fields, between doubled quotes, in line ends,
    and into records that span several splits."""
    rnd = random.Random(size)
    n = 25 if size < 50 else 90
    write(tmp_path / "a.csv", some_rows(rnd, n), rnd)
    write(tmp_path / "b.csv", some_rows(rnd, n) + [("9999", "one field " * 40 + '"\n"' * 30, "")], rnd)
    want = sorted(map(repr, spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)).collect()))
    split_size(size)
    lines = csv_ranges.lines_of(spark, str(tmp_path))
    if size < 1 << 20:
        assert lines.select("file", "start").distinct().count() > 4
    assert sorted(map(repr, csv_ranges.read_csv(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_carriage_returns(spark, split_size, tmp_path, size):
    """Lines that end in CR LF, with CR and LF inside fields, by Python's csv module."""
    rnd = random.Random(2)
    write(tmp_path / "a.csv", some_rows(rnd, 40, 'a",\r\n x'), rnd, "\r\n", ("ID", "B", "C"))
    with open(tmp_path / "a.csv", newline="", encoding="utf-8") as f:
        want = [tuple(r) for r in csv.reader(f)][1:]
    split_size(size)
    got = csv_ranges.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["ID", "B", "C"]
    assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(want)


def test_one_file_many_tasks_without_a_shuffle_of_the_text(spark, split_size, tmp_path):
    docs = document_notes(spark, SF001)
    io.write_notes_csv(docs.coalesce(1), str(tmp_path / "notes"))
    split_size(64 * 1024)
    got = io.scan_notes_csv(spark, str(tmp_path / "notes"))
    assert csv_ranges.lines_of(spark, str(tmp_path / "notes")).rdd.getNumPartitions() >= 8
    assert got.exceptAll(docs.select("subject_id", "note_id", "text")).count() == 0 and got.count() == docs.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange hash" not in plan and "Exchange range" not in plan


def test_empty_lines_unpaired_quotes_and_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n\n1,"x\n\ny"\n\n2,z')
    assert sorted(tuple(r) for r in csv_ranges.read_csv(spark, str(tmp_path / "a.csv")).collect()) == [("1", "x\n\ny"), ("2", "z")]
    (tmp_path / "b.csv").write_text('A,B\n1,"x\n')
    with pytest.raises(ValueError, match="pairs"):
        csv_ranges.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("A,B\n")
    assert csv_ranges.read_csv(spark, str(tmp_path / "c.csv")).count() == 0


def test_a_repeated_run_of_metrics_replaces_itself(spark, tmp_path):
    rows = [("v1", "gbt", "e", "accuracy", "all", 0.5), ("v2", "gbt", "e", "accuracy", "all", 0.6)]
    m = spark.createDataFrame(rows, io.METRICS_SCHEMA)
    path = str(tmp_path / "metrics")
    io.write_metrics(m, path, run_id="one")
    io.write_metrics(m.withColumn("value", F.lit(0.9)), path, run_id="two")
    back = io.write_metrics(m.withColumn("value", F.col("value") + 0.1), path, run_id="one")
    got = sorted((r.run, r.gen, round(r.value, 6)) for r in back.collect())
    assert got == [("one", "v1", 0.6), ("one", "v2", 0.7), ("two", "v1", 0.9), ("two", "v2", 0.9)]
