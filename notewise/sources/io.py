"""Scans and sinks.

* Raw note CSV is read by its header: the file's columns are strings, in its own
  order, and the three that are needed are cast (no inference pass). Fields may
  hold line breaks; one file is still read by many tasks
  (:mod:`notewise.sources.csv_ranges`). Later steps should read the Parquet copy
  that :func:`land_notes` writes.
* Sinks never overwrite the path they read from: each write goes to a new
  path (under ``spark.checkpoint.dir`` by default) and the reader gets a fresh
  DataFrame over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.session import scratch_path
from notewise.sources import csv_ranges

# Columns of the raw note export that the build reads, by name; all others
# (chart/store times, caregiver, error flag) are dropped.
NOTE_CSV_COLUMNS = {"SUBJECT_ID": "subject_id", "ROW_ID": "note_id", "TEXT": "text"}

METRICS_SCHEMA = T.StructType([
    T.StructField("gen", T.StringType()),
    T.StructField("learner", T.StringType()),
    T.StructField("encoder", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def scan_notes_csv(spark: SparkSession, path: str, multiline: bool = True, parallel: bool = True) -> DataFrame:
    """Raw note CSV -> subject_id, note_id, text.

    The header names the columns, in any order and among any others; only the
    head of a file is read for it. Without ``inferSchema`` every column is a
    string, and the parser's column pruning skips those that aren't selected.

    A file with line breaks in fields is read in byte ranges by quote parity;
    ``parallel=False`` reads it with Spark's multi-line reader, one task a file
    (for files whose quotes don't come in pairs), ``multiline=False`` line by line."""
    reader = (spark.read.option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"'))
    names = csv_ranges.columns_of(spark, path) if multiline and parallel else reader.csv(path).columns
    named = {c.strip().upper(): c for c in names}
    missing = [c for c in NOTE_CSV_COLUMNS if c not in named]
    if missing:
        raise ValueError(f"the export has no column {', '.join(missing)}")
    raw = csv_ranges.read_csv(spark, path) if multiline and parallel else reader.csv(path)
    return raw.select(F.col(f"`{named['SUBJECT_ID']}`").cast("long").alias("subject_id"),
                      F.col(f"`{named['ROW_ID']}`").cast("long").alias("note_id"),
                      F.col(f"`{named['TEXT']}`").alias("text"))


def write_notes_csv(df: DataFrame, path: str) -> None:
    """Write notes in the raw export's CSV shape (header, quoted fields that
    may span lines, doubled quotes, columns that the build doesn't read),
    readable by :func:`scan_notes_csv`."""
    (df.select(F.lit("2101-01-01").alias("CHARTTIME"), F.col("text").alias("TEXT"), F.lit("").alias("ISERROR"),
               F.col("subject_id").alias("SUBJECT_ID"), F.lit(7).alias("CGID"), F.col("note_id").alias("ROW_ID"))
       .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
       .option("quoteAll", True).csv(path))


def land_notes(df: DataFrame, path: str) -> DataFrame:
    """Write notes once as Parquet, clustered by subject, and read them back.

    Range partitioning on (subject_id, note_id) keeps each subject's notes
    together and in order, and still splits a subject with very many notes
    across several files (hash partitioning on the subject alone would send
    a hot subject to one task)."""
    (df.repartitionByRange("subject_id", "note_id").sortWithinPartitions("subject_id", "note_id")
       .write.mode("overwrite").parquet(path))
    return df.sparkSession.read.parquet(path)


def scan_notes(spark: SparkSession, path: str, columns=("subject_id", "note_id", "text")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str | None = None, name: str = "table",
                partition_by=None, mode: str = "overwrite") -> DataFrame:
    """Persist a DataFrame as Parquet at a new path and return a reader over it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return spark.read.parquet(path)


def write_embeddings(df: DataFrame, path: str | None = None) -> DataFrame:
    """Embedding rows (note_id, encoder, embedding) partitioned by encoder, so a
    reader of one encoder touches only that folder."""
    return write_table(df, path, name="embeddings", partition_by="encoder")


def scan_embeddings(spark: SparkSession, path: str, encoder: str | None = None) -> DataFrame:
    """Read the embedding store; a named encoder prunes to one partition."""
    df = spark.read.parquet(path)
    return df.where(F.col("encoder") == encoder) if encoder else df


def write_metrics(metrics: DataFrame, path: str | None = None, mode: str = "append", run_id: str | None = None) -> DataFrame:
    """Append a long metrics table (gen, learner, encoder, metric, class, value)
    partitioned by generation.

    With ``run_id`` the rows lie in a partition of their run, which a repeated
    write of that run replaces, so a retried job doesn't count twice; other runs stay.
    A table is written with run ids throughout or not at all."""
    cols = [f.name for f in METRICS_SCHEMA.fields]
    out = metrics.select(*[F.col(c).cast(METRICS_SCHEMA[c].dataType) for c in cols])
    if run_id is None:
        return write_table(out, path, name="metrics", partition_by="gen", mode=mode)
    spark = out.sparkSession
    path = path or scratch_path(spark, "metrics")
    (out.withColumn("run", F.lit(str(run_id))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "gen").parquet(path))
    return spark.read.schema("learner string, encoder string, metric string, class string, value double, run string, gen string").parquet(path)
