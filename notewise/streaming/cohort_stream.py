"""Incremental cohort match with Structured Streaming.

The chunked scan of the reference becomes a file stream: every micro-batch
reads at most ``max_files_per_trigger`` new files and keeps the subjects of rows
that match the keywords, each once per Arrow batch (a subject with a third of
all rows sends a row a batch to its state, not a row a note). State keyed by
subject (``dropDuplicates``, RocksDB, so it may outgrow memory) emits a subject
when it is first seen; no batch reads earlier output.

Each micro-batch's new subjects are written to ``<out>/batch=<epoch>`` and one
row (batch, new_subjects, running_total, stopped) to ``<out>/_ledger``, both with
overwrite, so a retried epoch replaces its own output instead of duplicating it;
the running total is the last row's plus the new ones. With ``stop_at`` the stream
ends after the batch in which the running total reaches it, like the reference's
chunk loop; later files don't count, also after a restart. The checkpoint makes
the stream restartable after executor or driver loss.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.functions.text import contains_any
from notewise.session import broadcast_if_small, scratch_path, ship_package

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LEDGER = "batch long, new_subjects long, running_total long, stopped boolean"


def _each_once(batches):
    for b in batches:
        seen = pc.unique(b.column(0))
        if len(seen):
            yield pa.RecordBatch.from_arrays([seen], names=["subject_id"])


def stream_cohort(spark: SparkSession, source_dir: str, schema: T.StructType, keywords: Iterable[str],
                  match_col: str, subject_col: str, glob: str | None = None,
                  max_files_per_trigger: int = 1, out_path: str | None = None,
                  checkpoint: str | None = None, available_now: bool = True, stop_at: int | None = None,
                  state_store: str | None = ROCKSDB):
    """Start the stream; returns (query, output path). With ``available_now``
    it processes what is there and stops. ``state_store``: the state's provider
    class (None: the session's)."""
    ship_package(spark)
    out_path = out_path or scratch_path(spark, "stream-cohort")
    checkpoint = checkpoint or scratch_path(spark, "stream-cohort-ckpt")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    matched = reader.parquet(source_dir).where(contains_any(match_col, list(keywords))).select(F.col(subject_col).alias("subject_id"))
    kind = schema[subject_col].dataType.simpleString()
    new_subjects = matched.mapInArrow(_each_once, f"subject_id {kind}").dropDuplicates(["subject_id"])
    started = []

    def sink(batch: DataFrame, epoch: int):
        session = batch.sparkSession
        total, stopped = _so_far(session, out_path, epoch)
        here = f"{out_path}/batch={epoch}"
        if stopped:
            batch = batch.where(F.lit(False))
        batch.write.mode("overwrite").parquet(here)
        new = session.read.schema(batch.schema).parquet(here).count()  # this batch's own rows
        stopped = stopped or (stop_at is not None and total + new >= stop_at)
        (session.createDataFrame([(epoch, new, total + new, stopped)], _LEDGER).coalesce(1)
                .write.mode("overwrite").parquet(f"{out_path}/_ledger/at={epoch}"))
        if stopped and started:
            threading.Thread(target=started[0].stop, daemon=True).start()  # a batch can't stop its own query

    w = new_subjects.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    before = spark.conf.get(_STORE, None)
    if state_store:
        spark.conf.set(_STORE, state_store)
    try:
        started.append(w.start())  # the query keeps the settings it was started with
    finally:
        if state_store:
            spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return started[0], out_path


def _so_far(spark: SparkSession, out_path: str, epoch: int) -> tuple[int, bool]:
    """Running total before an epoch and whether the stream had reached its end: one row."""
    if epoch == 0:
        return 0, False
    row = spark.read.schema(_LEDGER).parquet(f"{out_path}/_ledger/at={epoch - 1}").first()
    return row["running_total"], row["stopped"]


def cohort_so_far(spark: SparkSession, out_path: str) -> DataFrame:
    """Subjects emitted so far, with the micro-batch that first saw them, its number of new
    subjects and the running distinct count at its end (from the ledger: a row a batch)."""
    ledger = spark.read.schema(_LEDGER).parquet(f"{out_path}/_ledger").select(
        F.col("batch").cast("int").alias("batch"), "new_subjects", "running_total")
    return spark.read.parquet(out_path).join(broadcast_if_small(ledger), "batch")
