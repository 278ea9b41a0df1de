"""Streaming query: the stream's final set equals the batch match."""

from __future__ import annotations

from notewise.plans.catalog import query
from notewise.sources.tables import table
from notewise.streaming.cohort_stream import stream_cohort


@query("stream_cohort",
       "SELECT DISTINCT user_id AS subject_id FROM events WHERE regexp_matches(event_type, '(?i)PURCH')")
def q_stream_cohort(spark, sf):
    """Matched subjects accumulated micro-batch by micro-batch from a file
    stream over the events folder; must equal the batch cohort match."""
    schema = table(spark, sf, "events").schema
    q, out = stream_cohort(spark, sf, schema, ["PURCH"], "event_type", "user_id",
                           glob="events.parquet", max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(out).select("subject_id")
