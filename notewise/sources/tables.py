"""Readers for the driver's Parquet tables, projected to this library's schemas.

Each reader selects only the columns the caller names, so Parquet column
pruning and filter pushdown reach the scan.

Stand-ins (see FIXTURES.md): ``documents`` plays one note per subject
(``note_id = doc_id``); ``conversations`` plays several notes per subject
(``subject_id = conv_id``, ``note_id = turn``); ``events`` is the ordered scan
(``subject_id = user_id``, order = ``event_id``); ``embeddings`` is the feature
matrix keyed by ``vec_id``; ``labels`` is keyed by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.functions.numeric import array_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as notes: subject_id, note_id, text (+ lang, source)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("subject_id"), F.col("doc_id").alias("note_id"),
                    "text", "lang", "source")


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as notes: subject_id = conv_id, note_id = turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("subject_id"), F.col("turn").alias("note_id"),
                    "text", "role")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an ordered subject stream: subject_id, ord, event_type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("ord"),
                    "event_type", "ts", "value")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings``: note_id, embedding array<float>, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("note_id"), "embedding", "label")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels``: note_id, quality, toxic."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("note_id"), "quality", "toxic")


def scored_rows(spark: SparkSession, sf_dir: str, positive_label: int = 0) -> DataFrame:
    """A model-free score table: ``score = round(sum of all dimensions, 2)`` and
    ``y = (label = positive_label)``. Deterministic, so every evaluation
    operator can be checked against SQL without fitting a model."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("note_id"),
        (F.col("label") == positive_label).cast("int").alias("y"),
        F.round(array_sum("embedding"), 2).alias("score"),
    )
