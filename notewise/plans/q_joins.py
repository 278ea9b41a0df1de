"""Queries for bag concatenation, key alignment and feature fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from notewise.functions.numeric import array_sum
from notewise.operators import features as fe
from notewise.operators.filters import keyword_filter
from notewise.plans.catalog import query
from notewise.sources.tables import conversation_notes, document_notes, embedding_rows, label_rows

KEYWORDS = ["licen", "apache", "edtion", "hation"]


@query("concat_batches",
       "SELECT 'documents' AS origin, doc_id AS subject_id, CAST(0 AS BIGINT) AS note_id FROM documents "
       "WHERE regexp_matches(text, '(?i)licen|apache|edtion|hation') "
       "UNION ALL SELECT 'conversations', conv_id, turn FROM conversations "
       "WHERE regexp_matches(text, '(?i)licen|apache|edtion|hation')")
def q_concat_batches(spark, sf):
    """Matched notes of two sources stacked into one bag (union by name)."""
    docs = document_notes(spark, sf).select("subject_id", F.lit(0).cast("bigint").alias("note_id"), "text")
    conv = conversation_notes(spark, sf).select("subject_id", "note_id", "text")
    parts = [keyword_filter(d, KEYWORDS).select(F.lit(o).alias("origin"), "subject_id", "note_id")
             for o, d in (("documents", docs), ("conversations", conv))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("align_embeddings",
       "SELECT e.vec_id AS note_id, e.label, l.quality, CAST(len(e.embedding) AS BIGINT) AS dims "
       "FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id")
def q_align_embeddings(spark, sf):
    """Vectors paired with their label rows by key (inner join)."""
    out = fe.align_embeddings(embedding_rows(spark, sf), label_rows(spark, sf), "note_id")
    return out.select("note_id", "label", "quality", F.size("embedding").cast("bigint").alias("dims"))


@query("fuse_features",
       "SELECT e.vec_id AS note_id, CAST(len(e.embedding) + 2 AS BIGINT) AS n_features, "
       "round(list_sum(CAST(e.embedding AS DOUBLE[])) + l.quality + l.toxic, 6) AS total "
       "FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id")
def q_fuse_features(spark, sf):
    """Structured columns (quality, toxic stand in for age, gender) appended
    to the vector because both are present."""
    al = fe.align_embeddings(embedding_rows(spark, sf), label_rows(spark, sf), "note_id")
    out = fe.fuse_features(al, "embedding", ["quality", "toxic"], "features")
    return out.select("note_id", F.size("features").cast("bigint").alias("n_features"),
                      F.round(array_sum("features"), 6).alias("total"))
