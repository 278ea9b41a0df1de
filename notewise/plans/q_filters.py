"""Queries for scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions.numeric import array_sum
from notewise.functions.text import clean_text, word_length
from notewise.operators import filters as fl
from notewise.plans.catalog import query
from notewise.plans.sqlbits import clean_sql, tokens_sql
from notewise.sources import io
from notewise.sources.tables import document_notes, embedding_rows, table

DOC_KEYWORDS = ["licen", "apache"]


@query("scan_notes", "SELECT doc_id AS note_id, text, lang, source FROM documents")
def q_scan_notes(spark, sf):
    """Note scan projected to the note schema (pruned to four columns)."""
    return document_notes(spark, sf).select("note_id", "text", "lang", "source")


_EMB_SUMMARY_SQL = ("SELECT vec_id AS note_id, 'enc' || CAST(label AS VARCHAR) AS encoder, "
                    "CAST(len(embedding) AS BIGINT) AS dims, "
                    "round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, "
                    "round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")


def _emb_summary(df):
    return df.select("note_id", "encoder", F.size("embedding").cast("bigint").alias("dims"),
                     F.round(array_sum("embedding"), 6).alias("total"),
                     F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("scan_embeddings", _EMB_SUMMARY_SQL)
def q_scan_embeddings(spark, sf):
    """Embedding matrix as keyed rows (label stands in for the encoder name)."""
    e = embedding_rows(spark, sf).withColumn("encoder", F.concat(F.lit("enc"), F.col("label").cast("string")))
    return _emb_summary(e)


@query("write_embeddings", _EMB_SUMMARY_SQL)
def q_write_embeddings(spark, sf):
    """Write the vectors partitioned by encoder and read them back."""
    e = embedding_rows(spark, sf).select(
        "note_id", F.concat(F.lit("enc"), F.col("label").cast("string")).alias("encoder"), "embedding")
    back = io.write_embeddings(e)
    return _emb_summary(back)


@query("write_notes",
       f"SELECT doc_id AS note_id, {clean_sql('text')} AS clean_text, "
       f"CAST(len({tokens_sql(clean_sql('text'))}) AS BIGINT) AS n_words FROM documents")
def q_write_notes(spark, sf):
    """Cleaned corpus written as Parquet to a new path, read back."""
    d = document_notes(spark, sf).select("note_id", clean_text("text").alias("clean_text"))
    d = d.withColumn("n_words", word_length("clean_text", cleaned=True).cast("bigint"))
    return io.write_table(d, name="notes")


@query("scan_notes_csv", "SELECT doc_id AS subject_id, doc_id AS note_id, text FROM documents")
def q_scan_notes_csv(spark, sf):
    """Notes exported as multi-line quoted CSV with further columns, in another order, scanned
    back by the header's names (no inference pass): the raw-export source."""
    from notewise.session import scratch_path
    path = scratch_path(spark, "notes-csv")
    io.write_notes_csv(document_notes(spark, sf), path)
    return io.scan_notes_csv(spark, path)


@query("keyword_filter",
       "SELECT doc_id AS note_id, source FROM documents WHERE coalesce(regexp_matches(text, '(?i)licen|apache'), false)")
def q_keyword_filter(spark, sf):
    """Notes containing any keyword, case-insensitive, no word boundary."""
    return fl.keyword_filter(document_notes(spark, sf), DOC_KEYWORDS).select("note_id", "source")


@query("domain_filter", "SELECT vec_id AS note_id, label FROM embeddings WHERE label IN (0, 1)")
def q_domain_filter(spark, sf):
    """Rows whose label is 0 or 1."""
    return fl.domain_filter(embedding_rows(spark, sf), "label").select("note_id", "label")


@query("drop_null_text", "SELECT doc_id AS note_id FROM documents WHERE text IS NOT NULL")
def q_drop_null_text(spark, sf):
    return fl.drop_null_text(document_notes(spark, sf)).select("note_id")


@query("drop_columns", "SELECT doc_id, text, n_chars FROM documents")
def q_drop_columns(spark, sf):
    return fl.drop_columns(table(spark, sf, "documents"), ["lang", "source"])


@query("select_column", "SELECT text FROM documents")
def q_select_column(spark, sf):
    return fl.select_column(table(spark, sf, "documents"), "text")


@query("require_columns", "SELECT vec_id AS note_id, label FROM embeddings")
def q_require_columns(spark, sf):
    """Label column required, (age, gender) optional: checked at plan time."""
    df, _ = fl.require_columns(embedding_rows(spark, sf), ["label"], [("age", "gender")])
    return df.select("note_id", "label")


@query("preview", "SELECT doc_id AS note_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_preview(spark, sf):
    """First five notes by id."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), "lang", "n_chars")
    return fl.preview(d, 5, "note_id")
