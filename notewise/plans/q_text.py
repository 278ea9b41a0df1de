"""Queries for the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions import stopwords as sw
from notewise.functions import text as tx
from notewise.plans.catalog import query
from notewise.plans.sqlbits import CLINICAL_SQL, ENGLISH_SQL, clean_sql, tokens_sql
from notewise.sources.tables import document_notes


def _docs(spark, sf):
    return document_notes(spark, sf)


@query("clean_text", f"SELECT doc_id AS note_id, {clean_sql('text')} AS clean_text FROM documents")
def q_clean_text(spark, sf):
    """Cleaned note text: lower, digits and non-letters out, spaces collapsed."""
    return _docs(spark, sf).select("note_id", tx.clean_text("text").alias("clean_text"))


@query("lowercase", "SELECT doc_id AS note_id, lower(text) AS value FROM documents")
def q_lowercase(spark, sf):
    return _docs(spark, sf).select("note_id", tx.lowercase("text").alias("value"))


@query("strip_digits",
       "SELECT doc_id AS note_id, regexp_replace(lower(text), '\\p{Nd}+', ' ', 'g') AS value FROM documents")
def q_strip_digits(spark, sf):
    return _docs(spark, sf).select("note_id", tx.strip_digits(tx.lowercase("text")).alias("value"))


@query("strip_punct",
       "SELECT doc_id AS note_id, regexp_replace(regexp_replace(lower(text), '\\p{Nd}+', ' ', 'g'), "
       "'[^a-z\\s]', ' ', 'g') AS value FROM documents")
def q_strip_punct(spark, sf):
    return _docs(spark, sf).select(
        "note_id", tx.strip_punct(tx.strip_digits(tx.lowercase("text"))).alias("value"))


@query("collapse_ws",
       "SELECT doc_id AS note_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), "
       "'\\p{Nd}+', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM documents")
def q_collapse_ws(spark, sf):
    """The four cleaning steps chained literally; equals clean_text."""
    return _docs(spark, sf).select(
        "note_id", tx.collapse_ws(tx.strip_punct(tx.strip_digits(tx.lowercase("text")))).alias("value"))


@query("cast_text", "SELECT doc_id AS note_id, coalesce(CAST(text AS VARCHAR), 'nan') AS text FROM documents")
def q_cast_text(spark, sf):
    return _docs(spark, sf).select("note_id", tx.cast_text("text").alias("text"))


@query("tokenize",
       f"SELECT doc_id AS note_id, CAST(len({tokens_sql(clean_sql('text'))}) AS BIGINT) AS n_tokens, "
       f"array_to_string({tokens_sql(clean_sql('text'))}, '|') AS tokens FROM documents")
def q_tokenize(spark, sf):
    toks = tx.tokenize(tx.clean_text("text"), cleaned=True)
    return _docs(spark, sf).select("note_id", F.size(toks).cast("bigint").alias("n_tokens"),
                                   F.array_join(toks, "|").alias("tokens"))


@query("word_length",
       f"SELECT doc_id AS note_id, CAST(len({tokens_sql(clean_sql('text'))}) AS BIGINT) AS n_words FROM documents")
def q_word_length(spark, sf):
    return _docs(spark, sf).select(
        "note_id", tx.word_length(tx.clean_text("text"), cleaned=True).cast("bigint").alias("n_words"))


def _kept_sql(stop_sql):
    kept = f"list_filter({tokens_sql(clean_sql('text'))}, lambda w: NOT list_contains({stop_sql}, w))"
    return (f"SELECT doc_id AS note_id, CAST(len({kept}) AS BIGINT) AS n_kept, "
            f"array_to_string({kept}, ' ') AS kept FROM documents")


@query("remove_stopwords", _kept_sql(ENGLISH_SQL))
def q_remove_stopwords(spark, sf):
    kept = tx.remove_stopwords(tx.tokenize(tx.clean_text("text"), cleaned=True), sw.ENGLISH_STOPWORDS)
    return _docs(spark, sf).select("note_id", F.size(kept).cast("bigint").alias("n_kept"),
                                   F.array_join(kept, " ").alias("kept"))


@query("extend_stopwords", _kept_sql(CLINICAL_SQL))
def q_extend_stopwords(spark, sf):
    """English list plus the 17 domain words, applied to every note."""
    kept = tx.remove_stopwords(tx.tokenize(tx.clean_text("text"), cleaned=True), sw.CLINICAL_STOPWORDS)
    return _docs(spark, sf).select("note_id", F.size(kept).cast("bigint").alias("n_kept"),
                                   F.array_join(kept, " ").alias("kept"))


@query("truncate_tokens",
       f"SELECT doc_id AS note_id, CAST(len({tokens_sql(clean_sql('text'))}) AS BIGINT) AS n_tokens, "
       f"CAST(greatest(len({tokens_sql(clean_sql('text'))}) - 512, 0) AS BIGINT) AS n_beyond, "
       f"CAST(len({tokens_sql(clean_sql('text'))}) <= 512 AS INTEGER) AS fits, "
       f"array_to_string(list_slice({tokens_sql(clean_sql('text'))}, 1, 512), ' ') AS kept FROM documents")
def q_truncate_tokens(spark, sf):
    """What a 512-token encoder window keeps and cuts, per note: every note is
    tokenised whole; the tokens that are kept, and how many lie beyond."""
    toks = tx.tokenize(tx.clean_text("text"), cleaned=True)
    n = F.size(toks)
    cut = tx.truncate_tokens(toks, 512)
    kept = F.size(cut)
    return _docs(spark, sf).select("note_id", n.cast("bigint").alias("n_tokens"),
                                   (n - kept).cast("bigint").alias("n_beyond"),
                                   (n <= 512).cast("int").alias("fits"), F.array_join(cut, " ").alias("kept"))
