"""Queries for aggregations, profiles and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions import stopwords as sw
from notewise.functions.text import clean_text, word_length
from notewise.operators import profile as pr
from notewise.operators import sketches as sk
from notewise.plans.catalog import query
from notewise.plans.sqlbits import CLINICAL_SQL, ENGLISH_SQL, clean_sql, tokens_sql
from notewise.session import scratch_path
from notewise.sources.tables import conversation_notes, document_notes, event_rows, label_rows, table


def _words_sql(stop_sql):
    return (f"WITH w AS (SELECT unnest({tokens_sql(clean_sql('text'))}) AS word FROM documents "
            f"WHERE text IS NOT NULL) "
            f"SELECT word, CAST(COUNT(*) AS BIGINT) AS count FROM w "
            f"WHERE NOT list_contains({stop_sql}, word) GROUP BY word")


@query("distinct_subjects", "SELECT DISTINCT conv_id AS subject_id FROM conversations")
def q_distinct_subjects(spark, sf):
    return pr.distinct_subjects(conversation_notes(spark, sf))


@query("count_distinct_subjects",
       "SELECT CAST(COUNT(DISTINCT conv_id) AS BIGINT) AS n_subjects FROM conversations")
def q_count_distinct_subjects(spark, sf):
    return pr.count_distinct_subjects(conversation_notes(spark, sf))


@query("notes_per_subject",
       "SELECT conv_id AS subject_id, CAST(COUNT(*) AS BIGINT) AS n_notes FROM conversations GROUP BY conv_id")
def q_notes_per_subject(spark, sf):
    return pr.notes_per_subject(conversation_notes(spark, sf))


_DESCRIBE_COLS = ("CAST(COUNT(x) AS BIGINT) AS count, round(AVG(x), 6) AS mean, round(STDDEV_SAMP(x), 6) AS std, "
                  "round(MIN(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, "
                  "round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, "
                  "round(MAX(x), 6) AS max")


def _round_describe(df):
    return df.select(F.col("what"), F.col("count").cast("bigint"),
                     *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("describe_numeric",
       f"SELECT 'note_words' AS what, {_DESCRIBE_COLS} FROM (SELECT CAST(len({tokens_sql(clean_sql('text'))}) "
       f"AS DOUBLE) AS x FROM documents) "
       f"UNION ALL SELECT 'notes_per_subject' AS what, {_DESCRIBE_COLS} FROM "
       f"(SELECT CAST(COUNT(*) AS DOUBLE) AS x FROM conversations GROUP BY conv_id)")
def q_describe_numeric(spark, sf):
    """pandas-style describe of note length in words and of notes per subject."""
    lengths = document_notes(spark, sf).select(word_length(clean_text("text"), cleaned=True).alias("n_words"))
    a = pr.describe_numeric(lengths, "n_words").withColumn("what", F.lit("note_words"))
    per = pr.notes_per_subject(conversation_notes(spark, sf))
    b = pr.describe_numeric(per, "n_notes").withColumn("what", F.lit("notes_per_subject"))
    return _round_describe(a.unionByName(b))


@query("count_positive",
       "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) "
       "AS positives FROM labels")
def q_count_positive(spark, sf):
    """Positives of the 0/1 label (quality = 0 is the minority class)."""
    y = label_rows(spark, sf).select((F.col("quality") == 0).cast("int").alias("y"))
    return pr.count_positive(y)


@query("table_profile", """
SELECT column_name, CAST(position AS BIGINT) AS position, dtype, CAST(non_null AS BIGINT) AS non_null,
       CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT 'doc_id' AS column_name, 0 AS position, 'bigint' AS dtype, COUNT(doc_id) AS non_null, COUNT(*) AS n_rows FROM documents
  UNION ALL SELECT 'text', 1, 'string', COUNT(text), COUNT(*) FROM documents
  UNION ALL SELECT 'lang', 2, 'string', COUNT(lang), COUNT(*) FROM documents
  UNION ALL SELECT 'source', 3, 'string', COUNT(source), COUNT(*) FROM documents
  UNION ALL SELECT 'n_chars', 4, 'bigint', COUNT(n_chars), COUNT(*) FROM documents)""")
def q_table_profile(spark, sf):
    """Row count, type and non-null count of every column, in one scan."""
    return pr.table_profile(table(spark, sf, "documents"))


@query("word_count", _words_sql(ENGLISH_SQL))
def q_word_count(spark, sf):
    return pr.word_count(document_notes(spark, sf), "text", sw.ENGLISH_STOPWORDS)


@query("word_count_custom", _words_sql(CLINICAL_SQL))
def q_word_count_custom(spark, sf):
    return pr.word_count(document_notes(spark, sf), "text", sw.CLINICAL_STOPWORDS)


@query("top_words", f"SELECT * FROM ({_words_sql(ENGLISH_SQL)}) ORDER BY count DESC, word LIMIT 20")
def q_top_words(spark, sf):
    """20 most common words after English stop words."""
    return pr.top_words(pr.word_count(document_notes(spark, sf), "text", sw.ENGLISH_STOPWORDS), 20)


@query("top_words_custom", f"SELECT * FROM ({_words_sql(CLINICAL_SQL)}) ORDER BY count DESC, word LIMIT 20")
def q_top_words_custom(spark, sf):
    """20 most common words after the extended stop-word list."""
    return pr.top_words(pr.word_count(document_notes(spark, sf), "text", sw.CLINICAL_STOPWORDS), 20)


@query("word_weights",
       f"WITH c AS ({_words_sql(CLINICAL_SQL)}) SELECT word, count, round(count / (SELECT MAX(count) FROM c), 6) "
       f"AS weight FROM c ORDER BY count DESC, word LIMIT 200")
def q_word_weights(spark, sf):
    """Top 200 words with frequency scaled to the most common word."""
    wc = pr.word_count(document_notes(spark, sf), "text", sw.CLINICAL_STOPWORDS)
    out = pr.word_weights(wc, 200)
    return out.withColumn("weight", F.round("weight", 6))


@query("length_histogram", f"""
WITH x AS (SELECT CAST(len({tokens_sql(clean_sql('text'))}) AS BIGINT) AS v FROM documents),
     m AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM x),
     b AS (SELECT CASE WHEN hi > lo THEN least(CAST(floor((v - lo) * 50 / (hi - lo)) AS BIGINT), 49) ELSE 25 END
                  AS bin FROM x, m),
     c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin)
SELECT r.range AS bin,
       round(CASE WHEN hi > lo THEN lo + r.range * (hi - lo) / 50.0 ELSE lo - 0.5 + r.range / 50.0 END, 6) AS lo_edge,
       round(CASE WHEN hi > lo THEN lo + (r.range + 1) * (hi - lo) / 50.0 ELSE lo - 0.5 + (r.range + 1) / 50.0 END, 6)
         AS hi_edge,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM range(50) r CROSS JOIN m LEFT JOIN c ON c.bin = r.range""")
def q_length_histogram(spark, sf):
    """50 equal-width bins of note length in words (empty bins included)."""
    lengths = document_notes(spark, sf).select(word_length(clean_text("text"), cleaned=True).alias("n_words"))
    h = pr.length_histogram(lengths, "n_words", 50)
    return h.select("bin", F.round("lo_edge", 6).alias("lo_edge"), F.round("hi_edge", 6).alias("hi_edge"),
                    "count")


@query("subject_sketches", """
SELECT role, COUNT(*) AS n_rows, COUNT(DISTINCT conv_id) AS n_subjects FROM conversations GROUP BY role""")
def q_subject_sketches(spark, sf):
    """Distinct subjects by role from sketches of four landed batches, merged without a rescan (an estimate
    beyond some thousands of subjects, error 0.9%; exact below)."""
    notes = conversation_notes(spark, sf)
    path = scratch_path(spark, "subject-sketches")
    for i in range(4):
        table = sk.land_sketch(notes.where(F.pmod("subject_id", F.lit(4)) == i), f"batch-{i}", path, group_cols=["role"])
    return sk.count_subjects(table, ["role"])


@query("subject_overlap", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
     b AS (SELECT DISTINCT user_id FROM events WHERE event_type <> 'purchase' AND event_id % 10 = 0),
     c AS (SELECT COUNT(a.user_id) AS na, COUNT(b.user_id) AS nb,
                  COUNT(*) FILTER (WHERE a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS nab, COUNT(*) AS n_either
           FROM a FULL JOIN b USING (user_id))
SELECT n_either, nab AS n_both, na - nab AS n_left_only, nb - nab AS n_right_only FROM c""")
def q_subject_overlap(spark, sf):
    """Subjects with a purchase against subjects with another event among every tenth: either, both and one side only,
    by set operations on two stored theta sketches."""
    e = event_rows(spark, sf)
    left = sk.land_sketch(e.where("event_type = 'purchase'"), "purchases")
    right = sk.land_sketch(e.where("event_type <> 'purchase' and ord % 10 = 0"), "others")
    return sk.compare_subjects(left, right)
