"""Queries for cohort construction.

Fixture: ``conversations`` (subject = conv_id, note = turn), keywords
``edtion`` / ``hation``, prevalence 0.6; bounded cohort on ``events`` with
``PURCH``, chunks of 100 rows and K = 60.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions.text import clean_text, contains_any, word_length
from notewise.operators import cohort as co
from notewise.plans.catalog import query
from notewise.plans.sqlbits import clean_sql, hash_sql, tokens_sql
from notewise.session import materialize
from notewise.sources.tables import conversation_notes, event_rows

KEYWORDS = ["edtion", "hation"]
PREVALENCE = 0.6
SEED = 42

FLAGS_SQL = ("SELECT conv_id AS subject_id, MAX(CASE WHEN coalesce(regexp_matches(text, '(?i)edtion|hation'), false) "
             "THEN 1 ELSE 0 END) AS matched FROM conversations GROUP BY conv_id")
SIZE_SQL = (f"SELECT CAST(m AS BIGINT) AS n_matched, CAST(floor(m / {PREVALENCE}) AS BIGINT) AS target, "
            f"CAST(floor(m / {PREVALENCE}) - m AS BIGINT) AS neg_wanted, CAST(p AS BIGINT) AS pool, "
            f"CAST(least(floor(m / {PREVALENCE}) - m, p) AS BIGINT) AS neg_taken, "
            f"CAST(floor(m / {PREVALENCE}) - m - least(floor(m / {PREVALENCE}) - m, p) AS BIGINT) AS shortfall "
            f"FROM (SELECT SUM(matched) AS m, SUM(1 - matched) AS p FROM f)")
SAMPLE_SQL = (f"SELECT subject_id FROM (SELECT subject_id, row_number() OVER (ORDER BY "
              f"{hash_sql(SEED, 'subject_id')}, subject_id) AS rn FROM f WHERE matched = 0) r, sz "
              f"WHERE rn <= sz.neg_taken")
COHORT_CTE = (f"WITH f AS ({FLAGS_SQL}), sz AS ({SIZE_SQL}), smp AS ({SAMPLE_SQL}), "
              f"coh AS (SELECT subject_id, 1 AS y FROM f WHERE matched = 1 "
              f"UNION ALL SELECT subject_id, 0 AS y FROM smp)")
MATCHED_CTE = ("WITH m AS (SELECT DISTINCT conv_id AS subject_id FROM conversations "
               "WHERE coalesce(regexp_matches(text, '(?i)edtion|hation'), false))")


def _notes(spark, sf):
    return conversation_notes(spark, sf)


def _flags(spark, sf):
    return co.subject_flags(_notes(spark, sf), KEYWORDS)


@query("cohort_match", f"{MATCHED_CTE} SELECT subject_id FROM m")
def q_cohort_match(spark, sf):
    """COH-1: subjects with any note matching a keyword."""
    return co.cohort_match(_notes(spark, sf), KEYWORDS)


@query("cohort_match_bounded", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events),
     m AS (SELECT user_id AS subject_id, CAST(MIN(floor(pos / 100)) AS BIGINT) AS first_chunk FROM o
           WHERE regexp_matches(event_type, '(?i)PURCH') GROUP BY user_id),
     p AS (SELECT first_chunk, SUM(COUNT(*)) OVER (ORDER BY first_chunk) AS cum FROM m GROUP BY first_chunk),
     st AS (SELECT MIN(first_chunk) AS s FROM p WHERE cum >= 60)
SELECT subject_id, first_chunk FROM m, st WHERE s IS NULL OR first_chunk <= s""")
def q_cohort_match_bounded(spark, sf):
    """COH-2: chunked scan that stops after the chunk reaching 60 subjects."""
    ev = event_rows(spark, sf)
    return co.cohort_match_bounded(ev, contains_any("event_type", ["PURCH"]), 100, 60)


@query("matched_notes",
       f"{MATCHED_CTE} SELECT conv_id AS subject_id, turn AS note_id FROM conversations "
       f"WHERE conv_id IN (SELECT subject_id FROM m)")
def q_matched_notes(spark, sf):
    """All notes of matched subjects."""
    notes = _notes(spark, sf)
    return co.semi_join(notes, co.cohort_match(notes, KEYWORDS)).select("subject_id", "note_id")


@query("cohort_size", f"WITH f AS ({FLAGS_SQL}) {SIZE_SQL}")
def q_cohort_size(spark, sf):
    """COH-3: target = int(n / prevalence), negatives wanted, clamped to the pool."""
    return co.cohort_size_table(_flags(spark, sf), PREVALENCE)


@query("sample_negatives", f"WITH f AS ({FLAGS_SQL}), sz AS ({SIZE_SQL}) {SAMPLE_SQL}")
def q_sample_negatives(spark, sf):
    """COH-4: exact seeded sample of the negative pool. The flags are written once, so the
    size, the cutoff and the sample don't scan the texts again."""
    flags = materialize(_flags(spark, sf))
    pool = flags.where(F.col("matched") == 0).select("subject_id")
    n = co.cohort_size_table(flags, PREVALENCE).select("neg_taken").scalar()
    return co.sample_negatives(pool, n, seed=SEED)


@query("negative_pool_anti_join",
       f"{MATCHED_CTE} SELECT DISTINCT conv_id AS subject_id FROM conversations "
       f"WHERE conv_id NOT IN (SELECT subject_id FROM m)")
def q_negative_pool(spark, sf):
    """All subjects minus matched subjects (left anti join)."""
    notes = _notes(spark, sf)
    return co.negative_pool(notes, co.cohort_match(notes, KEYWORDS))


@query("cohort_union", f"{COHORT_CTE} SELECT subject_id, CAST(y AS INTEGER) AS y FROM coh")
def q_cohort_union(spark, sf):
    """Matched subjects (y = 1) and sampled controls (y = 0)."""
    return co.cohort_subjects(_flags(spark, sf), PREVALENCE, SEED).select(
        "subject_id", F.col("y").cast("int").alias("y"))


@query("cohort_semi_join",
       f"{COHORT_CTE} SELECT conv_id AS subject_id, turn AS note_id FROM conversations "
       f"WHERE conv_id IN (SELECT subject_id FROM coh)")
def q_cohort_semi_join(spark, sf):
    """Notes of the final cohort subjects (left semi join)."""
    notes = _notes(spark, sf)
    ids = co.cohort_subjects(co.subject_flags(notes, KEYWORDS), PREVALENCE, SEED)
    return co.semi_join(notes, ids).select("subject_id", "note_id")


@query("case_control_cohort",
       f"{COHORT_CTE} SELECT c.conv_id AS subject_id, c.turn AS note_id, CAST(coh.y AS INTEGER) AS y "
       f"FROM conversations c JOIN coh ON c.conv_id = coh.subject_id")
def q_case_control_cohort(spark, sf):
    """Matched + sampled subjects' notes with the subject label, one plan."""
    out = co.case_control_cohort(_notes(spark, sf), KEYWORDS, PREVALENCE, SEED)
    return out.select("subject_id", "note_id", F.col("y").cast("int").alias("y"))


@query("label_existence_join",
       f"{MATCHED_CTE} SELECT conv_id AS subject_id, turn AS note_id, "
       f"CASE WHEN conv_id IN (SELECT subject_id FROM m) THEN 1 ELSE 0 END AS y FROM conversations")
def q_label_existence(spark, sf):
    """y = 1 when the note's subject is a matched subject (left join + coalesce)."""
    notes = _notes(spark, sf)
    out = co.label_existence(notes, co.cohort_match(notes, KEYWORDS))
    return out.select("subject_id", "note_id", F.col("y").cast("int").alias("y"))


@query("label_cohort",
       f"{COHORT_CTE} SELECT c.conv_id AS subject_id, c.turn AS note_id, {clean_sql('c.text')} AS clean_text, "
       f"CAST(len({tokens_sql(clean_sql('c.text'))}) AS BIGINT) AS n_words, CAST(coh.y AS INTEGER) AS y "
       f"FROM conversations c JOIN coh ON c.conv_id = coh.subject_id")
def q_label_cohort(spark, sf):
    """The labelled corpus: cohort notes, cleaned text, length, label."""
    out = co.case_control_cohort(_notes(spark, sf), KEYWORDS, PREVALENCE, SEED)
    out = out.withColumn("clean_text", clean_text("text"))
    return out.select("subject_id", "note_id", "clean_text",
                      word_length("clean_text", cleaned=True).cast("bigint").alias("n_words"),
                      F.col("y").cast("int").alias("y"))


BOUNDED_SQL = """
WITH o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events),
     m AS (SELECT user_id AS subject_id, MIN(floor(pos / 100)) AS first_chunk FROM o
           WHERE regexp_matches(event_type, '(?i)PURCH') GROUP BY user_id),
     p AS (SELECT first_chunk, SUM(COUNT(*)) OVER (ORDER BY first_chunk) AS cum FROM m GROUP BY first_chunk),
     st AS (SELECT MIN(first_chunk) AS s FROM p WHERE cum >= 60),
     bm AS (SELECT subject_id FROM m, st WHERE s IS NULL OR first_chunk <= s),
     f AS (SELECT DISTINCT user_id AS subject_id,
                  CASE WHEN user_id IN (SELECT subject_id FROM bm) THEN 1 ELSE 0 END AS matched FROM events)"""


@query("cohort_union_bounded",
       f"{BOUNDED_SQL}, sz AS ({SIZE_SQL}), smp AS ({SAMPLE_SQL}) "
       f"SELECT subject_id, 1 AS y FROM f WHERE matched = 1 UNION ALL SELECT subject_id, 0 AS y FROM smp")
def q_cohort_union_bounded(spark, sf):
    """Faithful COH-4: controls drawn from all subjects minus the *bounded*
    match set, so late-matching subjects can be drawn as controls."""
    ev = event_rows(spark, sf)
    flags = co.bounded_flags(ev, contains_any("event_type", ["PURCH"]), 100, 60)
    return co.cohort_subjects(flags, PREVALENCE, SEED).select("subject_id", F.col("y").cast("int").alias("y"))
