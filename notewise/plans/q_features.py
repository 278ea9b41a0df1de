"""Encoder queries: text -> vector per note, each entry that isn't 0 as a row.

The hashed encoders are checked value by value; the trained one (word_vectors) has no SQL, its parts
are tested against plain versions in tests/test_word_vectors.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.operators import features as fe
from notewise.operators import word_vectors as wv
from notewise.plans.catalog import query
from notewise.plans.sqlbits import clean_sql, hash_sql, tokens_sql
from notewise.sources.tables import document_notes

_WORDS = f"SELECT doc_id AS note_id, unnest({tokens_sql(clean_sql('text'))}) AS w FROM documents WHERE text IS NOT NULL"
_TFIDF = f"""
  words AS ({_WORDS}),
  bucket AS (SELECT note_id, {hash_sql(42, 'w')} % 256 AS dim, COUNT(*) AS tf FROM words GROUP BY ALL),
  seen AS (SELECT dim, COUNT(*) AS df FROM bucket GROUP BY dim),
  weight AS (SELECT note_id, dim, tf * ln(((SELECT COUNT(*) FROM documents WHERE text IS NOT NULL) + 1) / (df + 1)) AS v
             FROM bucket JOIN seen USING (dim)),
  tfidf AS (SELECT note_id, 'hashed_tfidf' AS encoder, dim, CAST(v / sqrt(SUM(v * v) OVER (PARTITION BY note_id)) AS FLOAT) AS v
            FROM weight)"""
#: MD5 digit (dim // 4) of the word holds the sign of dimension dim in its bit 3 - dim % 4.
_SIGNS = """
  counted AS (SELECT note_id, w, COUNT(*) AS n FROM words GROUP BY ALL),
  signed AS (SELECT note_id, dim, n, 2 * (((instr('0123456789abcdef', substr(md5('42:' || w), CAST(dim // 4 + 1 AS INTEGER), 1)) - 1)
                    >> CAST(3 - dim % 4 AS INTEGER)) & 1) - 1 AS s FROM counted, range(64) AS r(dim)),
  vectors AS (SELECT note_id, 'hashed_vectors' AS encoder, dim, CAST(SUM(n * s) / SUM(n) / 8.0 AS FLOAT) AS v FROM signed GROUP BY ALL)"""
_ENTRY = "note_id, encoder, CAST(dim AS INTEGER) AS dim, round(CAST(v AS DOUBLE), 6) AS value"


def _entries(df):
    """One row an entry that isn't 0."""
    each = df.select("note_id", "encoder", F.posexplode("embedding").alias("dim", "v")).where("v <> 0")
    return each.select("note_id", "encoder", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("embed_text", f"WITH {_TFIDF} SELECT {_ENTRY} FROM tfidf WHERE v <> 0")
def q_embed_text(spark, sf):
    """Hashed TF-IDF (256 dims, L2-normalised) of every whole cleaned note."""
    return _entries(fe.hashed_tfidf(document_notes(spark, sf), dim=256))


@query("embed_all", f"""WITH {_TFIDF}, {_SIGNS}
SELECT {_ENTRY} FROM (SELECT * FROM tfidf UNION ALL SELECT * FROM vectors) WHERE v <> 0""")
def q_embed_all(spark, sf):
    """Both hashed encoders over the same notes, one table keyed by (note_id, encoder)."""
    docs = document_notes(spark, sf)
    return _entries(fe.embed_all(docs, [lambda d: fe.hashed_tfidf(d, dim=256), lambda d: fe.hashed_vectors(d, dim=64)]))


@query("embed_trained")
def q_embed_trained(spark, sf):
    """Note vectors (32 dims) of word vectors trained on the notes: positive pointwise mutual information of
    neighbouring words, factored."""
    docs = document_notes(spark, sf)
    words = wv.train(docs, dim=32, vocabulary=4096)
    return wv.note_vectors(docs, words).select("note_id", "encoder", "embedding")
