"""SQL fragments for the DuckDB oracle, kept next to the Spark forms they mirror."""

from __future__ import annotations

from notewise.functions.stopwords import CLINICAL_STOPWORDS, ENGLISH_STOPWORDS


def hash_sql(seed, *parts: str) -> str:
    """DuckDB twin of :func:`notewise.functions.numeric.hash_unit`."""
    body = f"'{seed}'"
    for p in parts:
        body += f" || ':' || CAST({p} AS VARCHAR)"
    return f"CAST(('0x' || substr(md5({body}), 1, 8)) AS BIGINT)"


def clean_sql(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[^a-z]+', ' ', 'g'))"


def tokens_sql(clean_expr: str) -> str:
    return f"list_filter(string_split_regex({clean_expr}, '\\s+'), lambda w: w <> '')"


def words_list_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


ENGLISH_SQL = words_list_sql(ENGLISH_STOPWORDS)
CLINICAL_SQL = words_list_sql(CLINICAL_STOPWORDS)


def scored_sql(positive_label: int = 0) -> str:
    """Rows (note_id, y, score) of :func:`notewise.sources.tables.scored_rows`."""
    return (f"SELECT vec_id AS note_id, CAST(label = {positive_label} AS INTEGER) AS y, "
            "round(list_sum(CAST(embedding AS DOUBLE[])), 2) AS score FROM embeddings")


def curve_sql(scored: str, group: str = "") -> str:
    """CTE chain g (per distinct score), k (running tp/fp), t (totals)."""
    gsel = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    tjoin = f"USING ({group})" if group else "ON TRUE"
    return f"""
     s AS ({scored}),
     g AS (SELECT {gsel}score, SUM(y) AS dp, COUNT(*) - SUM(y) AS dn FROM s GROUP BY {gsel}score),
     t AS (SELECT {gsel}SUM(dp) AS np, SUM(dn) AS nn FROM g {('GROUP BY ' + group) if group else ''}),
     k AS (SELECT g.*, SUM(dp) OVER ({part}ORDER BY score DESC) AS tp,
                  SUM(dn) OVER ({part}ORDER BY score DESC) AS fp FROM g),
     c AS (SELECT k.*, t.np, t.nn, tp / (tp + fp) AS precision,
                  CASE WHEN t.np = 0 THEN 1.0 ELSE tp / t.np END AS recall
           FROM k JOIN t {tjoin})"""
