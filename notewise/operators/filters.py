"""Projections, filters and plan-time checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.functions.text import contains_any


def keyword_filter(df: DataFrame, keywords: Iterable[str], text_col: str = "text",
                   whole_word: bool = False, regex: bool = False) -> DataFrame:
    """Rows whose text contains any keyword (case-insensitive substring by
    default; null text never matches)."""
    return df.where(contains_any(text_col, keywords, whole_word, regex))


def domain_filter(df: DataFrame, col: str, allowed=(0, 1)) -> DataFrame:
    return df.where(F.col(col).isin(list(allowed)))


def drop_null_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.dropna(subset=[text_col])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def select_column(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols)


def require_columns(df: DataFrame, required: Sequence[str] = (),
                    optional_groups: Sequence[Sequence[str]] = ()) -> tuple[DataFrame, list[bool]]:
    """Fail at plan time if a required column is missing; for each optional
    group report whether *all* its columns are present. No job runs."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    return df, [all(c in have for c in g) for g in optional_groups]


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | str = "note_id") -> DataFrame:
    """First n rows by a key (a top-n, not an arbitrary head)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)
