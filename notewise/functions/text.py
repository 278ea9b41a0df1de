"""Text expressions. All are native Catalyst expressions (no Python worker).

``clean_text`` is lower-case -> digits out -> anything but a-z and whitespace
out -> whitespace runs collapsed -> trimmed. Because every character that is
not ``a``-``z`` ends up as a separator, the four steps collapse to a single
``regexp_replace(lower(t), '[^a-z]+', ' ')`` plus a trim of spaces.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cast_text(col, null_as_nan: bool = True) -> Column:
    """Coerce to string. ``null_as_nan`` reproduces ``astype(str)`` (null -> 'nan')."""
    s = _c(col).cast("string")
    return F.coalesce(s, F.lit("nan")) if null_as_nan else s


def lowercase(col) -> Column:
    return F.lower(_c(col))


def strip_digits(col) -> Column:
    # \p{Nd} = any Unicode decimal digit, the set Python's \d matches.
    return F.regexp_replace(_c(col), r"\p{Nd}+", " ")


def strip_punct(col) -> Column:
    return F.regexp_replace(_c(col), r"[^a-z\s]", " ")


def collapse_ws(col) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def clean_text(col) -> Column:
    """One-regex form of the four cleaning steps (see module docstring)."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), "[^a-z]+", " "))


def tokenize(col, cleaned: bool = False) -> Column:
    """Whitespace split without the empty token Spark's ``split('')`` yields.

    ``cleaned=True`` is for output of :func:`clean_text`, whose words are
    separated by single spaces with none at the ends: a plain split, no
    regex and no lambda, with '' mapped to an empty array."""
    c = _c(col)
    if cleaned:
        return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(c, " "))
    return F.filter(F.split(c, r"\s+"), lambda w: w != F.lit(""))


def word_length(col, cleaned: bool = False) -> Column:
    """Number of whitespace-separated words (0 for empty or null text)."""
    return F.coalesce(F.size(tokenize(col, cleaned)), F.lit(0))


def remove_stopwords(tokens, stopwords: Iterable[str]) -> Column:
    """Drop listed words from an array of tokens. The literal list becomes a
    hash-set lookup (InSet) inside the lambda, so cost is per token, not per
    token x list length."""
    words = list(stopwords)
    return F.filter(_c(tokens), lambda w: ~w.isin(words))


def truncate_tokens(tokens, max_tokens: int | None) -> Column:
    """First ``max_tokens`` tokens, for encoders with a hard input limit.
    ``None`` keeps the whole text."""
    t = _c(tokens)
    return t if max_tokens is None else F.slice(t, 1, max_tokens)


def keyword_regex(keywords: Iterable[str], whole_word: bool = False,
                  regex: bool = False) -> str:
    """Case-insensitive alternation of keywords; quoted unless ``regex``."""
    parts = []
    for k in keywords:
        if regex:
            parts.append(k)
        elif "\\E" in k:
            parts.append("".join("\\" + ch if not ch.isalnum() else ch for ch in k))
        else:
            parts.append(f"\\Q{k}\\E")
    alt = "|".join(parts)
    if whole_word:
        alt = f"\\b(?:{alt})\\b"
    return f"(?iu)(?:{alt})"


def contains_any(col, keywords: Iterable[str], whole_word: bool = False,
                 regex: bool = False) -> Column:
    """True when the text contains any keyword as a case-insensitive
    substring; null text is False (never null)."""
    return F.coalesce(_c(col).rlike(keyword_regex(keywords, whole_word, regex)),
                      F.lit(False))
