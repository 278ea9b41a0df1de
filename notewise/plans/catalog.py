"""Registry of runnable queries, one per operator, each with its SQL oracle.

Every query reads the driver's tables from ``sf_dir`` (whole tables, whole
texts) and returns a DataFrame. ``sql`` is the same computation for DuckDB
over views named after the tables; ``None`` marks the model-fitting and
streaming operators that only get a rows check. Floats are rounded to 6
places on both sides; integer outputs are cast to bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules registers their queries.
    from notewise.plans import (  # noqa: F401
        q_text, q_filters, q_profile, q_cohort, q_joins, q_metrics, q_sampling,
        q_features, q_models, q_streaming,
    )
    return REGISTRY
