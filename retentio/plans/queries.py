"""Registered queries: one per operator, each with its DuckDB oracle where SQL can say it.

Every query reads the generated tables (through the views of
:mod:`retentio.sources.fixtures`) and runs over them whole. Double results are rounded
to 6 places on both sides so the two engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.plans.oracle import (
    age_group_sql,
    change_category_sql,
    change_class3_sql,
    q,
    r6,
    risk_level_sql,
    with_ctes,
)
from retentio.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the two assessments compared by the change queries (first and last week of the events)
DATE_BEFORE = "2024-01-01"
DATE_AFTER = "2024-01-29"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (for cross-engine value hashing)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# make sure all query modules register themselves
from retentio.plans import q_risk  # noqa: E402,F401
from retentio.plans import q_history  # noqa: E402,F401
from retentio.plans import q_eval  # noqa: E402,F401
from retentio.plans import q_features  # noqa: E402,F401
from retentio.plans import q_ml  # noqa: E402,F401
from retentio.plans import q_io  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLES", "register", "rounded", "fx", "q", "r6", "with_ctes",
           "risk_level_sql", "change_category_sql", "change_class3_sql", "age_group_sql"]
