"""Table profile: preview, shape and target distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW_ROWS = 100


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows (a display limit)."""
    return df.limit(n)


def profile_shape(df: DataFrame) -> DataFrame:
    """One row: row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("int"))


def target_distribution(df: DataFrame, target: str = "dropout") -> DataFrame:
    """Count and % per target value, plus the overall rate of target = 1.

    The totals are scalar subqueries over one more aggregate, so a target of many values stays distributed.
    """
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    ones = F.count_if(F.col(target) == 1) / F.count(F.lit(1))
    total, rate = df.agg(F.count(F.lit(1))).scalar(), df.agg(ones).scalar()
    return g.select(target, "n", (F.col("n") * 100.0 / total).alias("pct"), rate.alias("dropout_rate"))
