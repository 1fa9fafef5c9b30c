"""Reproducible stratified train/test split and stratified fold assignment.

Every row gets a uniform number ``u`` in [0, 1) from ``md5(key || ':' || seed)`` (the
first 15 hex digits / 16^15), so the result depends only on the key and the seed, not
on partitioning or row order, and the same value can be computed in SQL.

* hash mode (default, any scale): test when ``u < test_size``; fold = ``floor(u * k)``.
  Label proportions hold in expectation; no shuffle at all.
* exact mode: within each label, rows are ranked by ``(u, key)``; the first
  ``round(n_label * test_size)`` are test, fold = ``(rank - 1) % k``. The rank is computed
  without a window partitioned by the label (that would be one task per label): rows are
  spread over ``buckets`` ranges of ``u`` (uniform, so balanced), ranked inside
  (label, bucket), and offset by the counts of earlier buckets of the same label — a
  ``labels x buckets`` table joined back (AQE broadcasts it from its measured size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 15
HEX_SCALE = float(16 ** HEX_DIGITS)


def hash_unit(key, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(HEX_SCALE)


def hash_unit_sql(key: str, seed: int = 42) -> str:
    return (f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, {HEX_DIGITS})) AS BIGINT)"
            f" / {HEX_SCALE!r})")


def rank_within_label(df: DataFrame, label: str, key: str, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Adds ``_u``, ``_rank`` (1-based, by (u, key) within the label) and ``_n_label``."""
    spark = df.sparkSession
    if buckets is None:
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    u = hash_unit(key, seed)
    b = df.withColumn("_u", u).withColumn("_bucket", F.least(F.floor(F.col("_u") * buckets), F.lit(buckets - 1)).cast("int"))
    w = Window.partitionBy(label, "_bucket").orderBy("_u", key)
    local = b.withColumn("_lrank", F.row_number().over(w))
    counts = b.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(label).orderBy("_bucket")
    offs = counts.select(label, "_bucket",
                         F.coalesce(F.sum("_c").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy(label)).alias("_n_label"))
    # labels x buckets rows: small for a class label, but not bounded for any label, so AQE
    # broadcasts it from its measured size; joined on (label, bucket), a hot label stays spread
    out = local.join(offs, [label, "_bucket"], "left")
    return out.withColumn("_rank", F.col("_lrank") + F.col("_off")).drop("_bucket", "_lrank", "_off")


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                     exact: bool = False) -> DataFrame:
    """Adds ``split`` = 'train' / 'test'."""
    if not exact:
        return df.withColumn("split", F.when(hash_unit(key, seed) < F.lit(test_size), F.lit("test")).otherwise(F.lit("train")))
    r = rank_within_label(df, label, key, seed)
    n_test = F.floor(F.col("_n_label") * F.lit(test_size) + F.lit(0.5))
    return (r.withColumn("split", F.when(F.col("_rank") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_u", "_rank", "_n_label"))


def assign_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, exact: bool = False) -> DataFrame:
    """Adds ``fold`` in 0..k-1, stratified by ``label``."""
    if not exact:
        return df.withColumn("fold", F.least(F.floor(hash_unit(key, seed) * k), F.lit(k - 1)).cast("int"))
    r = rank_within_label(df, label, key, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_u", "_rank", "_n_label")
