"""Exact running sums over a global order without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task. The
curve operators need running totals in descending score order over the per-score
aggregate, whose size can approach the row count for continuous scores, and exact
quantiles need running counts over the distinct values of a column. Here the order
key is cut into ``buckets`` ranges by approximate quantiles (computed once per query and
per group), running sums are computed inside each bucket (one task per bucket, balanced
by construction), and each bucket gets the exact total of all buckets before it from a
``groups x buckets`` table that is broadcast back. Equal keys always fall into the same
bucket, so ties are kept together. Results are exact; the quantiles only balance work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucketed(df: DataFrame, key: str, group: Sequence[str], buckets: int, descending: bool,
              tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``_bucket``: ranges of the order key cut at approximate quantiles, monotone in the order.

    A key value equal to two or more cut points is hot (it holds over a bucket's worth of rows).
    With a numeric first ``tiebreak`` column its rows are spread over those buckets by
    approximate quantiles of the tiebreak among them, so the bucket stays monotone in
    (key, tiebreak) and the running sums stay exact. Rows equal in both stay together.
    """
    group = list(group)
    k = F.col(key)
    probs = [i / buckets for i in range(1, buckets)]
    bcol = F.col("_bounds")
    if descending:
        lo, hi = F.size(F.filter(bcol, lambda b: b > k)), F.size(F.filter(bcol, lambda b: b >= k))
    else:
        lo, hi = F.size(F.filter(bcol, lambda b: b < k)), F.size(F.filter(bcol, lambda b: b <= k))
    if group:
        # one row of bounds per group; AQE broadcasts it when its measured size is small
        bounds = df.groupBy(*group).agg(F.percentile_approx(k, probs, 10000).alias("_bounds"))
        b = df.join(bounds, group, "left")
    else:
        # a subquery cannot sit inside a lambda: bring the bounds in as a column first
        b = df.withColumn("_bounds", df.agg(F.percentile_approx(k, probs, 10000)).scalar())
    b = b.withColumn("_lo", lo.cast("int")).withColumn("_hi", hi.cast("int")).drop("_bounds")
    numeric_tb = bool(tiebreak) and isinstance(df.schema[tiebreak[0]].dataType, T.NumericType)
    if not numeric_tb:
        return b.withColumnRenamed("_lo", "_bucket").drop("_hi")
    t = F.col(tiebreak[0])
    # hot: the key spans two or more cut points (>= ~1/buckets of the group's rows); a key that
    # merely equals one cut point stays in its bucket. At most groups x buckets / 2 rows.
    tq = (b.filter(F.col("_hi") - F.col("_lo") >= 2).groupBy(*group, key)
          .agg(F.percentile_approx(t.cast("double"), probs, 10000).alias("_tq")))
    j = b.join(tq, [*group, key], "left")
    tqc = F.col("_tq")
    n_before = F.size(F.filter(tqc, lambda q: q > t)) if descending else F.size(F.filter(tqc, lambda q: q < t))
    m = F.col("_hi") - F.col("_lo")
    sub = F.least(F.floor(n_before * (m + 1) / F.lit(buckets)), m)
    # nulls sort first ascending and last descending
    sub = F.when(t.isNull(), m if descending else F.lit(0)).otherwise(sub)
    bucket = F.when(tqc.isNull(), F.col("_lo")).otherwise(F.col("_lo") + sub)
    return j.withColumn("_bucket", bucket.cast("int")).drop("_lo", "_hi", "_tq")


def running_sums(df: DataFrame, key: str, values: Sequence[str], descending: bool = True,
                 buckets: int | None = None, prefix: str = "cum_", group: Sequence[str] = (),
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows (of the same group) with key before-or-equal.

    ``df`` should hold distinct keys per group (aggregate first); rows with equal keys would
    get running sums in an arbitrary order among themselves unless ``tiebreak`` columns
    order them. With ``group`` columns the bounds and offsets tables have one row per group
    (and bucket); they are joined normally so AQE decides on broadcasting from their size.
    """
    spark = df.sparkSession
    group = list(group)
    if buckets is None:
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    k = F.col(key)
    b = _bucketed(df, key, group, buckets, descending, tiebreak) if buckets > 1 else df.withColumn("_bucket", F.lit(0))
    order = [k.desc() if descending else k.asc()] + [F.col(t).desc() if descending else F.col(t).asc() for t in tiebreak]
    w = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.select("*", *[F.sum(v).over(w).alias(f"_loc_{v}") for v in values])
    totals = b.groupBy(*group, "_bucket").agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    # at most groups x buckets rows
    wt = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", *[F.coalesce(F.sum(f"_tot_{v}").over(wt), F.lit(0)).alias(f"_off_{v}")
                                                 for v in values])
    # without groups the offsets table has exactly `buckets` rows: a proven bound, broadcast it;
    # with groups it has groups x buckets rows and AQE picks the join from its real size
    offs = offsets if group else F.broadcast(offsets)
    out = local.join(offs, [*group, "_bucket"], "left")
    return out.select(*df.columns, *[(F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in values])


def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("value")) for c in cols])
    return df.select(F.inline(cells))


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group: (group..., <name> per prob).

    Same definition as Spark's ``percentile`` (position ``p * (n - 1)``), but distributed:
    values are counted per (group, distinct value) with map-side partial aggregation,
    running counts come from :func:`running_sums`, and the values around each position are
    picked by one grouped aggregate. No task holds all values of a group (the built-in
    aggregate keeps a value map per group and merges it in one task), so a hot group
    holding a third of the rows is spread like any other. NaN counts as missing.
    """
    group = list(group)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = (df.select(*group, v.alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")))
    rs = running_sums(counts, "_v", ["_c"], descending=False, buckets=buckets, group=group)
    # n per group: one row per group (AQE broadcasts it when small)
    if group:
        ns = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
        j = rs.join(ns, group)
    else:  # the global n is one scalar subquery
        j = rs.withColumn("_n", counts.agg(F.sum("_c")).scalar())
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("cum__c") > lo, F.col("_v"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("cum__c") > hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.max(pos - lo).alias(f"_fr{i}")]
    agg = j.groupBy(*group).agg(*aggs)
    return agg.select(*group, *[(F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n)
                                for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5, buckets: int | None = None) -> DataFrame:
    """Exact quantile ``q`` of several numeric columns at once: (column_name, quantile).

    The columns are stacked into (column_name, value) and handled by
    :func:`grouped_quantiles` with the column name as the group; a column without values
    gets a null.
    """
    lg = _long(df, cols, "double")
    res = grouped_quantiles(lg, ["column_name"], "value", [q], ["quantile"], buckets)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(res, "column_name", "left")


def exact_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value of several columns, ties -> smallest: (column_name, mode).

    Distributed: counts per (column, value) with partial aggregation, the top count per
    column, then the smallest value among the values reaching it — no task holds all
    distinct values of a column.
    """
    lg = _long(df, cols, "string")
    counts = lg.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("column_name").agg(F.max("c").alias("_top"))
    best = (counts.join(F.broadcast(top), "column_name").filter(F.col("c") == F.col("_top"))
            .groupBy("column_name").agg(F.min("value").alias("mode")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(best, "column_name", "left")
