"""Operators over the risk-assessment history and the model-metric history.

Risk history: ``assessment_date, student_id, dropout_probability, prediction, risk_level,
model_version, notes`` — stored partitioned by ``assessment_date`` so date filters prune
partitions. Metric history: documents ``(timestamp, model_version, metrics map,
dataset_info map)`` flattened by :func:`explode_metrics` into one row per numeric metric.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.bins import clean_double, risk_level
from retentio.operators.running import grouped_quantiles

DATE = "assessment_date"
P = "dropout_probability"
EVAL_METRICS = ("accuracy", "precision", "recall", "f1_score")


# ---------------------------------------------------------------------------------------------
# risk history
# ---------------------------------------------------------------------------------------------
def assessment_dates(history: DataFrame) -> DataFrame:
    """Sorted distinct assessment dates of any history (:meth:`RiskHistory.dates` lists those of a stored one)."""
    return history.select(DATE).distinct().orderBy(DATE)


def assessments_for_model(history: DataFrame, model_version: str) -> DataFrame:
    """Assessments produced by one model version with their size."""
    return (history.filter(F.col("model_version") == F.lit(model_version))
            .groupBy(DATE, "model_version")
            .agg(F.count(F.lit(1)).alias("n_students"), F.min("notes").alias("notes"))
            .orderBy(DATE))


def dedupe_assessment(rows: DataFrame) -> DataFrame:
    """One row per student: keeps the highest probability when a student appears twice.

    Rows without an id are different unknown students and all stay.
    """
    cols = [c for c in rows.columns if c != "student_id"]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), clean_double(P))
    one = rows.filter("student_id is not null").groupBy("student_id").agg(best.alias("_r")).select("student_id", "_r.*")
    return one.unionByName(rows.filter("student_id is null"))


def as_assessment(risks: DataFrame, date, model_version: str, notes: str | None = None) -> DataFrame:
    """Shape a risk table as history rows of one date (level added when missing)."""
    df = risks
    if "risk_level" not in df.columns:
        df = df.withColumn("risk_level", risk_level(P))
    if "prediction" not in df.columns:
        df = df.withColumn("prediction", (clean_double(P) >= 0.5).cast("int"))
    df = dedupe_assessment(df.select("student_id", P, "prediction", "risk_level"))
    return df.select(
        F.lit(date).cast("date").alias(DATE), "student_id", clean_double(P).alias(P),
        F.col("prediction").cast("int").alias("prediction"), "risk_level",
        F.lit(model_version).alias("model_version"), F.lit(notes).cast("string").alias("notes"))


def upsert_assessment(history: DataFrame, risks: DataFrame, date, model_version: str,
                      notes: str | None = None) -> DataFrame:
    """History with the assessment of ``date`` replaced by ``risks`` (last write wins).

    In-memory form of :meth:`RiskHistory.upsert`; the stored form overwrites only the
    ``assessment_date`` partition.
    """
    new = as_assessment(risks, date, model_version, notes)
    keep = history.filter(F.col(DATE) != F.lit(date).cast("date"))
    return keep.unionByName(new.select(*history.columns))


def student_risk_history(history: DataFrame, students, start=None, end=None) -> DataFrame:
    """Assessments of chosen students within [start, end] (inclusive), ordered by student, date.

    ``students`` is a list of ids or a one-column DataFrame of ids; a DataFrame is applied
    as a left-semi join (AQE turns it into a broadcast join when the id set is small).
    """
    h = history
    if start is not None:
        h = h.filter(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        h = h.filter(F.col(DATE) <= F.lit(end).cast("date"))
    if isinstance(students, DataFrame):
        ids = students.select(F.col(students.columns[0]).alias("student_id")).distinct()
        h = h.join(ids, "student_id", "left_semi")
    else:
        ids = [students] if isinstance(students, str) else list(students)
        h = h.filter(F.col("student_id").isin(ids))
    return (h.select(DATE, "student_id", P, "risk_level", "model_version")
            .orderBy("student_id", DATE))


def risk_pivot(follow: DataFrame, dates: Sequence) -> DataFrame:
    """Student x date table of mean probability (one column per date, explicit dates).

    Rows are students and columns are the (few) assessment dates, so the width is bounded
    by the chosen dates while the row count grows with the data.
    """
    vals = [str(d) for d in dates]
    return (follow.withColumn("_d", F.col(DATE).cast("string"))
            .groupBy("student_id").pivot("_d", vals).agg(F.avg(P)))


# ---------------------------------------------------------------------------------------------
# metric history
# ---------------------------------------------------------------------------------------------
def explode_metrics(entries: DataFrame) -> DataFrame:
    """Documents -> long table (timestamp, model_version, metric_name, metric_value, dataset_info).

    Only numeric metrics are kept: nested values (matrices, lists) fail the cast and drop.
    """
    e = entries.select("timestamp", "model_version", F.explode("metrics").alias("metric_name", "_raw"),
                       "dataset_info")
    v = F.col("_raw").try_cast("double")
    return (e.withColumn("metric_value", v).filter(v.isNotNull())
            .select("timestamp", "model_version", "metric_name", "metric_value", "dataset_info"))


def metrics_history(long: DataFrame, model_version: str | None = None, metric_name: str | None = None,
                    start=None, end=None) -> DataFrame:
    """Filter the long metric table; ``start``/``end`` are inclusive and a bare date is midnight."""
    df = long
    if model_version:
        df = df.filter(F.col("model_version") == F.lit(model_version))
    if metric_name:
        df = df.filter(F.col("metric_name") == F.lit(metric_name))
    if start:
        df = df.filter(F.col("timestamp") >= F.to_timestamp_ntz(F.lit(str(start))))
    if end:
        df = df.filter(F.col("timestamp") <= F.to_timestamp_ntz(F.lit(str(end))))
    return df


def history_dimensions(long: DataFrame) -> DataFrame:
    """Distinct model versions and metric names as (dimension, value) rows."""
    mv = long.select(F.lit("model_version").alias("dimension"), F.col("model_version").alias("value"))
    mn = long.select(F.lit("metric_name").alias("dimension"), F.col("metric_name").alias("value"))
    return mv.unionByName(mn).filter(F.col("value").isNotNull()).distinct()


def metric_trend(long: DataFrame, metric_name: str, model_versions: Iterable[str] | None = None,
                 window: int = 1, buckets: int | None = None) -> DataFrame:
    """Time series of one metric per model, in time order, with an optional rolling mean of ``window`` rows.

    Where ``window > 1`` and the model has at least ``window`` points, ``trend_value`` is the
    mean of the current and previous ``window-1`` points and null for the first ``window-1``;
    otherwise it is the raw value. Points are ordered by (timestamp, value). A NaN reaches only the
    windows that hold it.

    A model with a third of the history is no single task: time is cut into ``buckets`` at
    approximate quantiles, the mean is a bounded row window inside (model, bucket), and the first
    ``window-1`` points of a bucket also take the last points before it, which come from a table
    of the last ``window-1`` values of each (model, bucket).
    """
    df = metrics_history(long, metric_name=metric_name)
    if model_versions:
        df = df.filter(F.col("model_version").isin(list(model_versions)))
    df = df.filter(F.col("model_version").isNotNull()).select("model_version", "timestamp", "metric_value")
    w = int(window)
    v = F.col("metric_value")
    order = [F.col("model_version"), F.col("timestamp"), v]
    if w <= 1:
        return df.select("model_version", "timestamp", "metric_value", v.alias("trend_value")).orderBy(*order)
    if buckets is None:
        buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    # microseconds since the epoch without a time-zone conversion (exact in a double)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp").cast("timestamp_ntz")).cast("double")
    cuts = [i / buckets for i in range(1, buckets)]
    keyed = df.withColumn("_k", micros)
    if cuts:
        keyed = keyed.withColumn("_cuts", keyed.agg(F.percentile_approx("_k", cuts, 10000)).scalar())
        keyed = keyed.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_k")))).drop("_cuts")
    else:
        keyed = keyed.withColumn("_b", F.lit(0))
    inside = Window.partitionBy("model_version", "_b")
    rows = inside.orderBy("timestamp", "metric_value")
    number = F.coalesce(v, F.lit(float("nan")))  # a missing value is missing in every window that holds it
    latest = F.collect_list(number).over(rows.rowsBetween(-(w - 1), Window.currentRow))
    r = keyed.select("model_version", "timestamp", "metric_value", "_b", latest.alias("_w"),
                     F.row_number().over(rows).alias("_r"), F.count(F.lit(1)).over(inside).alias("_size"))
    # one row per (model, bucket): its last w - 1 values, latest first
    ends = (r.filter(F.col("_r") == F.col("_size"))
            .select("model_version", "_b", "_size", F.slice(F.reverse("_w"), 1, w - 1).alias("_tail")))
    whole = Window.partitionBy("model_version")
    # the w - 1 values before a bucket lie in at most w - 1 earlier buckets
    earlier = F.collect_list("_tail").over(whole.orderBy(F.col("_b").desc()).rowsBetween(1, w - 1))
    halo = ends.select("model_version", "_b", F.slice(F.flatten(earlier), 1, w - 1).alias("_halo"),
                       F.sum("_size").over(whole).alias("_n"))
    j = r.drop("_r", "_size").join(halo, ["model_version", "_b"])
    values = F.concat("_w", F.slice("_halo", 1, F.lit(w) - F.size("_w")))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.lit(float(w))
    trend = F.when(F.col("_n") < w, v).when(F.size(values) == w, mean)
    return j.select("model_version", "timestamp", "metric_value", trend.alias("trend_value")).orderBy(*order)


def compare_models(long: DataFrame, model_versions: Iterable[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean of each metric per model version; wide (one column per metric) when metrics are given.

    Without explicit metric names the result stays long (model_version, metric_name,
    mean_value) so no distinct-values job or unbounded pivot is needed.
    """
    df = long.filter(F.col("model_version").isin(list(model_versions)))
    if metrics is None:
        return df.groupBy("model_version", "metric_name").agg(F.avg("metric_value").alias("mean_value"))
    df = df.filter(F.col("metric_name").isin(list(metrics)))
    return df.groupBy("model_version").pivot("metric_name", list(metrics)).agg(F.avg("metric_value"))


def latest_metrics(long: DataFrame, model_version: str | None = None) -> DataFrame:
    """Latest value of every metric per model version (later entries win)."""
    df = long if model_version is None else long.filter(F.col("model_version") == F.lit(model_version))
    return (df.groupBy("model_version", "metric_name")
            .agg(F.max_by("metric_value", F.struct("timestamp", "metric_value")).alias("metric_value"),
                 F.max("timestamp").alias("timestamp")))


def evaluations_long(evals: DataFrame, metrics: Sequence[str] = EVAL_METRICS, model: str = "model_name") -> DataFrame:
    """Wide evaluation rows -> (model, metric, value) with a missing metric counted as 0."""
    present = [m for m in metrics if m in evals.columns]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"))
                      for m in present]
                    + [F.struct(F.lit(m).alias("metric"), F.lit(0.0).alias("value")) for m in metrics if m not in present])
    return evals.select(F.col(model).alias("model_name"), F.inline(cells))


def model_performance_stats(evals: DataFrame, metrics: Sequence[str] = EVAL_METRICS,
                            model: str = "model_name") -> DataFrame:
    """Per model and metric: mean, population std, min, max, median (missing counts as 0)."""
    lg = evaluations_long(evals, metrics, model)
    v = F.col("value")
    moments = lg.groupBy("model_name", "metric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    med = grouped_quantiles(lg, ["model_name", "metric"], "value", [0.5], ["median"])
    return moments.join(med, ["model_name", "metric"], "left")


def model_metric_matrix(evals: DataFrame, metrics: Sequence[str] = EVAL_METRICS, model: str = "model_name",
                        order_by: str = "run_date") -> DataFrame:
    """Models x metrics table from each model's latest evaluation; missing metric -> 0."""
    present = [m for m in metrics if m in evals.columns]
    latest = (evals.groupBy(model)
              .agg(F.max_by(F.struct(*[F.col(m) for m in present]), F.col(order_by)).alias("_r")))
    cols = [F.coalesce(F.col(f"_r.{m}").cast("double"), F.lit(0.0)).alias(m) if m in present
            else F.lit(0.0).alias(m) for m in metrics]
    return latest.select(F.col(model).alias("model_name"), *cols)


def score_quartiles(long: DataFrame, metric_name: str, group: str = "model_version") -> DataFrame:
    """Box-plot quartiles (min, q1, median, q3, max) of one metric per group (exact, distributed)."""
    v = F.col("metric_value")
    df = long.filter(F.col("metric_name") == F.lit(metric_name))
    qs = grouped_quantiles(df, [group], "metric_value", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])
    ends = df.groupBy(group).agg(F.min(v).alias("q0"), F.max(v).alias("q4"), F.count(v).alias("n"))
    return ends.join(qs, group, "left").select(group, "q0", "q1", "q2", "q3", "q4", "n")
