"""Registered history queries (assessment store and metric history)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions.bins import EXTREME_RISK
from retentio.operators import history as hs
from retentio.operators import risk as rk
from retentio.plans import reports
from retentio.plans.oracle import q, risk_level_sql, with_ctes
from retentio.plans.queries import register, rounded
from retentio.sources import fixtures as fx

FOLLOW_START = "2024-01-08"
FOLLOW_END = "2024-01-29"
FOLLOW_DATES = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")
UPSERT_DATE = "2024-01-29"
UPSERT_FROM = "2024-01-22"
UPSERT_MODEL = "random_forest_v2"
TREND_METRIC = "mean_value"
TREND_WINDOW = 3
COMPARE_MODELS = ("click", "view", "error")
COMPARE_METRICS = ("mean_value", "share_over_50")
FILTER_MODEL = "click"
FILTER_START = "2024-01-05"
FILTER_END = "2024-01-20"


def _long(spark, sf):
    return hs.explode_metrics(fx.metric_entries(spark, sf))


# --- assessment store ---------------------------------------------------------------------
@register("assessment_dates", with_ctes("SELECT DISTINCT assessment_date FROM risk_history", "risk_history"))
def q_assessment_dates(spark, sf):
    return hs.assessment_dates(fx.risk_history(spark, sf))


@register("latest_assessment", with_ctes("""
SELECT assessment_date, student_id, round(dropout_probability, 6) AS dropout_probability, risk_level, model_version
FROM risk_history WHERE assessment_date = (SELECT max(assessment_date) FROM risk_history)""", "risk_history"))
def q_latest_assessment(spark, sf):
    a = rk.assessment(fx.risk_history(spark, sf))
    return rounded(a.select("assessment_date", "student_id", "dropout_probability", "risk_level", "model_version"))


@register("assessments_for_model", with_ctes("""
SELECT assessment_date, model_version, CAST(count(*) AS BIGINT) AS n_students, min(notes) AS notes
FROM risk_history WHERE model_version = 'gradient_boosting' GROUP BY 1, 2""", "risk_history"))
def q_assessments_for_model(spark, sf):
    return hs.assessments_for_model(fx.risk_history(spark, sf), "gradient_boosting")


def _rescored(spark, sf):
    """A new assessment computed from the last two weeks of events."""
    e = fx.table(spark, sf, "events").filter(F.col("ts") >= F.to_timestamp_ntz(F.lit(UPSERT_FROM)))
    g = e.groupBy("user_id").agg(
        (F.count_if(F.col("event_type").isin(*fx.RISK_EVENT_TYPES)) / F.count(F.lit(1))).alias("p"))
    return g.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("student_id"),
                    F.col("p").cast("double").alias("dropout_probability"))


_RESCORED_SQL = f"""
SELECT DATE '{UPSERT_DATE}' AS assessment_date, 'U' || CAST(user_id AS VARCHAR) AS student_id, p AS dropout_probability,
       CAST(p >= 0.5 AS INTEGER) AS prediction, {risk_level_sql('p')} AS risk_level,
       {q(UPSERT_MODEL)} AS model_version, CAST(NULL AS VARCHAR) AS notes
FROM (SELECT user_id, CAST(count_if(event_type IN ('error', 'signup')) AS DOUBLE) / count(*) AS p
      FROM events WHERE ts >= TIMESTAMP '{UPSERT_FROM}' GROUP BY user_id) r"""


@register("upsert_assessment", with_ctes(f"""
SELECT assessment_date, student_id, round(dropout_probability, 6) AS dropout_probability, prediction, risk_level,
       model_version, notes FROM (
  SELECT * FROM risk_history WHERE assessment_date <> DATE '{UPSERT_DATE}'
  UNION ALL {_RESCORED_SQL}) u""", "risk_history"))
def q_upsert_assessment(spark, sf):
    h = fx.risk_history(spark, sf)
    return rounded(hs.upsert_assessment(h, _rescored(spark, sf), UPSERT_DATE, UPSERT_MODEL))


def _followed(spark, sf):
    h = fx.risk_history(spark, sf)
    chosen = rk.extreme_risk(h.select("student_id", "dropout_probability"), EXTREME_RISK).select("student_id")
    return hs.student_risk_history(h, chosen, FOLLOW_START, FOLLOW_END)


_FOLLOW_SQL = f"""
SELECT assessment_date, student_id, dropout_probability, risk_level, model_version FROM risk_history
WHERE assessment_date BETWEEN DATE '{FOLLOW_START}' AND DATE '{FOLLOW_END}'
  AND student_id IN (SELECT student_id FROM risk_history WHERE dropout_probability >= {EXTREME_RISK})"""


@register("student_risk_history", with_ctes(f"""
SELECT assessment_date, student_id, round(dropout_probability, 6) AS dropout_probability, risk_level, model_version
FROM ({_FOLLOW_SQL}) f""", "risk_history"))
def q_student_risk_history(spark, sf):
    return rounded(_followed(spark, sf))


@register("risk_trends", with_ctes(f"""
SELECT 'series' AS part, assessment_date, student_id, round(dropout_probability, 6) AS value FROM risk_history
WHERE student_id IN (SELECT student_id FROM risk_history WHERE dropout_probability >= {EXTREME_RISK})
UNION ALL SELECT 'line', NULL, NULL, level FROM (VALUES {", ".join(f"({float(v)})" for v in reports.TREND_REFERENCE_LINES)}) l(level)""", "risk_history"))
def q_risk_trends(spark, sf):
    """Series of the students once at extreme risk, over all dates, and the lines between the levels."""
    h = fx.risk_history(spark, sf)
    chosen = rk.extreme_risk(h.select("student_id", "dropout_probability"), EXTREME_RISK).select("student_id")
    made = reports.risk_trends(h, chosen)
    series = made["series"].select(F.lit("series").alias("part"), "assessment_date", "student_id", F.col("dropout_probability").alias("value"))
    lines = made["reference_lines"].select(F.lit("line").alias("part"), F.lit(None).cast("date").alias("assessment_date"),
                                           F.lit(None).cast("string").alias("student_id"), F.col("level").alias("value"))
    return rounded(series.unionByName(lines))


@register("risk_pivot", with_ctes("SELECT student_id, " + ", ".join(
    f"round(avg(dropout_probability) FILTER (WHERE assessment_date = DATE '{d}'), 6) AS \"{d}\"" for d in FOLLOW_DATES)
    + f" FROM ({_FOLLOW_SQL}) f GROUP BY student_id", "risk_history"))
def q_risk_pivot(spark, sf):
    return rounded(hs.risk_pivot(_followed(spark, sf), FOLLOW_DATES))


# --- metric history -------------------------------------------------------------------------
@register("explode_metrics", with_ctes("""
SELECT timestamp, model_version, metric_name, round(metric_value, 6) AS metric_value, dataset_size
FROM metrics_long""", "metrics_long"))
def q_explode_metrics(spark, sf):
    lg = _long(spark, sf)
    return rounded(lg.select("timestamp", "model_version", "metric_name", "metric_value",
                             F.element_at("dataset_info", F.lit("size")).cast("bigint").alias("dataset_size")))


@register("metrics_history", with_ctes(f"""
SELECT timestamp, model_version, metric_name, round(metric_value, 6) AS metric_value FROM metrics_long
WHERE model_version = {q(FILTER_MODEL)} AND metric_name = {q(TREND_METRIC)}
  AND timestamp >= TIMESTAMP '{FILTER_START}' AND timestamp <= TIMESTAMP '{FILTER_END}'""", "metrics_long"))
def q_metrics_history(spark, sf):
    df = hs.metrics_history(_long(spark, sf), FILTER_MODEL, TREND_METRIC, FILTER_START, FILTER_END)
    return rounded(df.select("timestamp", "model_version", "metric_name", "metric_value"))


@register("history_dimensions", with_ctes("""
SELECT DISTINCT 'model_version' AS dimension, model_version AS value FROM metrics_long
UNION SELECT DISTINCT 'metric_name', metric_name FROM metrics_long""", "metrics_long"))
def q_history_dimensions(spark, sf):
    return hs.history_dimensions(_long(spark, sf))


@register("metric_trend", with_ctes(f"""
SELECT model_version, timestamp, round(metric_value, 6) AS metric_value,
       round(CASE WHEN cnt < {TREND_WINDOW} THEN metric_value WHEN rn < {TREND_WINDOW} THEN NULL ELSE roll END, 6) AS trend_value
FROM (SELECT model_version, timestamp, metric_value,
             row_number() OVER (PARTITION BY model_version ORDER BY timestamp, metric_value) AS rn,
             count(*) OVER (PARTITION BY model_version) AS cnt,
             avg(metric_value) OVER (PARTITION BY model_version ORDER BY timestamp, metric_value
                                     ROWS BETWEEN {TREND_WINDOW - 1} PRECEDING AND CURRENT ROW) AS roll
      FROM metrics_long WHERE metric_name = {q(TREND_METRIC)}) t""", "metrics_long"))
def q_metric_trend(spark, sf):
    return rounded(hs.metric_trend(_long(spark, sf), TREND_METRIC, None, TREND_WINDOW))


_ODD = ("CASE WHEN dayofmonth(timestamp) = 5 THEN CAST('NaN' AS DOUBLE) WHEN dayofmonth(timestamp) = 11 THEN CAST(1e8 AS DOUBLE) "
        "ELSE metric_value END")


@register("metric_trend_odd_values", with_ctes(f"""
SELECT model_version, timestamp, round(metric_value, 6) AS metric_value,
       round(CASE WHEN cnt < {TREND_WINDOW} THEN metric_value WHEN rn < {TREND_WINDOW} THEN NULL
                  WHEN bad > 0 THEN CAST('NaN' AS DOUBLE) ELSE total / {TREND_WINDOW} END, 6) AS trend_value
FROM (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY timestamp, metric_value) AS rn,
             count(*) OVER (PARTITION BY model_version) AS cnt,
             sum(CASE WHEN isnan(metric_value) THEN 1 ELSE 0 END) OVER w AS bad,
             sum(CASE WHEN isnan(metric_value) THEN 0 ELSE metric_value END) OVER w AS total
      FROM (SELECT model_version, timestamp, {_ODD} AS metric_value FROM metrics_long WHERE metric_name = {q(TREND_METRIC)}) o
      WINDOW w AS (PARTITION BY model_version ORDER BY timestamp, metric_value ROWS BETWEEN {TREND_WINDOW - 1} PRECEDING AND CURRENT ROW)) t""",
          "metrics_long"))
def q_metric_trend_odd_values(spark, sf):
    """The trend over a series with NaN and huge values: only the windows that hold them change."""
    day = F.dayofmonth("timestamp")
    odd = (F.when(day == 5, F.lit(float("nan"))).when(day == 11, F.lit(1e8)).otherwise(F.col("metric_value")))
    return rounded(hs.metric_trend(_long(spark, sf).withColumn("metric_value", odd), TREND_METRIC, None, TREND_WINDOW))


@register("compare_models", with_ctes("SELECT model_version, " + ", ".join(
    f"round(avg(metric_value) FILTER (WHERE metric_name = {q(m)}), 6) AS {m}" for m in COMPARE_METRICS)
    + " FROM metrics_long WHERE model_version IN (" + ", ".join(q(m) for m in COMPARE_MODELS)
    + ") AND metric_name IN (" + ", ".join(q(m) for m in COMPARE_METRICS) + ") GROUP BY model_version",
    "metrics_long"))
def q_compare_models(spark, sf):
    return rounded(hs.compare_models(_long(spark, sf), COMPARE_MODELS, COMPARE_METRICS))


@register("latest_metrics", with_ctes("""
SELECT model_version, metric_name, round(arg_max(metric_value, timestamp), 6) AS metric_value, max(timestamp) AS timestamp
FROM metrics_long GROUP BY 1, 2""", "metrics_long"))
def q_latest_metrics(spark, sf):
    return rounded(hs.latest_metrics(_long(spark, sf)))


_EVAL_LONG = " UNION ALL ".join(
    f"SELECT model_name, {q(m)} AS metric, coalesce({m}, CAST(0 AS DOUBLE)) AS value FROM evaluations"
    for m in hs.EVAL_METRICS)


@register("model_performance_stats", with_ctes(f"""
SELECT model_name, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median
FROM ({_EVAL_LONG}) l GROUP BY 1, 2""", "evaluations"))
def q_model_performance_stats(spark, sf):
    return rounded(hs.model_performance_stats(fx.evaluations(spark, sf)))


@register("model_metric_matrix", with_ctes("SELECT model_name, " + ", ".join(
    f"round(coalesce({m}, 0), 6) AS {m}" for m in hs.EVAL_METRICS)
    + " FROM evaluations QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY run_date DESC) = 1",
    "evaluations"))
def q_model_metric_matrix(spark, sf):
    return rounded(hs.model_metric_matrix(fx.evaluations(spark, sf)))


@register("score_quartiles", with_ctes(f"""
SELECT model_version, round(min(metric_value), 6) AS q0, round(quantile_cont(metric_value, 0.25), 6) AS q1,
       round(quantile_cont(metric_value, 0.5), 6) AS q2, round(quantile_cont(metric_value, 0.75), 6) AS q3,
       round(max(metric_value), 6) AS q4, CAST(count(metric_value) AS BIGINT) AS n
FROM metrics_long WHERE metric_name = 'share_over_50' GROUP BY 1""", "metrics_long"))
def q_score_quartiles(spark, sf):
    return rounded(hs.score_quartiles(_long(spark, sf), "share_over_50"))
