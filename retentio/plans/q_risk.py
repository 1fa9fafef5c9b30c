"""Registered risk queries (levels, counts, summaries, changes, reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions.bins import CHANGE_CATEGORIES, CHANGE_CLASSES, RISK_LEVELS
from retentio.operators import risk as rk
from retentio.plans.oracle import change_category_sql, change_class3_sql, q, risk_level_sql, with_ctes
from retentio.plans.queries import DATE_AFTER, DATE_BEFORE, register, rounded
from retentio.sources import fixtures as fx


def _levels_values(labels, rank_name, name):
    return ", ".join(f"({i + 1}, {q(lab)})" for i, lab in enumerate(labels))


# --- risk_level -------------------------------------------------------------------------
@register("risk_level", with_ctes(f"""
SELECT assessment_date, student_id, round(dropout_probability, 6) AS dropout_probability,
       {risk_level_sql('dropout_probability')} AS risk_level
FROM risk_history""", "risk_history"))
def q_risk_level(spark, sf):
    h = fx.risk_history(spark, sf).select("assessment_date", "student_id", "dropout_probability")
    return rounded(rk.with_risk_level(h))


# --- risk_level_counts (per assessment) ----------------------------------------------------
_LEVELS = _levels_values(RISK_LEVELS, "risk_rank", "risk_level")


@register("risk_level_counts", with_ctes(f"""
SELECT l.risk_rank, l.risk_level, CAST(count(h.risk_level) AS BIGINT) AS n_students,
       round(count(h.risk_level) * 100.0 / (SELECT count(*) FROM risk_history WHERE assessment_date = DATE '{DATE_AFTER}'), 6) AS pct
FROM (VALUES {_LEVELS}) l(risk_rank, risk_level)
LEFT JOIN (SELECT risk_level FROM risk_history WHERE assessment_date = DATE '{DATE_AFTER}') h
  ON h.risk_level = l.risk_level
GROUP BY 1, 2""", "risk_history"))
def q_risk_level_counts(spark, sf):
    a = rk.assessment(fx.risk_history(spark, sf), DATE_AFTER)
    return rounded(rk.risk_level_counts(a))


# --- high / medium / extreme lists over every assessment -------------------------------------
_LIST_COLS = "assessment_date, student_id, round(dropout_probability, 6) AS dropout_probability, risk_level"


@register("high_risk", with_ctes(f"SELECT {_LIST_COLS} FROM risk_history WHERE risk_level = {q(RISK_LEVELS[2])}",
                                 "risk_history"))
def q_high_risk(spark, sf):
    h = fx.risk_history(spark, sf).select("assessment_date", "student_id", "dropout_probability", "risk_level")
    return rounded(rk.high_risk(h))


@register("medium_risk", with_ctes(f"SELECT {_LIST_COLS} FROM risk_history WHERE risk_level = {q(RISK_LEVELS[1])}",
                                   "risk_history"))
def q_medium_risk(spark, sf):
    h = fx.risk_history(spark, sf).select("assessment_date", "student_id", "dropout_probability", "risk_level")
    return rounded(rk.medium_risk(h))


@register("extreme_risk", with_ctes(f"SELECT {_LIST_COLS} FROM risk_history WHERE dropout_probability >= 0.8",
                                    "risk_history"))
def q_extreme_risk(spark, sf):
    h = fx.risk_history(spark, sf).select("assessment_date", "student_id", "dropout_probability", "risk_level")
    return rounded(rk.extreme_risk(h))


# --- risk_summary (latest assessment) ---------------------------------------------------------
@register("risk_summary", with_ctes(f"""
SELECT assessment_date, CAST(count(*) AS BIGINT) AS total_students,
       CAST(count_if(risk_level = {q(RISK_LEVELS[0])}) AS BIGINT) AS n_low,
       CAST(count_if(risk_level = {q(RISK_LEVELS[1])}) AS BIGINT) AS n_medium,
       CAST(count_if(risk_level = {q(RISK_LEVELS[2])}) AS BIGINT) AS n_high,
       round(count_if(risk_level = {q(RISK_LEVELS[0])}) * 100.0 / count(*), 6) AS pct_low,
       round(count_if(risk_level = {q(RISK_LEVELS[1])}) * 100.0 / count(*), 6) AS pct_medium,
       round(count_if(risk_level = {q(RISK_LEVELS[2])}) * 100.0 / count(*), 6) AS pct_high,
       round(avg(dropout_probability), 6) AS mean_risk,
       CAST(count_if(dropout_probability >= 0.8) AS BIGINT) AS extreme_risk_count,
       min(model_version) AS model_version, min(notes) AS notes
FROM risk_history WHERE assessment_date = (SELECT max(assessment_date) FROM risk_history)
GROUP BY assessment_date""", "risk_history"))
def q_risk_summary(spark, sf):
    return rounded(rk.risk_summary(fx.risk_history(spark, sf)))


# --- change_category / change_class3 on the matched pairs --------------------------------------
_PAIRS = f"""
pairs AS (SELECT b.student_id, b.dropout_probability AS p_before, a.dropout_probability AS p_after,
                 b.risk_level AS risk_level_before, a.risk_level AS risk_level_after,
                 a.dropout_probability - b.dropout_probability AS risk_change
          FROM (SELECT * FROM risk_history WHERE assessment_date = DATE '{DATE_BEFORE}') b
          JOIN (SELECT * FROM risk_history WHERE assessment_date = DATE '{DATE_AFTER}') a
            ON a.student_id = b.student_id)"""


def _with_pairs(body: str) -> str:
    return with_ctes(", " + _PAIRS.strip() + "\n" + body, "risk_history").replace("\n, pairs", ",\npairs", 1)


@register("risk_changes", _with_pairs(f"""
SELECT student_id, round(p_before, 6) AS dropout_probability_before, risk_level_before,
       round(p_after, 6) AS dropout_probability_after, risk_level_after,
       round(risk_change, 6) AS risk_change, {change_category_sql('risk_change')} AS change_category
FROM pairs"""))
def q_risk_changes(spark, sf):
    return rounded(rk.risk_changes(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER))


@register("change_category", _with_pairs(f"""
SELECT student_id, round(risk_change, 6) AS risk_change, {change_category_sql('risk_change')} AS change_category
FROM pairs"""))
def q_change_category(spark, sf):
    from retentio.functions.bins import change_category

    c = rk.risk_changes(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER)
    return rounded(c.select("student_id", "risk_change", change_category("risk_change").alias("change_category")))


@register("change_class3", _with_pairs(f"""
SELECT student_id, round(risk_change, 6) AS risk_change, {change_class3_sql('risk_change')} AS change_class
FROM pairs"""))
def q_change_class3(spark, sf):
    from retentio.functions.bins import change_class3

    c = rk.risk_changes(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER)
    return rounded(c.select("student_id", "risk_change", change_class3("risk_change").alias("change_class")))


_CATS = _levels_values(CHANGE_CATEGORIES, "category_rank", "change_category")


@register("risk_change_stats", _with_pairs(f"""
SELECT l.category_rank, l.change_category, CAST(count(p.cat) AS BIGINT) AS n_students,
       round(count(p.cat) * 100.0 / (SELECT count(*) FROM pairs), 6) AS pct
FROM (VALUES {_CATS}) l(category_rank, change_category)
LEFT JOIN (SELECT {change_category_sql('risk_change')} AS cat FROM pairs) p ON p.cat = l.change_category
GROUP BY 1, 2"""))
def q_risk_change_stats(spark, sf):
    c = rk.risk_changes(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER)
    return rounded(rk.risk_change_stats(c))


@register("risk_change_summary", _with_pairs(f"""
SELECT DATE '{DATE_BEFORE}' AS date_before, DATE '{DATE_AFTER}' AS date_after,
       (SELECT CAST(count(*) AS BIGINT) FROM pairs) AS students_count,
       round(b.m, 6) AS mean_risk_before, round(a.m, 6) AS mean_risk_after, round(a.m - b.m, 6) AS mean_risk_change,
       b.v AS model_version_before, a.v AS model_version_after
FROM (SELECT avg(dropout_probability) AS m, max(model_version) AS v FROM risk_history WHERE assessment_date = DATE '{DATE_BEFORE}') b,
     (SELECT avg(dropout_probability) AS m, max(model_version) AS v FROM risk_history WHERE assessment_date = DATE '{DATE_AFTER}') a"""))
def q_risk_change_summary(spark, sf):
    return rounded(rk.risk_change_summary(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER))


def _top_sql(n: int, places: int) -> str:
    return f"""
SELECT direction, CAST(position AS INTEGER) AS position, student_id, round(risk_change, {places}) AS risk_change FROM (
  SELECT 'improved' AS direction, row_number() OVER (ORDER BY risk_change, student_id) AS position, student_id, risk_change
  FROM (SELECT * FROM pairs ORDER BY risk_change ASC, student_id ASC LIMIT {n}) i
  UNION ALL
  SELECT 'deteriorated', row_number() OVER (ORDER BY risk_change, student_id), student_id, risk_change
  FROM (SELECT * FROM pairs ORDER BY risk_change DESC, student_id DESC LIMIT {n}) d) t"""


@register("top_changes_shown", _with_pairs(_top_sql(10, 3)))
def q_top_changes_shown(spark, sf):
    """The ten largest changes either way as reports show them: three places, in the order of the exact values."""
    return rk.top_changes(rk.risk_changes(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER), 10, places=3)


@register("top_changes", _with_pairs(_top_sql(5, 6)))
def q_top_changes(spark, sf):
    c = rk.risk_changes(fx.risk_history(spark, sf), DATE_BEFORE, DATE_AFTER)
    return rounded(rk.top_changes(c, 5))


@register("comparative_report", _with_pairs(f"""
SELECT CAST(count(*) AS BIGINT) AS total_students,
       CAST(count_if(risk_change < -0.05) AS BIGINT) AS improved_count,
       CAST(count(*) - count_if(risk_change < -0.05) - count_if(risk_change > 0.05) AS BIGINT) AS unchanged_count,
       CAST(count_if(risk_change > 0.05) AS BIGINT) AS worsened_count,
       round(avg(p_before), 6) AS mean_before, round(avg(p_after), 6) AS mean_after,
       round(count_if(risk_change < -0.05) * 100.0 / count(*), 6) AS improved_pct,
       round((count(*) - count_if(risk_change < -0.05) - count_if(risk_change > 0.05)) * 100.0 / count(*), 6) AS unchanged_pct,
       round(count_if(risk_change > 0.05) * 100.0 / count(*), 6) AS worsened_pct,
       round(avg(p_after) - avg(p_before), 6) AS mean_change
FROM pairs"""))
def q_comparative_report(spark, sf):
    h = fx.risk_history(spark, sf)
    frames = rk.comparative_frames(rk.assessment(h, DATE_BEFORE), rk.assessment(h, DATE_AFTER))
    return rounded(frames["summary"])


@register("comparative_top", _with_pairs(f"""
SELECT list, student_id, round(risk_change, 6) AS change, {change_class3_sql('risk_change')} AS change_class FROM (
  SELECT 'improved' AS list, * FROM (SELECT * FROM pairs ORDER BY risk_change ASC, student_id ASC LIMIT 10) i
  UNION ALL
  SELECT 'worsened', * FROM (SELECT * FROM pairs ORDER BY risk_change DESC, student_id DESC LIMIT 10) w) t"""))
def q_comparative_top(spark, sf):
    h = fx.risk_history(spark, sf)
    fr = rk.comparative_frames(rk.assessment(h, DATE_BEFORE), rk.assessment(h, DATE_AFTER), top_n=10)
    cols = ["student_id", "change", "change_class"]
    out = (fr["top_improved"].select(F.lit("improved").alias("list"), *cols)
           .unionByName(fr["top_worsened"].select(F.lit("worsened").alias("list"), *cols)))
    return rounded(out)


@register("comparative_class_counts", _with_pairs(f"""
SELECT l.class_rank, l.change_class, CAST(count(p.c) AS BIGINT) AS n_students,
       round(count(p.c) * 100.0 / (SELECT count(*) FROM pairs), 6) AS pct
FROM (VALUES {_levels_values(CHANGE_CLASSES, 'class_rank', 'change_class')}) l(class_rank, change_class)
LEFT JOIN (SELECT {change_class3_sql('risk_change')} AS c FROM pairs) p ON p.c = l.change_class
GROUP BY 1, 2"""))
def q_comparative_class_counts(spark, sf):
    h = fx.risk_history(spark, sf)
    fr = rk.comparative_frames(rk.assessment(h, DATE_BEFORE), rk.assessment(h, DATE_AFTER))
    return rounded(fr["class_counts"])
