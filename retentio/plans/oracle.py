"""DuckDB SQL for the test-data views and small SQL builders for the oracles.

Each fixture of :mod:`retentio.sources.fixtures` has a CTE here with the same arithmetic;
``with_ctes`` prefixes a query body with the CTEs it names (and their dependencies).
"""

from __future__ import annotations

from collections.abc import Sequence

from retentio.functions.bins import (
    AGE_EDGES,
    AGE_GROUPS,
    CHANGE_CATEGORIES,
    CHANGE_CLASSES,
    CHANGE_EDGES,
    RISK_EDGES,
    RISK_LEVELS,
)
from retentio.sources.fixtures import EVEN_WEEK_MODEL, IMPORTANCE, ODD_WEEK_MODEL, RISK_EVENT_TYPES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def bins_sql(expr: str, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> str:
    x = f"CASE WHEN isnan(CAST({expr} AS DOUBLE)) THEN NULL ELSE CAST({expr} AS DOUBLE) END"
    parts = []
    for i, lab in enumerate(labels):
        lo_op = ">=" if (include_lowest and i == 0) else ">"
        parts.append(f"WHEN {x} {lo_op} {d(edges[i])} AND {x} <= {d(edges[i + 1])} THEN {q(lab)}")
    return "CASE " + " ".join(parts) + " END"


def risk_level_sql(expr: str) -> str:
    return bins_sql(expr, RISK_EDGES, RISK_LEVELS)


def change_category_sql(expr: str) -> str:
    return bins_sql(expr, CHANGE_EDGES, CHANGE_CATEGORIES)


def change_class3_sql(expr: str) -> str:
    return (f"CASE WHEN {expr} < {d(-0.05)} THEN {q(CHANGE_CLASSES[0])} "
            f"WHEN {expr} > {d(0.05)} THEN {q(CHANGE_CLASSES[2])} ELSE {q(CHANGE_CLASSES[1])} END")


def age_group_sql(expr: str) -> str:
    return bins_sql(expr, AGE_EDGES, AGE_GROUPS)


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


_EVENT_TYPES = ", ".join(q(t) for t in RISK_EVENT_TYPES)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "students": ("""
SELECT printf('S%05d', c.c_custkey) AS student_id,
       CAST(16 + c.c_custkey % 20 AS INTEGER) AS age,
       CASE WHEN c.c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       CASE WHEN c.c_custkey % 97 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE CAST(2.0 AS DOUBLE) + CAST(3.0 AS DOUBLE) * (c.c_acctbal + CAST(1000.0 AS DOUBLE)) / CAST(11000.0 AS DOUBLE) END AS gpa,
       CAST((c.c_custkey * 7) % 240 AS INTEGER) AS credits,
       CAST(coalesce(o.n_p, 0) AS INTEGER) AS absences,
       CAST(CASE WHEN c.c_custkey % 101 = 0 THEN 0 ELSE coalesce(o.n_orders, 0) END AS INTEGER) AS total_classes,
       CAST(c.c_custkey % 5 = 0 AS INTEGER) AS scholarship,
       CAST(c.c_custkey % 10 < 3 AS INTEGER) AS employment,
       CAST(1 + c.c_custkey % 4 AS INTEGER) AS year_of_study,
       CASE WHEN c.c_custkey % 89 = 0 THEN CAST(NULL AS VARCHAR) ELSE c.c_mktsegment END AS faculty,
       CAST(coalesce(o.n_f, 0) > coalesce(o.n_o, 0) AS INTEGER) AS dropout
FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders,
                  count_if(o_orderstatus = 'P') AS n_p,
                  count_if(o_orderstatus = 'F') AS n_f,
                  count_if(o_orderstatus = 'O') AS n_o
           FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""", ()),
    "risk_history": (f"""
SELECT assessment_date, 'U' || CAST(user_id AS VARCHAR) AS student_id,
       p AS dropout_probability,
       CAST(p >= 0.5 AS INTEGER) AS prediction,
       {risk_level_sql('p')} AS risk_level,
       CASE WHEN weekofyear(assessment_date) % 2 = 1 THEN {q(ODD_WEEK_MODEL)} ELSE {q(EVEN_WEEK_MODEL)} END AS model_version,
       CAST(NULL AS VARCHAR) AS notes
FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS assessment_date, user_id,
             CAST(count_if(event_type IN ({_EVENT_TYPES})) AS DOUBLE) / count(*) AS p
      FROM events GROUP BY 1, 2) w""", ()),
    "daily_stats": ("""
SELECT CAST(ts AS DATE) AS day, event_type, min(ts) AS timestamp, count(*) AS n,
       avg(value) AS mean_value, max(value) AS max_value,
       CAST(count_if(value > 50) AS DOUBLE) / count(*) AS share_over_50,
       CAST(count_if(value > 10) AS DOUBLE) / count(*) AS share_over_10,
       CAST(count_if(value > 100) AS DOUBLE) / count(*) AS share_over_100
FROM events GROUP BY 1, 2""", ()),
    # long form of the metric documents after the numeric-only rule (nested is dropped)
    "metrics_long": ("""
SELECT timestamp, event_type AS model_version, m.metric_name, m.metric_value,
       CAST(n AS BIGINT) AS dataset_size, day
FROM daily_stats,
     (SELECT 'mean_value' AS metric_name, round(mean_value, 6) AS metric_value
      UNION ALL SELECT 'share_over_50', round(share_over_50, 6)
      UNION ALL SELECT 'n', CAST(n AS DOUBLE)) m""", ("daily_stats",)),
    "evaluations": ("""
SELECT event_type AS model_name, day AS run_date, share_over_50 AS accuracy, share_over_10 AS precision,
       CASE WHEN dayofmonth(day) % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE share_over_100 END AS recall,
       CASE WHEN dayofmonth(day) % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE mean_value / max_value END AS f1_score
FROM daily_stats""", ("daily_stats",)),
    "scored_labels": ("""
SELECT doc_id, CAST(quality AS INTEGER) AS y_true,
       CAST(((doc_id * 37 % 70) + 30 * quality) / 100.0 AS DOUBLE) AS score,
       CAST(((doc_id * 37 % 70) + 30 * quality) / 100.0 >= 0.5 AS INTEGER) AS y_pred
FROM labels""", ()),
    "vectors": ("""
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label < 5 AS INTEGER) AS label
FROM embeddings""", ()),
    "importance": ("SELECT * FROM (VALUES " + ", ".join(f"({q(f)}, {d(v)})" for f, v in IMPORTANCE)
                   + ") t(feature, importance)", ()),
}


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][1]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]}\n)" for n in order) + "\n" + body
