"""Risk-table operators: levels, counts, summaries, changes between two assessments.

A *risk table* has ``student_id``, ``dropout_probability`` and usually ``risk_level``; a
*risk history* adds ``assessment_date``, ``model_version`` and ``notes`` (one row per
student and date, enforced by :class:`retentio.sources.history.RiskHistory`).

Scale notes: every operator is one scan with at most one shuffle on ``student_id``;
zero-filled tables (levels, categories) come out of a single global aggregate with one
conditional count per label, so there is no join onto a label table and no skew from a
hot level. Top-k lists use ``orderBy().limit()`` (per-partition top-k, then a merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.bins import (
    CHANGE_CATEGORIES,
    CHANGE_CLASSES,
    EXTREME_RISK,
    RISK_LEVELS,
    change_category,
    change_class3,
    clean_double,
    risk_level,
    risk_rank,
)

P = "dropout_probability"
DATE = "assessment_date"


def with_risk_level(df: DataFrame, prob: str = P, out: str = "risk_level",
                    labels: Sequence[str] = RISK_LEVELS, include_lowest: bool = False) -> DataFrame:
    return df.withColumn(out, risk_level(prob, labels, include_lowest))


def _labelled_counts(df: DataFrame, key: Column, labels: Sequence[str], name: str,
                     rank_name: str, count_name: str = "n_students") -> DataFrame:
    """Zero-filled count per label plus % of *all* rows (null keys included in the total)."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(key == F.lit(lab)).alias(f"_n{i}") for i, lab in enumerate(labels)]
    row = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(i + 1).alias(rank_name), F.lit(lab).alias(name), F.col(f"_n{i}").alias(count_name))
                      for i, lab in enumerate(labels)])
    out = row.select(F.inline(cells), F.col("_total"))
    return out.select(
        rank_name, name, count_name,
        (F.try_divide(F.col(count_name) * F.lit(100.0), F.col("_total"))).alias("pct"),
    )


def risk_level_counts(risks: DataFrame, level: str = "risk_level", labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    """Count and percentage per risk level; empty levels are kept with 0.

    The percentage divides by all rows, so rows without a level make the sum < 100.
    """
    return _labelled_counts(risks, F.col(level), labels, "risk_level", "risk_rank")


def risk_change_stats(changes: DataFrame, category: str = "change_category",
                      labels: Sequence[str] = CHANGE_CATEGORIES) -> DataFrame:
    """Zero-filled count per five-way change category."""
    return _labelled_counts(changes, F.col(category), labels, "change_category", "category_rank")


def high_risk(risks: DataFrame, level: str = "risk_level", labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    """Students whose level is high, most at risk first (ties by student id)."""
    return risks.filter(F.col(level) == F.lit(labels[2])).orderBy(F.desc(P), F.asc("student_id"))


def medium_risk(risks: DataFrame, level: str = "risk_level", labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    return risks.filter(F.col(level) == F.lit(labels[1])).orderBy(F.desc(P), F.asc("student_id"))


def extreme_risk(risks: DataFrame, threshold: float = EXTREME_RISK) -> DataFrame:
    """Students with probability >= threshold (0.8 by default)."""
    return risks.filter(clean_double(P) >= F.lit(threshold)).orderBy(F.desc(P), F.asc("student_id"))


def above_threshold(risks: DataFrame, threshold: float = 0.5) -> DataFrame:
    return risks.filter(clean_double(P) >= F.lit(threshold))


def latest_date(history: DataFrame, model_version: str | None = None) -> Column:
    """Scalar subquery: the latest assessment date (of one model when given)."""
    h = history if model_version is None else history.filter(F.col("model_version") == F.lit(model_version))
    return h.agg(F.max(DATE)).scalar()


def assessment(history: DataFrame, date=None, model_version: str | None = None) -> DataFrame:
    """Rows of one assessment; the latest one when ``date`` is None. Missing date -> empty."""
    if date is None:
        return history.filter(F.col(DATE) == latest_date(history, model_version))
    return history.filter(F.col(DATE) == F.lit(date).cast("date"))


def risk_summary(history: DataFrame, date=None, labels: Sequence[str] = RISK_LEVELS,
                 extreme: float = EXTREME_RISK) -> DataFrame:
    """One-row summary of an assessment: totals, level counts and %, mean, extreme count."""
    a = assessment(history, date)
    p = clean_double(P)
    lv = F.col("risk_level")
    aggs = [F.max(DATE).alias(DATE), F.count(F.lit(1)).alias("total_students")]
    names = ("low", "medium", "high")
    aggs += [F.count_if(lv == F.lit(lab)).alias(f"n_{nm}") for nm, lab in zip(names, labels)]
    aggs += [F.avg(p).alias("mean_risk"), F.count_if(p >= F.lit(extreme)).alias("extreme_risk_count"),
             F.min("model_version").alias("model_version"), F.min("notes").alias("notes")]
    row = a.agg(*aggs).filter(F.col("total_students") > 0)
    pcts = [(F.col(f"n_{nm}") * F.lit(100.0) / F.col("total_students")).alias(f"pct_{nm}") for nm in names]
    return row.select(DATE, "total_students", *[f"n_{nm}" for nm in names], *pcts,
                      "mean_risk", "extreme_risk_count", "model_version", "notes")


def _paired(history: DataFrame, date_before, date_after, labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    """One row per student seen on either date with its before/after values.

    This is the before/after self-join expressed as one aggregation on ``student_id``:
    a single scan of both dates and a single shuffle (with map-side partial aggregation),
    instead of two scans and two shuffles. It relies on one row per (date, student).
    Levels travel as their integer rank so every aggregate buffer is fixed-width and the
    plan stays a code-generated hash aggregate (a string max would force sort-based
    aggregation); levels outside ``labels`` come back as null.
    """
    d1 = F.lit(date_before).cast("date")
    d2 = F.lit(date_after).cast("date")
    d = F.col(DATE)
    # a null id is no student: it matches nobody, as in a join
    h = history.filter(d.isin(d1, d2) & F.col("student_id").isNotNull())
    p = clean_double(P)
    rank = risk_rank(F.col("risk_level"), labels)
    g = h.groupBy("student_id").agg(
        F.max((d == d1).cast("int")).alias("_has_before"),
        F.max((d == d2).cast("int")).alias("_has_after"),
        F.max(F.when(d == d1, p)).alias("dropout_probability_before"),
        F.max(F.when(d == d1, rank)).alias("_rank_before"),
        F.max(F.when(d == d2, p)).alias("dropout_probability_after"),
        F.max(F.when(d == d2, rank)).alias("_rank_after"),
    )
    lab = F.array(*[F.lit(x) for x in labels])
    return g.select("*", F.try_element_at(lab, F.col("_rank_before")).alias("risk_level_before"),
                    F.try_element_at(lab, F.col("_rank_after")).alias("risk_level_after"))


def risk_changes(history: DataFrame, date_before, date_after, labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    """Matched students of two assessments with change and five-way category."""
    g = _paired(history, date_before, date_after, labels)
    g = g.filter((F.col("_has_before") == 1) & (F.col("_has_after") == 1))
    change = F.col("dropout_probability_after") - F.col("dropout_probability_before")
    return g.select(
        "student_id", "dropout_probability_before", "risk_level_before",
        "dropout_probability_after", "risk_level_after",
        change.alias("risk_change"), change_category(change).alias("change_category"),
    )


def risk_change_summary(history: DataFrame, date_before, date_after) -> DataFrame:
    """One row: matched count, means over each *full* assessment, their change, model versions.

    Means and versions come from one global aggregate over the two dates; the matched
    count is a scalar subquery over the per-student pairing (integer buffers only).
    """
    d1 = F.lit(date_before).cast("date")
    d2 = F.lit(date_after).cast("date")
    d = F.col(DATE)
    p = clean_double(P)
    g = _paired(history, date_before, date_after)
    matched = g.agg(F.count_if((F.col("_has_before") == 1) & (F.col("_has_after") == 1))).scalar()
    row = history.filter(d.isin(d1, d2)).agg(
        F.avg(F.when(d == d1, p)).alias("mean_risk_before"),
        F.avg(F.when(d == d2, p)).alias("mean_risk_after"),
        F.max(F.when(d == d1, F.col("model_version"))).alias("model_version_before"),
        F.max(F.when(d == d2, F.col("model_version"))).alias("model_version_after"),
        F.count_if(d == d1).alias("_b"), F.count_if(d == d2).alias("_a"),
    ).filter((F.col("_b") > 0) & (F.col("_a") > 0))
    return row.select(
        d1.alias("date_before"), d2.alias("date_after"), matched.alias("students_count"),
        "mean_risk_before", "mean_risk_after",
        (F.col("mean_risk_after") - F.col("mean_risk_before")).alias("mean_risk_change"),
        "model_version_before", "model_version_after",
    )


def top_changes(changes: DataFrame, n: int = 5, change: str = "risk_change", places: int | None = None) -> DataFrame:
    """The n most improved (most negative change first) and the n most deteriorated.

    ``places`` rounds the changes shown (3 in the reports); the order is that of the exact values.

    The deteriorated list is the tail of the ascending order, so its ``position`` runs from
    the least to the most worsened (worst last). Ties break on ``student_id``.
    """
    c = F.col(change)
    improved = changes.orderBy(c.asc(), F.col("student_id").asc()).limit(n)
    worst = changes.orderBy(c.desc(), F.col("student_id").desc()).limit(n)
    cols = ["student_id", change]
    imp = improved.select(*cols).withColumn("direction", F.lit("improved"))
    det = worst.select(*cols).withColumn("direction", F.lit("deteriorated"))
    both = imp.unionByName(det)
    # positions over at most 2n rows
    from pyspark.sql import Window

    w = Window.partitionBy("direction").orderBy(c.asc(), F.col("student_id").asc())
    shown = c if places is None else F.round(c, places)
    return both.withColumn("position", F.row_number().over(w)).select("direction", "position", "student_id", shown.alias(change))


def comparative_frames(before: DataFrame, after: DataFrame, top_n: int = 10,
                       labels: Sequence[str] = CHANGE_CLASSES) -> dict[str, DataFrame]:
    """Data of the comparative report between two risk tables (matched students only).

    Returns ``matched`` (per student), ``summary`` (one row: counts and % per three-way
    class, means over matched students and their change), ``class_counts``,
    ``top_improved`` and ``top_worsened`` (worst first).
    """
    b = before.select("student_id", clean_double(P).alias("dropout_probability_before"),
                      F.col("risk_level").alias("risk_level_before"))
    a = after.select("student_id", clean_double(P).alias("dropout_probability_after"),
                     F.col("risk_level").alias("risk_level_after"))
    m = b.join(a, "student_id", "inner")
    ch = F.col("dropout_probability_after") - F.col("dropout_probability_before")
    m = m.withColumn("change", ch).withColumn("change_class", change_class3(ch, labels))
    cls = F.col("change_class")
    summary = m.agg(
        F.count(F.lit(1)).alias("total_students"),
        F.count_if(cls == F.lit(labels[0])).alias("improved_count"),
        F.count_if(cls == F.lit(labels[1])).alias("unchanged_count"),
        F.count_if(cls == F.lit(labels[2])).alias("worsened_count"),
        F.avg("dropout_probability_before").alias("mean_before"),
        F.avg("dropout_probability_after").alias("mean_after"),
    )
    t = F.col("total_students")
    summary = summary.select(
        "*",
        F.try_divide(F.col("improved_count") * 100.0, t).alias("improved_pct"),
        F.try_divide(F.col("unchanged_count") * 100.0, t).alias("unchanged_pct"),
        F.try_divide(F.col("worsened_count") * 100.0, t).alias("worsened_pct"),
        (F.col("mean_after") - F.col("mean_before")).alias("mean_change"),
    )
    class_counts = _labelled_counts(m, cls, labels, "change_class", "class_rank")
    top_improved = m.orderBy(F.col("change").asc(), F.col("student_id").asc()).limit(top_n)
    top_worsened = m.orderBy(F.col("change").desc(), F.col("student_id").desc()).limit(top_n)
    return {"matched": m, "summary": summary, "class_counts": class_counts,
            "top_improved": top_improved, "top_worsened": top_worsened}


def ensure_student_id(df: DataFrame, row_id: str, prefix: str = "Student_") -> DataFrame:
    """Fill a missing ``student_id`` from a caller-named unique row-id column."""
    sid = F.concat(F.lit(prefix), F.col(row_id).cast("string"))
    if "student_id" in df.columns:
        return df.withColumn("student_id", F.coalesce(F.col("student_id").cast("string"), sid))
    return df.withColumn("student_id", sid)
