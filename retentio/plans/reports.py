"""Report datasets: each report is a ``dict[str, DataFrame]`` of lazy tables.

Rendering (HTML, charts) is out of scope; these are the tables behind each report and
can be exported with :func:`retentio.sources.tables.write_bundle`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.bins import EXTREME_RISK, RISK_EDGES
from retentio.operators import evaluation as ev
from retentio.operators import history as hs
from retentio.operators import risk as rk

TREND_REFERENCE_LINES = (RISK_EDGES[1], RISK_EDGES[2], EXTREME_RISK)


def risk_report(risks: DataFrame, model_info: Mapping | None = None, bins: int = 20) -> dict[str, DataFrame]:
    """Risk report tables: summary, level counts, probability histogram, high and medium lists."""
    info = dict(model_info or {})
    counts = rk.risk_level_counts(risks)
    totals = risks.agg(F.count(F.lit(1)).alias("total_students"))
    # the model information is a handful of given values: literals on the one-row total
    summary = totals.select("total_students", F.lit(info.get("model_name")).cast("string").alias("model_name"),
                            F.lit(info.get("accuracy")).cast("double").alias("accuracy"),
                            F.lit(info.get("f1")).cast("double").alias("f1"))
    return {
        "summary": summary,
        "level_counts": counts,
        "histogram": ev.probability_histogram(risks, "dropout_probability", bins),
        "high_risk": rk.high_risk(risks),
        "medium_risk": rk.medium_risk(risks),
    }


def comparative_report(before: DataFrame, after: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Comparative report tables between two risk tables (matched students)."""
    fr = rk.comparative_frames(before, after, top_n)
    return {k: fr[k] for k in ("summary", "class_counts", "top_improved", "top_worsened")}


def student_follow_up(history: DataFrame, students, start=None, end=None,
                      dates: Sequence | None = None) -> dict[str, DataFrame]:
    """History of chosen students in a period, and the student x date pivot (explicit dates)."""
    follow = hs.student_risk_history(history, students, start, end)
    out = {"history": follow}
    if dates:
        out["pivot"] = hs.risk_pivot(follow, dates)
    return out


def risk_trends(history: DataFrame, students) -> dict[str, DataFrame]:
    """Series per chosen student over all dates plus the level reference lines."""
    spark: SparkSession = history.sparkSession
    lines = spark.createDataFrame([(float(v),) for v in TREND_REFERENCE_LINES], "level double")
    return {"series": hs.student_risk_history(history, students), "reference_lines": lines}


def metric_trend_report(long: DataFrame, metric_name: str, model_versions=None, window: int = 1) -> dict[str, DataFrame]:
    return {"trend": hs.metric_trend(long, metric_name, model_versions, window)}


def evaluation_frames(pred: DataFrame, label: str = "y_true", prediction: str = "y_pred",
                      score: str | None = "score", counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The evaluation result as tables: metrics, confusion matrix, class report, curves, AUC, AP.

    The four score-based tables all derive from one per-distinct-score table
    (:func:`retentio.operators.evaluation.score_counts`). ``counts`` may pass it in
    precomputed (e.g. persisted by the caller, who then owns and releases it); otherwise it
    is built here and each table re-derives it with one scan of ``pred``.
    """
    out = {"metrics": ev.binary_metrics(pred, label, prediction),
           "confusion_matrix": ev.confusion_matrix(pred, label, prediction),
           "classification_report": ev.classification_report(pred, label, prediction)}
    if score:
        c = counts if counts is not None else ev.score_counts(pred, label, score)
        out.update({"roc_curve": ev.roc_curve_from_counts(c), "roc_auc": ev.roc_auc_from_counts(c),
                    "pr_curve": ev.pr_curve_from_counts(c),
                    "average_precision": ev.average_precision_from_counts(c)})
    return out


def model_diagnostics(model, data: DataFrame, model_name: str, target: str = "dropout",
                      key: str = "student_id", folds: int = 5) -> dict[str, DataFrame]:
    """Tables behind the all-in-one model chart: importances, confusion matrix, ROC, CV scores."""
    from retentio.ml import train as tr
    from retentio.ml.estimators import p1

    prepared = tr.prepare(data, target, key)
    pred = model.transform(prepared)
    scored = pred.select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"),
                         p1("probability").alias("score"))
    return {"feature_importance": tr.feature_importance(model, pred),
            "confusion_matrix": ev.confusion_matrix(scored),
            "roc_curve": ev.roc_curve(scored),
            "cv_scores": tr.cross_validate(prepared, model_name, folds, target, key)}

