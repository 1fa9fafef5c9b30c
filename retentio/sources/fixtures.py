"""Views that re-shape the generated test tables into the engine's inputs.

Each view is a lazy DataFrame over the parquet tables, so its work grows with them:

* ``students``        customer + per-customer order counts -> one row per student
* ``risk_history``    events -> weekly risk assessments (one row per student and week)
* ``metric_entries``  events -> metric-history documents, one per (day, event type)
* ``evaluations``     events -> per-run evaluation rows with optional (null) metrics
* ``scored_labels``   labels -> (y_true, score, y_pred)
* ``vectors``         embeddings -> ML vectors with a binary label
* ``links``           pages -> URL column
* ``importance``      five literal feature importances (a model output, not data)

The DuckDB form of every view is in :mod:`retentio.plans.oracle` with the same arithmetic.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.bins import risk_level

# --- fixed values of the fixture definitions ---------------------------------------------
RISK_EVENT_TYPES = ("error", "signup")
ODD_WEEK_MODEL = "random_forest"
EVEN_WEEK_MODEL = "gradient_boosting"
IMPORTANCE = (("absences", 0.30), ("gpa", 0.25), ("age", 0.20), ("credits", 0.15), ("total_classes", 0.10))
# -------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    status = F.col("o_orderstatus")
    # pre-aggregate orders per customer (map-side partial aggregation) before the join
    per = (table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
           .groupBy("o_custkey")
           .agg(F.count(F.lit(1)).alias("n_orders"),
                F.count_if(status == "P").alias("n_p"),
                F.count_if(status == "F").alias("n_f"),
                F.count_if(status == "O").alias("n_o")))
    j = c.join(per, c.c_custkey == per.o_custkey, "left")
    k = F.col("c_custkey")
    return j.select(
        F.format_string("S%05d", k).alias("student_id"),
        (F.lit(16) + k % 20).cast("int").alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        F.when(k % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(2.0) + F.lit(3.0) * (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("gpa"),
        ((k * 7) % 240).cast("int").alias("credits"),
        F.coalesce(F.col("n_p"), F.lit(0)).cast("int").alias("absences"),
        F.when(k % 101 == 0, F.lit(0)).otherwise(F.coalesce(F.col("n_orders"), F.lit(0))).cast("int")
         .alias("total_classes"),
        (k % 5 == 0).cast("int").alias("scholarship"),
        (k % 10 < 3).cast("int").alias("employment"),
        (F.lit(1) + k % 4).cast("int").alias("year_of_study"),
        F.when(k % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("faculty"),
        (F.coalesce(F.col("n_f"), F.lit(0)) > F.coalesce(F.col("n_o"), F.lit(0))).cast("int").alias("dropout"),
    )


def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly assessments: p = share of error/signup events of the user in that week."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    g = (e.groupBy(F.date_trunc("week", "ts").cast("date").alias("assessment_date"), "user_id")
         .agg(F.count_if(F.col("event_type").isin(*RISK_EVENT_TYPES)).alias("k"), F.count(F.lit(1)).alias("n")))
    p = (F.col("k") / F.col("n")).cast("double")
    d = F.col("assessment_date")
    return g.select(
        d,
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("student_id"),
        p.alias("dropout_probability"),
        (p >= 0.5).cast("int").alias("prediction"),
        risk_level(p).alias("risk_level"),
        F.when(F.weekofyear(d) % 2 == 1, F.lit(ODD_WEEK_MODEL)).otherwise(F.lit(EVEN_WEEK_MODEL)).alias("model_version"),
        F.lit(None).cast("string").alias("notes"),
    )


def _daily_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    v = F.col("value")
    return (e.groupBy(F.to_date("ts").alias("day"), "event_type")
            .agg(F.min("ts").alias("timestamp"),
                 F.count(F.lit(1)).alias("n"),
                 F.avg(v).alias("mean_value"),
                 F.max(v).alias("max_value"),
                 (F.count_if(v > 50) / F.count(F.lit(1))).alias("share_over_50"),
                 (F.count_if(v > 10) / F.count(F.lit(1))).alias("share_over_10"),
                 (F.count_if(v > 100) / F.count(F.lit(1))).alias("share_over_100")))


def metric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric-history documents: (timestamp, model_version, metrics map, dataset_info map).

    Metric values are strings (the map holds mixed scalar and nested values); ``nested``
    is a JSON array text that numeric-only readers must skip.
    """
    s = _daily_event_stats(spark, sf_dir)
    n = F.col("n").cast("string")
    metrics = F.create_map(
        F.lit("mean_value"), F.round("mean_value", 6).cast("string"),
        F.lit("share_over_50"), F.round("share_over_50", 6).cast("string"),
        F.lit("n"), n,
        F.lit("nested"), F.concat(F.lit("[["), n, F.lit(",0],[0,"), n, F.lit("]]")),
    )
    info = F.create_map(F.lit("size"), n, F.lit("target_column"), F.lit("event_type"))
    return s.select(F.col("timestamp"), F.col("event_type").alias("model_version"),
                    metrics.alias("metrics"), info.alias("dataset_info"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows (model_name, accuracy, precision, recall, f1_score); some are null."""
    s = _daily_event_stats(spark, sf_dir)
    dom = F.dayofmonth("day")
    return s.select(
        F.col("event_type").alias("model_name"),
        F.col("day").alias("run_date"),
        F.col("share_over_50").alias("accuracy"),
        F.col("share_over_10").alias("precision"),
        F.when(dom % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("share_over_100")).alias("recall"),
        F.when(dom % 5 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("mean_value") / F.col("max_value")).alias("f1_score"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    score = ((F.col("doc_id") * 37 % 70) + F.lit(30) * q) / F.lit(100.0)
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id"),
        q.cast("int").alias("y_true"),
        score.cast("double").alias("score"),
        (score >= 0.5).cast("int").alias("y_pred"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        (F.col("label") < 5).cast("int").alias("label"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def importance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(IMPORTANCE), "feature string, importance double")
