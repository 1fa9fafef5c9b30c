import os

from pyspark.sql import functions as F

from retentio.ml import train as tr
from retentio.sources.history import RiskHistory
from retentio.sources.tables import synthetic_students
from retentio.streaming import score_stream, store_scores


def test_stream_scores_are_stored_as_assessment(spark, tmp):
    students = synthetic_students(spark, 200, 11)
    model = tr.fit_pipeline(tr.prepare(students), "decision_tree")
    src = os.path.join(tmp, "in")
    students.write.parquet(src)
    stream = spark.readStream.schema(students.schema).parquet(src)
    scored = score_stream(model, stream)
    assert scored.isStreaming
    hist = RiskHistory(spark, os.path.join(tmp, "risk"))
    q = store_scores(scored, hist, "dt_v1", os.path.join(tmp, "ckpt"))
    q.awaitTermination(120)
    got = hist.read()
    assert got.count() == 200 and got.filter(F.col("model_version") == "dt_v1").count() == 200


def test_batches_of_one_day_add_up(spark, tmp):
    src = os.path.join(tmp, "in")
    rows = synthetic_students(spark, 30, 5).select("student_id", F.lit(0.4).alias("dropout_probability"))
    rows.repartition(3).write.parquet(src)
    hist = RiskHistory(spark, os.path.join(tmp, "risk"))
    for attempt in ("a", "b"):  # the second stream delivers everything again
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        store_scores(stream, hist, "m", os.path.join(tmp, attempt)).awaitTermination(120)
        assert hist.read().count() == 30


def test_batches_with_lost_ids_add_up(spark, tmp):
    src = os.path.join(tmp, "in")
    rows = synthetic_students(spark, 30, 5).select(F.expr("case when student_id not like '%7' then student_id end").alias("student_id"),
                                                   F.lit(0.4).alias("dropout_probability")).union(spark.sql("select null, 0.4D from range(6)"))
    rows.repartition(3).write.parquet(src)
    hist = RiskHistory(spark, os.path.join(tmp, "risk"))
    for attempt in ("a", "b"):  # the second stream delivers everything again
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        store_scores(stream, hist, "m", os.path.join(tmp, attempt)).awaitTermination(120)
        assert hist.read().count() == 36
