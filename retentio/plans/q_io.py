"""Registered I/O round trips: each writes derived data to the shared scratch folder and
answers from what it reads back, so the stores and readers are checked by the same oracles
as the in-memory operators."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from retentio.ml import train as tr
from retentio.operators import evaluation as ev
from retentio.operators import risk as rk
from retentio.operators.features import add_features
from retentio.operators.split import stratified_split
from retentio.plans import q_eval, q_features, q_history, q_risk, reports
from retentio.plans.oracle import with_ctes
from retentio.plans.queries import ORACLES, register, rounded
from retentio.session import scratch_path
from retentio.sources import fixtures as fx
from retentio.sources import tables as tb
from retentio.sources.history import MetricsHistory, RiskHistory
from retentio.sources.json_array import write_json_arrays


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("risk_store_summary", ORACLES["risk_summary"])
def q_risk_store_summary(spark, sf):
    store = RiskHistory(spark, _scratch(spark, "risk-history"))
    store.write_all(fx.risk_history(spark, sf))
    return rounded(store.summary())


@register("risk_store_changes", ORACLES["risk_changes"])
def q_risk_store_changes(spark, sf):
    store = RiskHistory(spark, _scratch(spark, "risk-history"))
    store.write_all(fx.risk_history(spark, sf))
    return rounded(store.changes(q_risk.DATE_BEFORE, q_risk.DATE_AFTER))


@register("metrics_store_roundtrip", ORACLES["explode_metrics"])
def q_metrics_store_roundtrip(spark, sf):
    store = MetricsHistory(spark, _scratch(spark, "metrics-history"))
    store.append_entries(fx.metric_entries(spark, sf))
    lg = store.long()
    return rounded(lg.select("timestamp", "model_version", "metric_name", "metric_value",
                             F.element_at("dataset_info", F.lit("size")).cast("bigint").alias("dataset_size")))


@register("csv_roundtrip", ORACLES["add_features"])
def q_csv_roundtrip(spark, sf):
    path = _scratch(spark, "students") + ".csv"
    tb.write_table(fx.students(spark, sf), path, sep=";")
    schema = fx.students(spark, sf).schema
    return rounded(add_features(tb.read_table(spark, path, schema)))


# the oracles reused above are registered by these modules
_ = (q_eval, q_features, q_history)


@register("json_students_roundtrip", ORACLES["add_features"])
def q_json_students_roundtrip(spark, sf):
    """Students exported as JSON lines and loaded back with ``read_students`` (validated rows)."""
    students = fx.students(spark, sf)
    path = _scratch(spark, "students") + ".json"
    tb.write_table(students, path)
    ok, _bad = tb.read_students(spark, path, schema=students.schema)
    return rounded(add_features(ok))


@register("report_bundle_roundtrip", ORACLES["risk_level_counts"])
def q_report_bundle_roundtrip(spark, sf):
    """Risk report of one assessment exported as a Parquet bundle; level counts read back."""
    a = rk.assessment(fx.risk_history(spark, sf), q_risk.DATE_AFTER)
    root = _scratch(spark, "risk-report")
    paths = tb.write_bundle(reports.risk_report(a), root)
    back = spark.read.parquet(next(p for p in paths if p.endswith("level_counts")))
    return rounded(back)


@register("evaluation_roundtrip", ORACLES["roc_curve"])
def q_evaluation_roundtrip(spark, sf):
    """Evaluation tables saved as JSON lines; the ROC curve read back with its schema.

    The per-score table is persisted once and shared by the four score-based tables, so
    the scored rows are scanned once for all curves and areas.
    """
    scored = fx.scored_labels(spark, sf)
    counts = ev.score_counts(scored).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frames = reports.evaluation_frames(scored, counts=counts)
        root = _scratch(spark, "evaluation")
        tb.write_evaluation(frames, root)
        schema = frames["roc_curve"].schema
    finally:
        counts.unpersist()
    back = spark.read.schema(schema).json(f"{root}/{tb.bundle_name('roc_curve')}")
    return rounded(back)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """A fitted pipeline saved to the shared folder, loaded back and used to score every student."""
    d = tr.prepare(fx.students(spark, sf))
    d = stratified_split(d, "label", "student_id", 0.2, 42, exact=True)
    fitted = tr.fit_pipeline(d.filter(F.col("split") == "train"), "decision_tree")
    path = _scratch(spark, "model")
    tr.save_model(fitted, path, "decision_tree")
    loaded, _meta = tr.load_model(path)
    return tr.score_students(loaded, fx.students(spark, sf))


# --- store semantics, validation and dialects ------------------------------------------------------
_HALVED = (f"SELECT assessment_date, student_id, CASE WHEN assessment_date = DATE '{q_risk.DATE_AFTER}' THEN dropout_probability * 0.5 "
           "ELSE dropout_probability END AS p FROM risk_history")


@register("risk_store_upsert", with_ctes(f"""
SELECT assessment_date, count(*) AS n_students, round(avg(p), 6) AS mean_risk, count_if(p > 0.25) AS n_over
FROM ({_HALVED}) h GROUP BY 1""", "risk_history"))
def q_risk_store_upsert(spark, sf):
    """A stored history in which one date is written again (and another one twice with the same rows)."""
    history = fx.risk_history(spark, sf)
    store = RiskHistory(spark, _scratch(spark, "risk-history"))
    store.write_all(history)
    again = rk.assessment(history, q_risk.DATE_AFTER).withColumn("dropout_probability", F.col("dropout_probability") * 0.5)
    store.upsert(again, q_risk.DATE_AFTER, "halved")
    store.upsert(rk.assessment(history, q_risk.DATE_BEFORE), q_risk.DATE_BEFORE, "same")
    p = F.col("dropout_probability")
    return rounded(store.read().groupBy("assessment_date").agg(F.count(F.lit(1)).alias("n_students"), F.avg(p).alias("mean_risk"),
                                                               F.count_if(p > 0.25).alias("n_over")))


@register("risk_store_get", with_ctes(f"""
SELECT student_id, round(dropout_probability, 6) AS dropout_probability, risk_level FROM risk_history
WHERE assessment_date = DATE '{q_risk.DATE_BEFORE}'""", "risk_history"))
def q_risk_store_get(spark, sf):
    """One assessment of a stored history; an emptied date and a missing date add nothing."""
    history = fx.risk_history(spark, sf)
    store = RiskHistory(spark, _scratch(spark, "risk-history"))
    store.write_all(history)
    store.upsert(history.limit(0), q_risk.DATE_AFTER, "none")
    cols = ["student_id", "dropout_probability", "risk_level"]
    found = store.get(q_risk.DATE_BEFORE).select(*cols)
    for day in (q_risk.DATE_AFTER, "1999-01-01"):
        found = found.unionByName(store.get(day).select(*cols))
    return rounded(found)


@register("risk_changes_null_ids", with_ctes(f"""
SELECT b.student_id, round(a.dropout_probability - b.dropout_probability, 6) AS risk_change
FROM (SELECT * FROM risk_history WHERE assessment_date = DATE '{q_risk.DATE_BEFORE}' AND student_id NOT LIKE '%7') b
JOIN (SELECT * FROM risk_history WHERE assessment_date = DATE '{q_risk.DATE_AFTER}' AND student_id NOT LIKE '%7') a USING (student_id)""",
                                           "risk_history"))
def q_risk_changes_null_ids(spark, sf):
    """Changes of a history in which some students have lost their id: a null id matches nobody."""
    lost = fx.risk_history(spark, sf).withColumn("student_id", F.when(~F.col("student_id").endswith("7"), F.col("student_id")))
    return rounded(rk.risk_changes(lost, q_risk.DATE_BEFORE, q_risk.DATE_AFTER).select("student_id", "risk_change"))


_NUMBER = "CAST(substr(student_id, 2) AS BIGINT)"


@register("read_students_rejects", with_ctes(f"""
SELECT CASE WHEN {_NUMBER} % 17 = 0 THEN 'null student_id'
            WHEN {_NUMBER} % 7 = 0 OR {_NUMBER} % 11 = 0 OR {_NUMBER} % 13 = 0 THEN 'bad target' ELSE 'ok' END AS reason,
       count(*) AS n FROM students GROUP BY 1""", "students"))
def q_read_students_rejects(spark, sf):
    """Students as CSV with lost ids and with fractions, texts and blanks as targets: rows by verdict."""
    s = fx.students(spark, sf)
    n = F.substring("student_id", 2, 20).cast("long")
    target = (F.when(n % 7 == 0, F.lit("0.7")).when(n % 11 == 0, F.lit("yes")).when(n % 13 == 0, F.lit(None).cast("string"))
              .otherwise(F.col("dropout").cast("string")))
    path = _scratch(spark, "students") + ".csv"
    tb.write_table(s.select(F.when(n % 17 != 0, F.col("student_id")).alias("student_id"), "age", target.alias("dropout")), path)
    ok, bad = tb.read_students(spark, path, schema="student_id string, age int, dropout string")
    both = ok.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("csv_dialects", with_ctes("""
SELECT student_id, CASE WHEN faculty IS NULL THEN NULL ELSE 'Факультет; ' || faculty END AS faculty, age FROM students""", "students"))
def q_csv_dialects(spark, sf):
    """Students in one directory of two dialects, cp1251 with ``;`` and UTF-8 with ``,``: read back as one table."""
    s = fx.students(spark, sf).select("student_id", F.concat(F.lit("Факультет; "), "faculty").alias("faculty"), "age")
    path = _scratch(spark, "students") + ".csv"
    odd = F.substring("student_id", -1, 1).isin(*"13579")
    upper = bytes(b for b in range(128, 256) if chr(b) != tb.CP1251_UNDEFINED)
    bytewise = F.translate("faculty", upper.decode("cp1251"), upper.decode("latin1"))  # one byte per letter
    (s.filter(odd).withColumn("faculty", bytewise).write.option("header", True).option("sep", ";")
     .option("encoding", "ISO-8859-1").csv(path))
    s.filter(~odd).write.mode("append").option("header", True).csv(path)
    return tb.read_table(spark, path, schema="student_id string, faculty string, age int")


_NOTE = "'He said \"' || coalesce(faculty, 'none') || '\", ok; two' || chr(10) || 'lines, of ' || student_id || '\t'"
_LONG = 199


def _with_notes(students, *columns):
    """Ids, some columns, and notes of quotes, separators and line breaks; some are 1 MB long."""
    n = F.substring("student_id", 2, 20).cast("long")
    note = F.concat(F.lit('He said "'), F.coalesce("faculty", F.lit("none")), F.lit('", ok; two\nlines, of '), "student_id", F.lit("\t"))
    times = F.when(n % _LONG == 0, 20000).otherwise(1)
    return students.select("student_id", *columns, note.alias("note"), times.alias("times")).select("student_id", *columns, F.expr("repeat(note, times)").alias("note"))


@register("csv_quoted", with_ctes(f"""
SELECT student_id, age, length(note) AS note_length, md5(note) AS note_md5
FROM (SELECT student_id, age, repeat({_NOTE}, CASE WHEN {_NUMBER} % {_LONG} = 0 THEN 20000 ELSE 1 END) AS note FROM students) s""", "students"))
def q_csv_quoted(spark, sf):
    """Students with notes of doubled quotes, separators and line breaks, some of 1 MB, written as CSV and read back.

    A file of a few MB is read by several tasks, and a long note crosses their ends.
    """
    s = _with_notes(fx.students(spark, sf), "age")
    path = _scratch(spark, "students") + ".csv"
    tb.write_table(s, path)
    back = tb.read_table(spark, path, schema="student_id string, age int, note string")
    return back.select("student_id", "age", F.length("note").cast("long").alias("note_length"), F.md5(F.col("note").cast("binary")).alias("note_md5"))


@register("json_array_roundtrip", with_ctes(f"""
SELECT student_id, round(gpa, 6) AS gpa, CAST(age AS BIGINT) AS age, length(note) AS note_length, md5(note) AS note_md5
FROM (SELECT student_id, gpa, age, '{{ "' || repeat({_NOTE}, CASE WHEN {_NUMBER} % {_LONG} = 0 THEN 20000 ELSE 1 END) || '}}, [' AS note FROM students) s""", "students"))
def q_json_array_roundtrip(spark, sf):
    """Students with notes that hold quotes and braces, written as JSON arrays and read back; types are inferred, files are read by several tasks."""
    s = _with_notes(fx.students(spark, sf), "age", "gpa").withColumn("note", F.concat(F.lit('{ "'), "note", F.lit("}, [")))
    path = _scratch(spark, "students") + ".json"
    write_json_arrays(s, path)
    note = F.col("note")
    return rounded(tb.read_table(spark, path).select("student_id", "gpa", "age", F.length(note).cast("long").alias("note_length"),
                                                     F.md5(note.cast("binary")).alias("note_md5")))


@register("risk_store_dates", with_ctes("SELECT DISTINCT assessment_date FROM risk_history", "risk_history"))
def q_risk_store_dates(spark, sf):
    """Dates of a stored history, from its directories alone."""
    store = RiskHistory(spark, _scratch(spark, "risk-history"))
    store.write_all(fx.risk_history(spark, sf))
    return store.dates()
