import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from retentio.sources import tables as tb
from retentio.sources.history import MetricsHistory, RiskHistory


def _write(path, text, enc="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(enc))
    return path


@pytest.mark.parametrize("sep,enc", [(",", "utf-8"), (";", "utf-8"), (";", "cp1251"), ("\t", "utf-8")])
def test_csv_dialects(spark, tmp, sep, enc):
    text = sep.join(["student_id", "faculty", "gpa"]) + "\n" + sep.join(["S1", "Право", "3.5"]) + "\n" \
        + sep.join(["S2", "Экономика", "4.0"]) + "\n"
    p = _write(os.path.join(tmp, "s.csv"), text, enc)
    df = tb.read_table(spark, p)
    assert df.columns == ["student_id", "faculty", "gpa"]
    assert sorted(r["faculty"] for r in df.collect()) == ["Право", "Экономика"]


def test_unknown_extension(spark, tmp):
    with pytest.raises(ValueError):
        tb.read_table(spark, os.path.join(tmp, "x.xyz"))
    assert tb.s3_path("bucket", "/dir/a.parquet") == "s3a://bucket/dir/a.parquet"


def test_json_and_write_roundtrip(spark, tmp):
    df = spark.createDataFrame([("S1", 0.4)], "student_id string, p double")
    tb.write_table(df, os.path.join(tmp, "out.csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmp, "out.csv"))
    assert back.count() == 1
    paths = tb.write_bundle({"a" * 40: df}, tmp, "json")
    assert os.path.basename(paths[0]) == "a" * 40


def test_bundle_names_never_share_a_directory(spark, tmp):
    df = spark.createDataFrame([("S1", 0.4)], "student_id string, p double")
    paths = tb.write_bundle({"Сводка": df, "Отчёт": df.select("p"), "a b": df}, tmp)
    assert [os.path.basename(p) for p in paths] == ["Сводка", "Отчёт", "a_b"]
    assert spark.read.parquet(paths[0]).columns == ["student_id", "p"] and spark.read.parquet(paths[1]).columns == ["p"]
    for names in (("a b", "a_b"), ("X", "x"), ("..",), ("",)):
        with pytest.raises(ValueError):
            tb.write_bundle({n: df for n in names}, os.path.join(tmp, "no"))
    assert not os.path.exists(os.path.join(tmp, "no"))


def _csv(tmp, name, rows, sep=",", enc="utf-8"):
    return _write(os.path.join(tmp, name), "".join(sep.join(r) + "\n" for r in rows), enc)


def test_csv_dialect_sees_the_whole_file(spark, tmp):
    rows = [["student_id", "faculty"], *([f"S{i}", "Law"] for i in range(200)), ["S200", "Право"]]
    df = tb.read_table(spark, _csv(tmp, "late.csv", rows, ";", "cp1251"))
    assert [r["faculty"] for r in df.filter("student_id = 'S200'").collect()] == ["Право"]


def test_csv_separator_between_quotes_does_not_count(spark, tmp):
    df = tb.read_table(spark, _write(os.path.join(tmp, "q.csv"), 'student_id;name\nS1;"a,b,c"\nS2;"x;y"\n'))
    assert df.columns == ["student_id", "name"] and sorted(r["name"] for r in df.collect()) == ["a,b,c", "x;y"]


def test_csv_latin1_and_explicit_dialect(spark, tmp):
    p = _write(os.path.join(tmp, "l.csv"), "student_id,name\nS1,caf\xe9\nS2,\x98x\n", "latin1")
    assert tb.csv_dialects(spark, p) == {next(iter(tb.csv_dialects(spark, p))): ("latin1", ",")}
    assert sorted(r["name"] for r in tb.read_table(spark, p).collect()) == ["caf\xe9", "\x98x"]
    q = _write(os.path.join(tmp, "e.csv"), "a;b\n1;é\n", "latin1")
    assert [tuple(r) for r in tb.read_csv_auto(spark, q, encoding="latin1", sep=";").collect()] == [(1, "é")]


def test_csv_directory_of_mixed_dialects(spark, tmp):
    d = os.path.join(tmp, "mixed.csv")
    os.makedirs(d)
    _csv(d, "a.csv", [["student_id", "faculty"], ["S1", "Право"]], ";", "cp1251")
    _csv(d, "b.csv", [["faculty", "student_id"], ["Экономика", "S2"]])
    assert sorted((r["student_id"], r["faculty"]) for r in tb.read_table(spark, d).collect()) == [("S1", "Право"), ("S2", "Экономика")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_json_directory_of_both_layouts(spark, tmp):
    d = os.path.join(tmp, "both.json")
    os.makedirs(d)
    _write(os.path.join(d, "a.json"), '\n[{"student_id": "S1"},\n {"student_id": "S2"}]')
    _write(os.path.join(d, "b.json"), '{"student_id": "S3"}\n{"student_id": "S4", "gpa": 2.0}\n')
    assert sorted(r["student_id"] for r in tb.read_table(spark, d).collect()) == ["S1", "S2", "S3", "S4"]


def test_a_store_that_cannot_be_opened_is_no_empty_store(spark, tmp):
    bad = os.path.join(tmp, "bad")
    os.makedirs(bad)
    _write(os.path.join(bad, "part-0.parquet"), "no parquet")
    assert RiskHistory(spark, os.path.join(tmp, "none")).read().count() == 0
    with pytest.raises(Exception):
        RiskHistory(spark, bad).read().count()
    with pytest.raises(Exception):
        MetricsHistory(spark, "nosuchscheme://x/y").read()


@pytest.mark.parametrize("text", [
    '[{"student_id": "S1", "gpa": 3.5},\n {"student_id": "S2", "gpa": 4.0},\n {"student_id": "S3", "gpa": 2.0}]',
    '{"student_id": "S1", "gpa": 3.5}\n{"student_id": "S2", "gpa": 4.0}\n\n{"student_id": "S3", "gpa": 2.0}\n',
])
def test_json_layouts(spark, tmp, text):
    p = _write(os.path.join(tmp, "s.json"), text)
    df = tb.read_table(spark, p)
    assert sorted(r["student_id"] for r in df.collect()) == ["S1", "S2", "S3"]


def test_json_single_document(spark, tmp):
    p = _write(os.path.join(tmp, "one.json"), '{\n  "student_id": "S1",\n  "gpa": 3.5\n}\n')
    assert [r["student_id"] for r in tb.read_table(spark, p).collect()] == ["S1"]


def test_json_lines_written_by_spark(spark, tmp):
    df = spark.range(50).select(F.format_string("S%05d", "id").alias("student_id"))
    p = os.path.join(tmp, "many.json")
    tb.write_table(df.repartition(3), p)
    assert tb.read_table(spark, p).count() == 50


def test_read_students_rejects(spark, tmp):
    p = _write(os.path.join(tmp, "st.csv"), "student_id,dropout\nS1,1\n,0\nS3,7\n")
    ok, bad = tb.read_students(spark, p)
    assert ok.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["bad target", "null student_id"]


@pytest.mark.parametrize("values,good", [(("0.7", "1.9", "1", "0"), 2), (("yes", "no", "1", ""), 1), (("1.0", "0.0", "-1", "2"), 2)])
def test_read_students_takes_only_0_and_1(spark, tmp, values, good):
    p = _write(os.path.join(tmp, "st.csv"), "student_id,dropout\n" + "".join(f"S{i},{v}\n" for i, v in enumerate(values)))
    ok, bad = tb.read_students(spark, p)
    assert ok.count() == good and bad.count() == len(values) - good


def test_synthetic_students_partition_independent(spark):
    a = tb.synthetic_students(spark, 200, 7)
    b = tb.synthetic_students(spark, 200, 7).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    r = a.agg(F.min("age"), F.max("age"), F.min("gpa"), F.max("gpa")).first()
    assert r[0] >= 17 and r[1] <= 29 and r[2] >= 2.0 and r[3] <= 5.0


def test_risk_history_upsert_last_write_wins(spark, tmp):
    h = RiskHistory(spark, os.path.join(tmp, "risk"))
    r1 = spark.createDataFrame([("a", 0.2), ("b", 0.7)], "student_id string, dropout_probability double")
    r2 = spark.createDataFrame([("a", 0.9)], "student_id string, dropout_probability double")
    h.upsert(r1, "2024-01-01", "m1")
    h.upsert(r1, "2024-01-08", "m1")
    h.upsert(r2, "2024-01-08", "m2", notes="again")
    assert [r[0] for r in h.dates().collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    got = h.get("2024-01-08").collect()
    assert len(got) == 1 and got[0]["model_version"] == "m2" and got[0]["notes"] == "again"
    assert h.get("2024-01-01").count() == 2 and h.get("2023-01-01").count() == 0
    assert h.changes("2024-01-01", "2024-01-08").count() == 1
    h.upsert(r1.limit(0), "2024-01-08", "m3")
    assert h.get("2024-01-08").count() == 0 and h.get("2024-01-01").count() == 2
    h.upsert(r1.limit(0), "2030-01-01", "m3")
    h.merge(r1, "2024-01-08", "m4")
    h.merge(r2, "2024-01-08", "m5")
    assert sorted((r["student_id"], r["model_version"]) for r in h.get("2024-01-08").collect()) == [("a", "m5"), ("b", "m4")]


def test_write_all_keeps_one_row_per_student_and_date(spark, tmp):
    h = RiskHistory(spark, os.path.join(tmp, "risk"))
    rows = [("a", 0.2, "2024-01-01"), ("a", 0.6, "2024-01-01"), ("a", 0.9, "2024-01-08"), (None, 0.4, "2024-01-01"), (None, 0.5, "2024-01-08")]
    df = spark.createDataFrame(rows, "student_id string, dropout_probability double, assessment_date string")
    h.write_all(df.selectExpr("student_id", "dropout_probability", "1 as prediction", "'own' as risk_level", "'m' as model_version", "null as notes", "assessment_date"))
    assert h.read().count() == 4
    got = h.changes("2024-01-01", "2024-01-08", labels=("own", "b", "c")).collect()
    assert [(r["student_id"], r["dropout_probability_before"], r["risk_level_before"]) for r in got] == [("a", 0.6, "own")]


def test_rows_without_an_id_all_stay(spark, tmp):
    h = RiskHistory(spark, os.path.join(tmp, "risk"))
    rows = [(None, 0.4, "2024-01-01"), (None, 0.4, "2024-01-01"), (None, 0.9, "2024-01-01"), ("a", float("nan"), "2024-01-01"), ("a", 0.3, "2024-01-01")]
    df = spark.createDataFrame(rows, "student_id string, dropout_probability double, assessment_date string")
    h.write_all(df.selectExpr("student_id", "dropout_probability", "1 as prediction", "'own' as risk_level", "'m' as model_version", "null as notes", "assessment_date"))
    stored = lambda day: sorted(((r.student_id, r.dropout_probability) for r in h.get(day).collect()), key=str)
    want = [("a", 0.3), (None, 0.4), (None, 0.4), (None, 0.9)]
    assert stored("2024-01-01") == want
    batch = df.select("student_id", "dropout_probability")
    h.upsert(batch, "2024-01-08", "m")
    assert stored("2024-01-08") == want
    for _ in range(2):  # the second time it is sent again
        h.merge(batch, "2024-01-15", "m", notes="batch 0")
        assert stored("2024-01-15") == want
    for _ in range(2):
        h.merge(batch, "2024-01-15", "m", notes="batch 1")
        assert stored("2024-01-15") == sorted(want + want[1:], key=str)


def test_metrics_history_append_read(spark, tmp):
    m = MetricsHistory(spark, os.path.join(tmp, "mh"))
    m.append({"accuracy": 0.94, "confusion_matrix": [[1, 2], [3, 4]]}, "random_forest", {"size": 1000},
             timestamp=dt.datetime(2025, 5, 9, 18, 23, 54, 123456))
    m.append({"accuracy": 0.9}, "knn")
    lg = m.long()
    assert lg.count() == 2 and lg.filter(F.col("metric_name") == "confusion_matrix").count() == 0
    row = m.read().filter(F.col("model_version") == "random_forest").first()
    assert row["timestamp"] == dt.datetime(2025, 5, 9, 18, 23, 54, 123456)


def test_write_evaluation_and_reports(spark, tmp):
    from retentio.plans import reports as rp

    pred = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.6), (0, 0, 0.2), (1, 0, 0.4)], "y_true int, y_pred int, score double")
    frames = rp.evaluation_frames(pred)
    paths = tb.write_evaluation(frames, os.path.join(tmp, "eval"))
    assert len(paths) == 7 and spark.read.json(paths[0]).count() == 1
    risks = spark.createDataFrame([("a", 0.1, "Низкий"), ("b", 0.7, "Высокий")], "student_id string, dropout_probability double, risk_level string")
    rep = rp.risk_report(risks, {"model_name": "rf", "accuracy": 0.9, "f1": 0.8})
    assert rep["summary"].first()["total_students"] == 2 and rep["high_risk"].count() == 1


def test_metrics_history_documents_format(spark, tmp):
    doc = """[
  {"timestamp": "2025-01-02T10:11:12.345678", "model_version": "random_forest",
   "metrics": {"accuracy": 0.9, "f1": 0.85, "confusion_matrix": [[5, 1], [2, 7]]},
   "dataset_info": {"size": 100, "target_column": "dropout", "hyperparameter_tuning": false}},
  {"timestamp": "2025-01-03T09:00:00.000001", "model_version": "knn",
   "metrics": {"accuracy": 0.7}}
]"""
    p = _write(os.path.join(tmp, "history.json"), doc)
    entries = MetricsHistory.read_documents(spark, p)
    rows = {r["model_version"]: r for r in entries.collect()}
    assert rows["random_forest"]["timestamp"] == dt.datetime(2025, 1, 2, 10, 11, 12, 345678)
    assert rows["random_forest"]["dataset_info"]["hyperparameter_tuning"] == "false"
    from retentio.operators.history import explode_metrics

    lg = {(r["model_version"], r["metric_name"]): r["metric_value"] for r in explode_metrics(entries).collect()}
    assert lg == {("random_forest", "accuracy"): 0.9, ("random_forest", "f1"): 0.85, ("knn", "accuracy"): 0.7}


def test_dates_and_the_latest_assessment_open_one_partition(spark, tmp):
    store = RiskHistory(spark, os.path.join(tmp, "risk"))
    assert store.dates().collect() == [] and store.latest() is None and store.summary().count() == 0 and store.get().count() == 0
    rows = spark.createDataFrame([("S1", 0.9), ("S2", 0.2)], "student_id string, dropout_probability double")
    for day in ("2024-01-01", "2024-03-01", "2024-02-01"):
        store.upsert(rows, day, "m")
    store.upsert(rows.limit(0), "2024-03-01", "m")  # replaced by nothing: its date is gone
    assert [str(r[0]) for r in store.dates().collect()] == ["2024-01-01", "2024-02-01"] and str(store.latest()) == "2024-02-01"
    for part in os.listdir(os.path.join(tmp, "risk", "assessment_date=2024-01-01")):  # a file that cannot be read
        if part.endswith(".parquet"):
            with open(os.path.join(tmp, "risk", "assessment_date=2024-01-01", part), "wb") as f:
                f.write(b"no parquet")
            crc = os.path.join(tmp, "risk", "assessment_date=2024-01-01", f".{part}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    assert len(store.dates().collect()) == 2
    s = store.summary().first()
    assert (str(s["assessment_date"]), s["total_students"]) == ("2024-02-01", 2) and store.get().count() == 2
    plan = store.get()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(assessment_date" in plan
