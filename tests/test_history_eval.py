import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from retentio.operators import evaluation as ev
from retentio.operators import history as hs
from retentio.operators.running import running_sums


def _entries(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    rows = [(t[i], "m1", {"accuracy": str(0.5 + i / 10), "confusion_matrix": "[[1,2],[3,4]]"}, {"size": "10"})
            for i in range(5)]
    rows += [(t[0], "m2", {"accuracy": "0.7", "f1": "0.6"}, {})]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, model_version string, "
                                       "metrics map<string,string>, dataset_info map<string,string>")


def test_explode_skips_nested(spark):
    lg = hs.explode_metrics(_entries(spark))
    assert lg.filter(F.col("metric_name") == "confusion_matrix").count() == 0
    assert lg.count() == 7


def test_metric_trend_window_rules(spark):
    lg = hs.explode_metrics(_entries(spark))
    rows = hs.metric_trend(lg, "accuracy", window=3).orderBy("model_version", "timestamp").collect()
    m1 = [r["trend_value"] for r in rows if r["model_version"] == "m1"]
    assert m1[:2] == [None, None] and abs(m1[2] - 0.6) < 1e-9 and abs(m1[4] - 0.8) < 1e-9
    m2 = [r["trend_value"] for r in rows if r["model_version"] == "m2"]
    assert m2 == [0.7]  # fewer points than the window: raw values


def test_latest_compare_stats(spark):
    lg = hs.explode_metrics(_entries(spark))
    latest = {(r["model_version"], r["metric_name"]): r["metric_value"] for r in hs.latest_metrics(lg).collect()}
    assert abs(latest[("m1", "accuracy")] - 0.9) < 1e-9
    wide = {r["model_version"]: r for r in hs.compare_models(lg, ["m1", "m2"], ["accuracy", "f1"]).collect()}
    assert abs(wide["m1"]["accuracy"] - 0.7) < 1e-9 and wide["m1"]["f1"] is None
    ev_ = spark.createDataFrame([("a", 0.5, None), ("a", 0.7, 0.2)], "model_name string, accuracy double, f1_score double")
    st = {(r["model_name"], r["metric"]): r for r in hs.model_performance_stats(ev_).collect()}
    assert abs(st[("a", "f1_score")]["mean"] - 0.1) < 1e-9 and st[("a", "recall")]["max"] == 0.0
    assert abs(st[("a", "accuracy")]["std"] - 0.1) < 1e-9


def _scored(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y_true int, score double").withColumn(
        "y_pred", (F.col("score") >= 0.5).cast("int")), rows


def test_auc_matches_pairwise(spark):
    df, rows = _scored(spark)
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    pairs = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
    auc = ev.roc_auc(df).first()["roc_auc"]
    assert abs(auc - pairs / (len(pos) * len(neg))) < 1e-12


def test_running_sums_independent_of_buckets(spark):
    df, _ = _scored(spark)
    agg = df.groupBy("score").agg(F.count("*").alias("c"))
    a = {r["score"]: r["cum_c"] for r in running_sums(agg, "score", ["c"], buckets=1).collect()}
    b = {r["score"]: r["cum_c"] for r in running_sums(agg, "score", ["c"], buckets=7).collect()}
    assert a == b and max(a.values()) == 300


def test_confusion_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y_true int, y_pred int")
    m = ev.binary_metrics(df).first()
    assert m["precision"] == 0.0 and m["f1"] == 0.0 and abs(m["accuracy"] - 1 / 3) < 1e-9
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in ev.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 0}
    rep = {r["label"]: r for r in ev.classification_report(df).collect()}
    assert rep["1"]["support"] == 2 and rep["accuracy"]["precision"] is None


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(0.4,), (0.4,)], "dropout_probability double")
    rows = ev.probability_histogram(df).collect()
    assert len(rows) == 20 and [r["n"] for r in rows if r["bin"] == 0] == [2]


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y_true int, score double")
    ap = ev.average_precision(df).first()["average_precision"]
    assert abs(ap - (0.5 * 1.0 + 0.5 * (2 / 3))) < 1e-12


def test_exact_quantiles_both_paths(spark):
    from retentio.operators.running import exact_modes, exact_quantiles, grouped_quantiles

    rnd = random.Random(9)
    rows = [(rnd.choice([None, rnd.random(), float(rnd.randint(0, 5))]), rnd.randint(0, 9), rnd.choice("abc"))
            for _ in range(2001)]
    df = spark.createDataFrame(rows, "x double, y int, g string")
    for q in (0.1, 0.5, 0.75):
        exp = df.agg(F.percentile("x", q), F.percentile("y", q)).first()
        got = {r[0]: r[1] for r in exact_quantiles(df, ["x", "y"], q).collect()}
        assert abs(got["x"] - exp[0]) < 1e-12 and abs(got["y"] - exp[1]) < 1e-12
    exp = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("x")).collect()}
    got = {r[0]: r[1] for r in grouped_quantiles(df, ["g"], "x", [0.5], ["m"]).collect()}
    assert all(abs(exp[k] - got[k]) < 1e-12 for k in exp)
    # no group: one global set of quantiles, n from a scalar subquery
    exp = df.agg(*[F.percentile("x", q) for q in (0.0, 0.25, 0.9, 1.0)]).first()
    got = grouped_quantiles(df, [], "x", [0.0, 0.25, 0.9, 1.0], ["a", "b", "c", "d"], buckets=4).first()
    assert all(abs(got[i] - exp[i]) < 1e-12 for i in range(4))
    modes = {r[0]: r[1] for r in exact_modes(df, ["g"]).collect()}
    assert modes["g"] == df.agg(F.mode("g", True)).first()[0]


def test_running_sums_hot_key_split_exact(spark):
    # one key holds a third of each group's rows (distinct tiebreaks): it is spread over
    # several buckets and the running sums still equal a brute-force ordered cumsum
    from retentio.operators.running import _bucketed, running_sums

    rnd = random.Random(5)
    rows = []
    for g in ("a", "b"):
        for i in range(600):
            k = 50.0 if i % 3 == 0 else float(rnd.randint(0, 100))
            tb = None if i in (0, 97, 194) else float(i)  # one null on the hot key (i = 0)
            rows.append((g, k, tb, rnd.randint(1, 9)))
    df = spark.createDataFrame(rows, "g string, k double, tb double, v long")
    for desc in (False, True):
        got = running_sums(df, "k", ["v"], descending=desc, buckets=8, group=["g"], tiebreak=["tb"]).collect()
        got = {(r["g"], r["k"], r["tb"], r["v"]): r["cum_v"] for r in got}
        for g in ("a", "b"):
            mine = [r for r in rows if r[0] == g]
            nulls_first = not desc

            def sk(r):
                tb_key = (0 if (r[2] is None) == nulls_first else 1, 0.0 if r[2] is None else r[2])
                return (r[1], tb_key) if not desc else (-r[1], (tb_key[0], -tb_key[1]))
            acc = 0
            for r in sorted(mine, key=sk):
                acc += r[3]
                assert got[r] == acc
        hot = _bucketed(df, "k", ["g"], 8, desc, ["tb"]).filter("k = 50.0").groupBy("g").agg(
            F.count_distinct("_bucket").alias("n")).collect()
        assert all(r["n"] > 1 for r in hot)


def test_roc_auc_of_billions_of_rows(spark):
    from retentio.operators import evaluation as ev

    n = 4_000_000_000
    counts = spark.createDataFrame([(0.9, n, 0), (0.5, n, n), (0.1, 0, n)], "score double, pos long, neg long")
    assert abs(ev.roc_auc_from_counts(counts).first()[0] - 0.875) < 1e-12


def test_changes_leave_null_ids_out(spark):
    from retentio.operators import risk as rk

    rows = [(None, 0.1, "2024-01-01"), (None, 0.9, "2024-01-08"), ("a", 0.1, "2024-01-01"), ("a", 0.2, "2024-01-08")]
    h = spark.createDataFrame(rows, "student_id string, dropout_probability double, d string").selectExpr(
        "student_id", "dropout_probability", "cast(null as string) risk_level", "'m' model_version", "cast(d as date) assessment_date")
    assert [r["student_id"] for r in rk.risk_changes(h, "2024-01-01", "2024-01-08").collect()] == ["a"]
    assert rk.risk_change_summary(h, "2024-01-01", "2024-01-08").first()["students_count"] == 1


def _slow_trend(rows, w):
    import math

    out = []
    for m in sorted({m for m, _, _ in rows if m is not None}):
        series = sorted(((t, v) for k, t, v in rows if k == m), key=lambda x: (x[0], math.isnan(x[1]), x[1]))
        for i, (t, v) in enumerate(series):
            vals = [x for _, x in series[max(0, i - w + 1):i + 1]]
            out.append((m, t, v, v if len(series) < w or w <= 1 else sum(vals) / w if len(vals) == w else None))
    return out


def test_metric_trend_in_any_number_of_buckets(spark):
    import datetime as dt
    import math
    import random

    from retentio.operators.history import metric_trend

    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(minutes=rng.randrange(300)), rng.random()) for _ in range(200)]
    rows += [("hot", start + dt.timedelta(minutes=40), rng.random()) for _ in range(60)]
    rows += [("bad", start + dt.timedelta(hours=i), x) for i, x in enumerate([0.5, float("nan"), 0.7, 1e17, 0.5, 0.7, 0.8, 0.9, 1.0])]
    rows += [("few", start, 0.1), ("few", start + dt.timedelta(days=900), 0.2), (None, start, 0.3)]
    df = spark.createDataFrame([(*r, "f1") for r in rows], "model_version string, timestamp timestamp_ntz, metric_value double, metric_name string")

    def clean(x):
        return None if x is None else "nan" if math.isnan(x) else x

    for w in (1, 3, 7):
        want = [(m, t, clean(v), clean(x)) for m, t, v, x in _slow_trend(rows, w)]
        for buckets in (1, 5, 64):
            got = [(r[0], r[1], clean(r[2]), clean(r[3])) for r in metric_trend(df, "f1", None, w, buckets).collect()]
            assert [g[:3] for g in got] == [x[:3] for x in want]  # time order
            for g, x in zip(got, want):
                assert g[3] == x[3] or abs(g[3] - x[3]) <= 1e-9 * max(1.0, abs(x[3]))


def test_metric_trend_exchanges(spark):
    from retentio.operators.history import metric_trend

    df = spark.createDataFrame([("a", None, 0.1, "f1")], "model_version string, timestamp timestamp_ntz, metric_value double, metric_name string")
    plan = metric_trend(df, "f1", None, 3)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan
    plan = metric_trend(df, "f1", None, 3)._jdf.queryExecution().executedPlan().toString()
    # the window, the values before each bucket by model, and their join back; the time order is one more
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("Exchange rangepartitioning") == 1
