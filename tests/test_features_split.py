from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.ml.preprocessing import MedianStandardScaler, ModeImputer
from retentio.operators import features as fe
from retentio.operators import split as sp


def test_exact_median_population_std(spark):
    df = spark.createDataFrame([(10.0, 5.0), (20.0, 5.0), (30.0, 5.0), (40.0, 5.0), (None, 5.0)], "x double, c double")
    m = MedianStandardScaler(inputCols=["x", "c"], outputCols=["xs", "cs"]).fit(df)
    assert m.getOrDefault(m.medians)[0] == 25.0
    out = m.transform(df).collect()
    vals = [r["xs"] for r in out]
    assert abs(sum(vals)) < 1e-9 and abs(sum(v * v for v in vals) / len(vals) - 1.0) < 1e-9
    assert all(r["cs"] == 0.0 for r in out)  # zero variance -> 0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "f string")
    m = ModeImputer(inputCols=["f"], outputCols=["g"]).fit(df)
    assert m.getOrDefault(m.modes) == ["a"]


def test_pipeline_unseen_category_all_zero(spark):
    tr = spark.createDataFrame([("s1", 1.0, "x", 0), ("s2", 2.0, "y", 1)], "student_id string, v double, f string, dropout int")
    te = spark.createDataFrame([("s3", 3.0, "z", 0)], "student_id string, v double, f string, dropout int")
    m = fe.fit_features(tr)
    row = m.transform(te).select(vector_to_array("features").alias("v")).first()["v"]
    assert row[1:] == [0.0, 0.0]
    names = fe.feature_names(m.transform(te))
    assert names == ["v", "f_x", "f_y"]


def test_roles_skip_ids_target_dates(spark):
    df = spark.createDataFrame([], "ID string, student_id string, a int, b string, d date, dropout int")
    assert fe.infer_column_roles(df) == (["b"], ["a"])


def test_exact_split_is_stratified_and_disjoint(spark):
    rows = [(f"k{i}", int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, y int").repartition(7)
    s = sp.stratified_split(df, "y", "key", 0.2, exact=True)
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got[(1, "test")] == round(334 * 0.2) and got[(0, "test")] == round(666 * 0.2)
    s2 = sp.stratified_split(df.repartition(3), "y", "key", 0.2, exact=True)
    a = {r["key"]: r["split"] for r in s.collect()}
    b = {r["key"]: r["split"] for r in s2.collect()}
    assert a == b
    f = sp.assign_folds(df, "y", "key", 5, exact=True)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_hash_split_deterministic(spark):
    df = spark.createDataFrame([(f"k{i}", 0) for i in range(200)], "key string, y int")
    a = sp.stratified_split(df, "y", "key").filter(F.col("split") == "test").count()
    b = sp.stratified_split(df.repartition(5), "y", "key").filter(F.col("split") == "test").count()
    assert a == b and 10 < a < 70


def test_names_of_columns_and_categories_that_look_like_stages(spark):
    from retentio.operators import features as fe

    rows = [(1.0, "a__num", 2.0, "x"), (2.0, "b__ohe_c", 3.0, "y__imp"), (4.0, "a__num", 5.0, "__idx")]
    df = spark.createDataFrame(rows, "x__number double, kind string, y__num double, z__ohe_w string")
    out = fe.fit_features(df, target=None, ids=()).transform(df)
    assert fe.feature_names(out) == ["x__number", "y__num", "kind_a__num", "kind_b__ohe_c", "z__ohe_w___idx", "z__ohe_w_x", "z__ohe_w_y__imp"]
    assert fe.feature_kinds(out) == ["numeric"] * 2 + ["onehot"] * 5
