import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retentio.ml.estimators import AdaBoostClassifier, AdaBoostModel
from retentio.ml.stumps import ExactStump, ExactStumpModel, best_splits


def slow(x, y, w):
    """(threshold, gini, error) by trying every midpoint."""
    keep = ~np.isnan(x)
    x, y, w = x[keep], y[keep], w[keep]
    values = np.unique(x)
    best = None
    for a, b in zip(values, values[1:]):
        gini = error = 0.0
        for side in (x <= a, x > a):
            t, o = w[side].sum(), (w * y)[side].sum()
            gini += 2 * o * (t - o) / t / w.sum()
            error += min(o, t - o) / w.sum()
        if best is None or gini < best[1] - 1e-11:
            best = ((a + b) / 2, gini, error)
    return best


def test_best_split_of_every_column_equals_all_midpoints(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = {"many": rng.normal(0, 1, n), "few": rng.integers(0, 4, n).astype(float), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 5, n)),
         "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 1, n)), "one": np.full(n, 3.0), "none": np.full(n, np.nan)}
    y = ((x["many"] > 0.37) ^ (rng.random(n) < 0.2)).astype(float)
    w = rng.uniform(0.1, 3, n)
    rows = [(*(None if np.isnan(v[i]) and i % 2 else float(v[i]) for v in x.values()), int(y[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x) + ", y int, w double").repartition(6)
    for weight, ws in (("w", w), (None, np.ones(n))):
        got = {r["feature"]: r for r in best_splits(df, list(x), "y", weight).collect()}
        assert sorted(got) == ["few", "gaps", "hot", "many"]
        for c in got:
            assert (got[c]["threshold"], got[c]["gini"], got[c]["error"]) == pytest.approx(slow(x[c], y, ws), abs=1e-9)
    assert best_splits(df.limit(0), list(x), "y").count() == 0


def frame(spark, n=400):
    """More distinct values than a binned search tries thresholds, and the border lies between two of them."""
    rng = np.random.default_rng(2)
    x = np.sort(rng.exponential(1, n))[:, None] * np.array([1.0, 0.0, 0.0]) + rng.normal(0, 1, (n, 3)) * np.array([0.0, 1.0, 1.0])
    y = (np.arange(n) > 311).astype(float)
    return spark.createDataFrame([(Vectors.dense(r), float(t), 1.0, i) for i, (r, t) in enumerate(zip(x, y))], ["features", "label", "_w", "id"]), x


def test_stump_finds_the_exact_border_and_comes_back(spark, tmp):
    df, x = frame(spark)
    m = ExactStump().fit(df)
    assert m._split[0] == 0 and m._split[1] == pytest.approx((x[311, 0] + x[312, 0]) / 2) and m._split[2:4] == (0.0, 1.0)
    assert m.transform(df).filter("prediction <> label").count() == 0
    assert m.featureImportances.toArray().tolist() == [1.0, 0.0, 0.0]
    m.write().overwrite().save(f"{tmp}/m")
    assert ExactStumpModel.read().load(f"{tmp}/m").transform(df).filter("prediction <> label").count() == 0
    same = df.withColumn("features", F.lit(None)).select("label", "_w").crossJoin(spark.createDataFrame([(Vectors.dense([1.0]),)], ["features"]))
    flat = ExactStump().fit(same)  # no feature has two values
    assert {r["prediction"] for r in flat.transform(same).collect()} == {0.0} and flat.featureImportances.toArray().tolist() == [0.0]


def test_boosting_by_exact_stumps(spark, tmp):
    df, x = frame(spark)
    noisy = df.withColumn("label", F.when(F.col("id") % 17 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    m = AdaBoostClassifier(numRounds=3, exact=True).fit(noisy)
    assert len(m._trees) == 3 and m._trees[0]._split[1] == pytest.approx((x[311, 0] + x[312, 0]) / 2)
    got = m.transform(noisy)
    m.write().overwrite().save(f"{tmp}/a")
    back = AdaBoostModel.read().load(f"{tmp}/a").transform(noisy)
    key = lambda d: sorted((r["id"], r["prediction"], round(r["probability"][1], 12)) for r in d.collect())
    assert key(got) == key(back) and got.filter("prediction <> label").count() <= 40
    assert sum(m.featureImportances.toArray()) == pytest.approx(1.0)
