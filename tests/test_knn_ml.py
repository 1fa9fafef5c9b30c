import os
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentio.ml import train as tr
from retentio.ml.estimators import AdaBoostClassifier, KNNClassifier, StackingClassifier, SVMClassifier, p1
from retentio.operators import knn
from retentio.operators.knn import knn_join
from retentio.sources.tables import synthetic_students


def test_knn_join_matches_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, [float(rnd.randint(0, 4)), float(rnd.randint(0, 4))]) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = knn_join(df, df, k=3, query_id="id", point_id="id", features="v", exclude_self=True, q_blocks=3, p_blocks=2)
    got = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in got.collect()}
    X = np.array([p[1] for p in pts])
    for i in range(60):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        order = sorted((d[j], j) for j in range(60) if j != i)[:3]
        assert [got[(i, r + 1)] for r in range(3)] == [j for _, j in order]


def test_knn_join_hot_copies_bounded(spark):
    # a third of the points are copies of one vector: every query still gets exactly k
    # neighbours (ties by smaller id), and each cell emits at most k candidates per query
    rnd = random.Random(7)
    pts = [(i, [1.0, 1.0] if i % 3 == 0 else [float(rnd.randint(0, 9)), float(rnd.randint(0, 9))]) for i in range(90)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = knn_join(df, df, k=4, query_id="id", point_id="id", features="v", exclude_self=True, q_blocks=2, p_blocks=3)
    rows = got.collect()
    assert len(rows) == 90 * 4
    got = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in rows}
    X = np.array([p[1] for p in pts])
    for i in range(90):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        order = sorted((d[j], j) for j in range(90) if j != i)[:4]
        assert [got[(i, r + 1)][0] for r in range(4)] == [j for _, j in order]
        assert np.allclose([got[(i, r + 1)][1] for r in range(4)], [x for x, _ in order])


def _data(spark, n=240):
    return tr.prepare(synthetic_students(spark, n, 3))


def test_train_and_score(spark):
    model, met = tr.train(synthetic_students(spark, 300, 3), "decision_tree", cv_folds=2)
    r = met.first()
    assert r["train_rows"] + r["test_rows"] == 300 and 0 <= r["accuracy"] <= 1 and r["cv_accuracy_mean"] is not None
    sc = tr.score_students(model, synthetic_students(spark, 300, 3))
    assert sc.count() == 300 and sc.filter(F.col("dropout_probability").isNull()).count() == 0


def test_custom_models_save_load(spark, tmp):
    d = _data(spark)
    feats = tr.fit_pipeline(d, "logistic_regression")
    x = PipelineModel(stages=feats.stages[:-1]).transform(d)
    for est in (AdaBoostClassifier(numRounds=3), SVMClassifier(kernel="linear"), SVMClassifier(kernel="rbf", numFourierFeatures=16),
                KNNClassifier(k=3, idCol="row_id")):
        m = est.fit(x)
        a = m.transform(x).select("row_id", p1("probability").alias("p")).orderBy("row_id").collect()
        path = os.path.join(tmp, type(m).__name__ + est.uid)
        pm = PipelineModel(stages=[m])
        pm.write().overwrite().save(path)
        b = PipelineModel.load(path).transform(x).select("row_id", p1("probability").alias("p")).orderBy("row_id").collect()
        assert [round(r["p"], 9) for r in a] == [round(r["p"], 9) for r in b]


def test_stacking_fit_score_save_load(spark, tmp):
    d = _data(spark, 160)
    feats = tr.fit_pipeline(d, "logistic_regression")
    x = PipelineModel(stages=feats.stages[:-1]).transform(d)
    m = StackingClassifier(numFolds=2, idCol="student_id").fit(x)
    a = m.transform(x).select("row_id", p1("probability").alias("p"), "prediction").orderBy("row_id").collect()
    assert len(a) == 160 and all(0.0 <= r["p"] <= 1.0 for r in a)
    assert all(r["prediction"] == (1.0 if r["p"] > 0.5 else 0.0) for r in a if abs(r["p"] - 0.5) > 1e-9)
    path = os.path.join(tmp, "stacking")
    PipelineModel(stages=[m]).write().overwrite().save(path)
    b = PipelineModel.load(path).transform(x).select("row_id", p1("probability").alias("p")).orderBy("row_id").collect()
    assert [round(r["p"], 9) for r in a] == [round(r["p"], 9) for r in b]


def test_save_load_full_pipeline(spark, tmp):
    d = _data(spark)
    m = tr.fit_pipeline(d, "random_forest")
    tr.save_model(m, os.path.join(tmp, "rf"), "random_forest", {"size": 240})
    m2, meta = tr.load_model(os.path.join(tmp, "rf"))
    assert meta["model_name"] == "random_forest"
    imp = tr.feature_importance(m2, m2.transform(d))
    assert imp.count() > 10
    kf = tr.key_factors(tr.prepare(synthetic_students(spark, 240, 3)).withColumn("dropout_probability", F.lit(0.9)),
                        imp, 0.5)
    assert kf.filter(F.col("key_factors").isNull()).count() == 0


def _slow_neighbours(v, k):
    import numpy as np

    x = np.array(v)
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out += [(i, j) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], j))[:k]]
    return sorted(out)


def _neighbours(spark, v, k=3, **kw):
    from retentio.operators.knn import knn_join

    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "id long, features array<double>")
    return sorted((r["query_id"], r["neighbor_id"]) for r in knn_join(df, df, k, exclude_self=True, **kw).collect())


def test_knn_far_from_the_origin(spark):
    import numpy as np

    for centre, spread in ((1e4, 1e-3), (0.0, 1e6), (1e8, 1.0)):
        v = np.random.default_rng(1).normal(centre, spread, (120, 16))
        assert _neighbours(spark, v) == _slow_neighbours(v, 3)


def test_knn_of_copies_is_bounded(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from retentio.operators.knn import _topk_cell

    v = [np.ones(64)] * 2000
    cell = pd.DataFrame({"_id": range(2000), "_v": v})
    tracemalloc.start()
    got = _topk_cell(5, "euclidean", True)(cell, cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and len(got) == 10_000
    assert sorted(got["neighbor_id"].unique()) == [0, 1, 2, 3, 4, 5]


def test_knn_search_uses_several_tasks(spark):
    import numpy as np

    from retentio.operators.knn import knn_join

    v = np.random.default_rng(2).normal(size=(2000, 4))
    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "id long, features array<double>")
    plan = knn_join(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    import re

    n = {int(x) for x in re.findall(r"hashpartitioning\(_qb#\d+L?, _pb#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert n and min(n) > 1


def test_boosted_stumps_and_linear_svm_have_importances(spark):
    d = _data(spark, 120)
    x = tr.build_feature_pipeline(d, ids=(*tr.ID_NAMES, "student_id", *tr.HELPER_COLS)).fit(d).transform(d)
    ada = PipelineModel(stages=[AdaBoostClassifier(numRounds=2).fit(x)])
    got = tr.feature_importance(ada, x, top_n=3).collect()
    assert len(got) == 3 and got[0]["importance"] > 0 and abs(sum(ada.stages[0].featureImportances) - 1.0) < 1e-9
    svm = PipelineModel(stages=[SVMClassifier(kernel="linear", plattFolds=1, maxIter=5).fit(x)])
    rows = tr.feature_importance(svm, x).collect()
    assert {r["kind"] for r in rows} == {"coefficient"} and any(r["importance"] for r in rows)


def test_grids_hold_no_equal_points():
    from retentio.ml.registry import grid_points

    assert len(grid_points("random_forest")) == 27 and len(grid_points("decision_tree")) == 18 and len(grid_points("knn")) == 8


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_cell_selects_among_minima_of_groups_only(monkeypatch, metric, exclude_self):
    rng = np.random.default_rng(5)
    X = np.concatenate((rng.normal(size=(1500, 4)), rng.integers(0, 3, (1500, 4)).astype(float)))  # the second half is full of ties
    ids, q = rng.permutation(len(X)), rng.choice(len(X), 40, replace=False)
    k, widths, partition = 3, [], np.partition

    def counted(a, *args, **kwargs):
        widths.append(a.shape[1])
        return partition(a, *args, **kwargs)

    monkeypatch.setattr(knn.np, "partition", counted)
    got = list(zip(*(x.tolist() for x in knn.nearest(X[q], ids[q], X, ids, k, metric, exclude_self))))
    assert max(widths) <= knn.GROUPS * (k + 1) < len(X) // 2
    want = []
    for i in q:
        diff = X - X[i]
        dist = np.sqrt((diff * diff).sum(axis=1)) if metric == "euclidean" else np.abs(diff).sum(axis=1)
        best = sorted((d, p) for d, p in zip(dist.tolist(), ids.tolist()) if not (exclude_self and p == ids[i]))[:k]
        want += [(int(ids[i]), p, d) for d, p in best]
    assert sorted(got) == sorted(want)
    # distances that are no numbers, or fewer points than groups: selected among all
    assert len(knn.nearest(X[q], ids[q], X[:20], ids[:20], k, metric, False)[0]) == k * len(q)
    odd = X.copy()
    odd[7] = np.inf
    with np.errstate(all="ignore"):
        knn.nearest(X[q], ids[q], odd, ids, k, "manhattan", False)
    assert widths[-1] == len(X)
