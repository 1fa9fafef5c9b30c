import pytest

from retentio.ml import train
from retentio.ml.registry import make_estimator
from retentio.sources import fixtures as fx


@pytest.mark.parametrize("model", ["decision_tree", "logistic_regression"])
def test_learners_get_as_many_partitions_as_their_rows_need(spark, monkeypatch, model):
    d = train.prepare(fx.students(spark, "/root/testdata/sf0.001")).repartition(16)
    seen = []
    make = train.make_estimator

    def watched(name, **params):
        est = make(name, **params)
        fit = est.fit
        est.fit = lambda x: seen.append((x.rdd.getNumPartitions(), x.count())) or fit(x)
        return est

    monkeypatch.setattr(train, "make_estimator", watched)
    train.fit_pipeline(d, model)
    monkeypatch.setattr(train, "ROWS_PER_TASK", 50)
    train.fit_pipeline(d, model)
    n = d.count()
    assert seen == [(1, n), (-(-n // 50), n)]


@pytest.mark.parametrize("model", ["decision_tree", "random_forest"])
def test_rows_of_deep_trees_keep_their_nodes(model):
    assert make_estimator(model, n_features=3, n_rows=10).getCacheNodeIds()


def test_partitions_of_learners_do_not_grow_beyond_the_slots_until_they_are_large(spark, monkeypatch):
    x = spark.range(400).repartition(100)
    slots = max(2, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(train, "ROWS_PER_TASK", 2)
    assert train.training_rows(x, 400).rdd.getNumPartitions() == min(slots, 100)
    monkeypatch.setattr(train, "MOST_ROWS", 5)
    assert train.training_rows(x, 400).rdd.getNumPartitions() == max(min(slots, 100), 80)
