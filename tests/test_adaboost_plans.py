from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from retentio.ml import estimators


def test_rounds_of_boosting_do_not_carry_the_plan_of_their_input(spark, monkeypatch):
    rows = spark.range(200).select(F.expr("cast(id % 7 as double) x"), F.expr("cast(id % 3 as double) y"),
                                   F.expr("cast(id % 5 < 2 as double) label"))
    cached = rows.repartition(3, "x").persist()
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(cached)
    sizes = []
    tree = estimators.DecisionTreeClassifier

    class Watched(tree):
        def fit(self, data, params=None):
            sizes.append(data._jdf.queryExecution().executedPlan().toString())
            return super().fit(data, params)

    monkeypatch.setattr(estimators, "DecisionTreeClassifier", Watched)
    model = estimators.AdaBoostClassifier(numRounds=6).fit(df)
    cached.unpersist()
    assert len(sizes) > 2 and len(model._trees) <= 6
    assert not any("Exchange" in p or "AdaptiveSparkPlan" in p for p in sizes)
    assert model.transform(df).count() == 200
