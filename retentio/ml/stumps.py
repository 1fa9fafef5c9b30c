"""Exact split search: every midpoint between neighbouring distinct values is tried.

Weights and weights of class 1 are summed per (column, distinct value); running sums over the
sorted values give both sides of every split, and one aggregate takes the best. Nothing is sampled or binned, and no
task holds a column: the running sums are those of :mod:`retentio.operators.running`, so a value that many
rows share is one row, and a column of many values is many buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.bins import clean_double
from retentio.ml.composite import CompositeModelIO
from retentio.operators.running import running_sums

#: Digits to which impurities are compared, so that the order of sums does not decide ties.
DIGITS = 12


def _gini(weight: Column, ones: Column) -> Column:
    """weight times the Gini impurity of one side."""
    return F.when(weight > 0, 2 * ones * (weight - ones) / weight).otherwise(0.0)


def _best(cells: DataFrame) -> DataFrame:
    """The best split of each column of (feature, value, w, y1): weights and weights of class 1 of rows."""
    counts = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature", "value").agg(F.sum("w").alias("w"), F.sum("y1").alias("y1"))
    total = counts.groupBy("feature").agg(F.sum("w").alias("all_w"), F.sum("y1").alias("all_y1"), F.max("value").alias("top"))
    sides = running_sums(counts, "value", ["w", "y1"], descending=False, group=["feature"]).join(total, "feature").filter(F.col("value") < F.col("top"))
    lw, l1 = F.col("cum_w"), F.col("cum_y1")
    rw, r1 = F.col("all_w") - lw, F.col("all_y1") - l1
    gini = (_gini(lw, l1) + _gini(rw, r1)) / F.col("all_w")
    error = (F.least(l1, lw - l1) + F.least(r1, rw - r1)) / F.col("all_w")
    scored = sides.select("feature", "value", F.round(gini, DIGITS).alias("gini"), error.alias("error"), lw.alias("left_weight"), l1.alias("left_ones"),
                          rw.alias("right_weight"), r1.alias("right_ones"))
    best = scored.groupBy("feature").agg(F.min(F.struct("gini", "value", "error", "left_weight", "left_ones", "right_weight", "right_ones")).alias("b"))
    # the next value is looked up for the best splits alone
    after = counts.join(best, "feature").filter(F.col("value") > F.col("b.value")).groupBy("feature").agg(F.min("value").alias("next"))
    return best.join(after, "feature").select("feature", ((F.col("b.value") + F.col("next")) / 2).alias("threshold"), "b.gini", "b.error",
                                              "b.left_weight", "b.left_ones", "b.right_weight", "b.right_ones")


def best_splits(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """(feature, threshold, gini, error, left_weight, left_ones, right_weight, right_ones): the best split of each numeric column.

    Left is value <= threshold, a midpoint of two neighbouring values; the best has the least weighted Gini impurity,
    ties go to the smaller value. ``error`` is the weight that the majority of either side gets wrong. Rows whose value is
    null or NaN do not count for a column; a column with fewer than two values has no split.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), clean_double(c).alias("value")) for c in features])
    rows = df.select(F.explode(cells).alias("c"), w.alias("w"), (w * F.col(label).cast("double")).alias("y1"))
    return _best(rows.select("c.feature", "c.value", "w", "y1"))


class _StumpParams(Params):
    DEFAULTS = {"featuresCol": "features", "labelCol": "label", "weightCol": "_w", "predictionCol": "prediction"}
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", typeConverter=TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "likelier class", typeConverter=TypeConverters.toString)

    def setFeaturesCol(self, name: str):
        return self._set(featuresCol=name)

    def setPredictionCol(self, name: str):
        return self._set(predictionCol=name)

    def setProbabilityCol(self, name: str):
        return self

    def setRawPredictionCol(self, name: str):
        return self


class ExactStump(Estimator, _StumpParams):
    """A tree of one split, the best of all midpoints of all features."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol="_w", predictionCol="prediction"):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactStumpModel":
        get = self.getOrDefault
        w, y = F.col(get(self.weightCol)).cast("double"), F.col(get(self.labelCol)).cast("double")
        rows = df.select(F.posexplode(vector_to_array(get(self.featuresCol))).alias("feature", "value"), w.alias("w"), (w * y).alias("y1"))
        row = _best(rows).orderBy("gini", "feature").first()
        whole = df.agg(F.sum(w).alias("w"), F.sum(w * y).alias("y1")).first()
        size = len(df.select(get(self.featuresCol)).first()[0])
        model = ExactStumpModel(featuresCol=get(self.featuresCol), predictionCol=get(self.predictionCol))
        if row is None:  # no feature has two values: the likelier class for all
            model._split = (0, float("inf"), float(2 * whole["y1"] > whole["w"]), 0.0, size)
        else:
            model._split = (int(row["feature"]), float(row["threshold"]), float(2 * row["left_ones"] > row["left_weight"]),
                            float(2 * row["right_ones"] > row["right_weight"]), size)
        return model


class ExactStumpModel(Model, _StumpParams, CompositeModelIO):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**self._input_kwargs)
        self._split: tuple = (0, float("inf"), 0.0, 0.0, 1)

    def _payload(self):
        return {"split": [None if x == float("inf") else x for x in self._split]}

    def _restore(self, subs, payload, path):
        self._split = tuple(float("inf") if x is None else x for x in payload["split"])

    @property
    def featureImportances(self) -> DenseVector:
        feature, threshold, *_, size = self._split
        out = np.zeros(size)
        if threshold != float("inf"):
            out[feature] = 1.0
        return Vectors.dense(out)

    def _transform(self, df: DataFrame) -> DataFrame:
        feature, threshold, left, right, _ = self._split
        value = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))[feature]
        low = F.lit(True) if threshold == float("inf") else value <= F.lit(threshold)
        return df.withColumn(self.getOrDefault(self.predictionCol), F.when(low, F.lit(left)).otherwise(F.lit(right)))
