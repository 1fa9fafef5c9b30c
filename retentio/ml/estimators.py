"""Classifiers that Spark ML lacks, built from Spark ML parts.

* :class:`AdaBoostClassifier` — SAMME boosting of depth-1 trees with a weight column
  (Spark's, which try up to 31 thresholds a column, or with ``exact`` all midpoints).
  One tree fit and one aggregate per round; the working table is persisted each round
  and checkpointed (reliably, in ``spark.checkpoint.dir``) at first and every ``checkpointInterval``
  rounds so lineage stays short and a lost executor recomputes only a few rounds. The driver keeps
  the plan of every job as text, with the plans of cached tables inside it: rounds must not carry the input's.
* :class:`SVMClassifier` — ``LinearSVC`` plus Platt scaling (a one-feature logistic
  regression on out-of-fold margins, 5 folds) for probabilities; the rbf kernel is
  approximated with random Fourier features (fixed seeded projection, applied by an Arrow
  pandas UDF).
* :class:`KNNClassifier` — vote of the k nearest training rows via the exact
  :func:`retentio.operators.knn.knn_join`; needs a unique integer id column.
* :class:`StackingClassifier` — out-of-fold probabilities of the base models
  (random forest, gradient boosting, logistic regression) feed a logistic regression.

All models output ``prediction`` and ``probability`` (vector [1-p, p]) like Spark's.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.ml.composite import CompositeModelIO
from retentio.ml.stumps import ExactStump
from retentio.session import checkpoint_dir


# bytes of kernel features: of one partition of them, and of all that the SVM fits running at once hold
KERNEL_PART_BYTES, KERNEL_FITS_BYTES = 64 << 20, 1 << 30


class _ClfParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    pass


def _prob_vector(p) -> F.Column:
    return array_to_vector(F.array(F.lit(1.0) - p, p))


def p1(col: str = "probability") -> F.Column:
    """Probability of class 1 from a probability vector column."""
    return vector_to_array(F.col(col))[1]


def _prefix_margins(df: DataFrame, trees: list, votes: list[tuple[float, float, float]], rounds: list[int], features: str) -> DataFrame:
    """``_at<i>``: 1 where the first ``rounds[i]`` trees' votes, weight * (scale * prediction + shift), add up to more than 0."""
    out, names, margin = df, [], F.lit(0.0)
    at = {}
    for n, (t, (weight, scale, shift)) in enumerate(zip(trees, votes, strict=True)):
        t = t.copy()
        t.setFeaturesCol(features).setPredictionCol(f"_tree{n}")
        if not isinstance(t, DecisionTreeRegressionModel):
            t.setProbabilityCol("").setRawPredictionCol("")
        out = t.transform(out)
        names.append(f"_tree{n}")
    for i, r in enumerate(rounds):
        margin = sum((F.lit(w) * (F.lit(s) * F.col(c) + F.lit(b)) for c, (w, s, b) in zip(names[:r], votes[:r], strict=True)), F.lit(0.0))
        at[f"_at{i}"] = (margin > 0).cast("double")
    return out.withColumns(at).drop(*names)


def boosted_predictions_of(model: GBTClassificationModel, df: DataFrame, rounds: list[int], features: str = "features") -> DataFrame:
    """The same for Spark's gradient boosting, whose first trees are those of a shorter boosting with the same seed."""
    return _prefix_margins(df, list(model.trees), [(float(w), 1.0, 0.0) for w in model.treeWeights], rounds, features)


# ------------------------------------------------------------------------------------------
# AdaBoost (SAMME, binary)
# ------------------------------------------------------------------------------------------
class AdaBoostClassifier(Estimator, _ClfParams, CompositeModelIO):
    numRounds = Param(Params._dummy(), "numRounds", "boosting rounds", typeConverter=TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each round", typeConverter=TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", typeConverter=TypeConverters.toInt)
    exact = Param(Params._dummy(), "exact", "trees of depth 1 by exact split search", typeConverter=TypeConverters.toBoolean)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "rounds between checkpoints",
                               typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", numRounds=50, learningRate=1.0, maxDepth=1, exact=False, checkpointInterval=10, seed=42):
        super().__init__()
        self._setDefault(numRounds=50, learningRate=1.0, maxDepth=1, exact=False, checkpointInterval=10, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "AdaBoostModel":
        spark = df.sparkSession
        checkpoint_dir(spark)
        lr = self.getOrDefault(self.learningRate)
        cur = df.select(F.col(self.getFeaturesCol()).alias("features"),
                        F.col(self.getLabelCol()).cast("double").alias("label"), F.lit(1.0).alias("_w"))
        cur = cur.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
        trees, alphas = [], []
        prev = cur
        for m in range(self.getOrDefault(self.numRounds)):
            dt = DecisionTreeClassifier(maxDepth=self.getOrDefault(self.maxDepth), weightCol="_w", featuresCol="features",
                                        labelCol="label", predictionCol="_p", probabilityCol="_pr",
                                        rawPredictionCol="_raw", seed=self.getOrDefault(self.seed) + m)
            if self.getOrDefault(self.exact) and self.getOrDefault(self.maxDepth) == 1:
                dt = ExactStump(weightCol="_w", predictionCol="_p")
            tree = dt.fit(cur)
            pred = tree.transform(cur).select("features", "label", "_w",
                                              (F.col("_p") != F.col("label")).cast("double").alias("_miss"))
            row = pred.agg(F.sum("_w").alias("tw"), F.sum(F.col("_w") * F.col("_miss")).alias("ew")).first()
            err = (row["ew"] or 0.0) / row["tw"] if row["tw"] else 0.0
            if err <= 0.0:
                trees.append(tree)
                alphas.append(1.0)
                break
            if err >= 0.5:
                if not trees:
                    trees.append(tree)
                    alphas.append(1.0)
                break
            alpha = lr * math.log((1.0 - err) / err)
            trees.append(tree)
            alphas.append(alpha)
            nxt = pred.select("features", "label",
                              (F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(row["tw"])).alias("_w"))
            if (m + 1) % self.getOrDefault(self.checkpointInterval) == 0:
                nxt = nxt.checkpoint(eager=True)
            nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
            nxt.count()  # held before the round it is made from is released
            cur = nxt
            prev.unpersist()
            prev = cur
        prev.unpersist()
        model = AdaBoostModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                              probabilityCol=self.getProbabilityCol())
        model._trees, model._alphas = trees, alphas
        return model


class AdaBoostModel(Model, _ClfParams, CompositeModelIO):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", probabilityCol="probability"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._trees: list = []
        self._alphas: list[float] = []

    def _sub_models(self):
        return self._trees

    def _payload(self):
        return {"alphas": self._alphas}

    def _restore(self, subs, payload, path):
        self._trees, self._alphas = subs, payload["alphas"]

    def predictions_of(self, df: DataFrame, rounds: list[int]) -> DataFrame:
        """Predictions ``_at0``, ``_at1``, ... of the first so many rounds, from one pass over the trees.

        Boosting of n rounds begins with that of fewer, so each column equals that of a model of its rounds.
        """
        return _prefix_margins(df, self._trees, [(a, 2.0, -1.0) for a in self._alphas], rounds, self.getFeaturesCol())

    @property
    def featureImportances(self) -> DenseVector:
        """The trees' importances, weighted by the trees' votes."""
        total = sum(self._alphas) or 1.0
        return Vectors.dense(sum(a / total * t.featureImportances.toArray() for a, t in zip(self._alphas, self._trees)))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        names = []
        for i, t in enumerate(self._trees):
            name = f"_ada{i}"
            t = t.copy()
            t.setFeaturesCol(self.getFeaturesCol()).setPredictionCol(name).setProbabilityCol("").setRawPredictionCol("")
            out = t.transform(out)
            names.append(name)
        total = sum(self._alphas) or 1.0
        d = sum((F.lit(a) * (F.lit(2.0) * F.col(n) - F.lit(1.0)) for a, n in zip(self._alphas, names)), F.lit(0.0)) / F.lit(total)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-d))
        return (out.withColumn(self.getProbabilityCol(), _prob_vector(p))
                .withColumn(self.getPredictionCol(), (d > 0).cast("double")).drop(*names))


# ------------------------------------------------------------------------------------------
# SVM with Platt probabilities; rbf via random Fourier features
# ------------------------------------------------------------------------------------------
def _rff_udf(W: np.ndarray, b: np.ndarray):
    scale = math.sqrt(2.0 / W.shape[0])

    @F.pandas_udf("array<double>")
    def rff(v: pd.Series) -> pd.Series:
        X = np.stack(v.to_numpy()).astype(np.float64)
        Z = np.cos(X @ W.T + b) * scale
        return pd.Series(list(Z))

    return rff


class SVMClassifier(Estimator, _ClfParams, CompositeModelIO):
    C = Param(Params._dummy(), "C", "inverse regularisation strength", typeConverter=TypeConverters.toFloat)
    kernel = Param(Params._dummy(), "kernel", "'linear' or 'rbf'", typeConverter=TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "'scale', 'auto' or a number", typeConverter=TypeConverters.toString)
    numFourierFeatures = Param(Params._dummy(), "numFourierFeatures", "rbf feature count", typeConverter=TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "LinearSVC iterations", typeConverter=TypeConverters.toInt)
    plattFolds = Param(Params._dummy(), "plattFolds", "folds for out-of-fold Platt scaling (1 = in-sample)",
                       typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", C=1.0, kernel="rbf", gamma="scale", numFourierFeatures=256,
                 maxIter=100, plattFolds=5, seed=42):
        super().__init__()
        self._setDefault(C=1.0, kernel="rbf", gamma="scale", numFourierFeatures=256, maxIter=100, plattFolds=5, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SVMModel":
        from pyspark.ml.stat import Summarizer

        fcol = self.getFeaturesCol()
        data = df.select(F.col(fcol).alias("features"), F.col(self.getLabelCol()).cast("double").alias("label"))
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        n = data.count()
        W = b = None
        if self.getOrDefault(self.kernel) == "rbf":
            s = data.select(Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s")).first()["s"]
            mean = np.asarray(s["mean"].toArray())
            var = np.asarray(s["variance"].toArray()) * ((n - 1) / n if n > 1 else 1.0)
            d = len(mean)
            g = self.getOrDefault(self.gamma)
            if g == "scale":
                total_var = float(np.mean(var + mean ** 2) - np.mean(mean) ** 2)
                gamma = 1.0 / (d * total_var) if total_var > 0 else 1.0
            elif g == "auto":
                gamma = 1.0 / d
            else:
                gamma = float(g)
            rng = np.random.RandomState(self.getOrDefault(self.seed))
            D = self.getOrDefault(self.numFourierFeatures)
            W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(D, d))
            b = rng.uniform(0.0, 2 * math.pi, size=D)
        model = SVMModel(featuresCol=fcol, predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol())
        model._W, model._b = W, b
        # kernel features are far wider than the rows: as many partitions as their bytes need, and each fit holds a copy of them
        size = 8 * n * (len(data.first()["features"]) if W is None else len(W)) if n else 0
        parts = math.ceil(size / KERNEL_PART_BYTES)
        x = model._kernel_features(data.repartition(parts) if parts > data.rdd.getNumPartitions() else data, "features")
        k = self.getOrDefault(self.plattFolds)
        # fold from a hash of the row's values: independent of partitioning and row order
        x = x.withColumn("_fold", F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(k)).cast("int"))
        x = x.persist(StorageLevel.MEMORY_AND_DISK)
        reg = 1.0 / (self.getOrDefault(self.C) * max(n, 1))

        def fit_svc(part):
            return LinearSVC(featuresCol="_kf", labelCol="label", regParam=reg, maxIter=self.getOrDefault(self.maxIter),
                             standardization=False, rawPredictionCol="_raw", predictionCol="_svp").fit(part)

        from concurrent.futures import ThreadPoolExecutor

        # Platt scaling on out-of-fold margins; the k fold fits and the final fit run concurrently, as many as their copies allow
        with ThreadPoolExecutor(max_workers=max(1, min(k + 1, KERNEL_FITS_BYTES // max(1, size)))) as ex:
            full = ex.submit(fit_svc, x)
            folds = [ex.submit(fit_svc, x.filter(F.col("_fold") != f)) for f in range(k)] if k > 1 else []
            svc = full.result()
            fold_models = [fu.result() for fu in folds]
        if fold_models:
            oof = None
            for f, m in enumerate(fold_models):
                part = m.transform(x.filter(F.col("_fold") == f))
                oof = part if oof is None else oof.unionByName(part)
        else:
            oof = svc.transform(x)
        margins = oof.select(array_to_vector(F.array(vector_to_array("_raw")[1])).alias("_m"), "label")
        platt = LogisticRegression(featuresCol="_m", labelCol="label", regParam=0.0, maxIter=100,
                                   predictionCol="_pp", probabilityCol="_ppr", rawPredictionCol="_praw").fit(margins)
        x.unpersist()
        data.unpersist()
        model._svc, model._platt = svc, platt
        return model


class SVMModel(Model, _ClfParams, CompositeModelIO):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", probabilityCol="probability"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._svc = self._platt = None
        self._W = self._b = None

    def _sub_models(self):
        return [self._svc, self._platt]

    def __getattr__(self, name):
        # only a linear kernel has coefficients of the features
        if name == "coefficients" and self.__dict__.get("_svc") is not None and self.__dict__.get("_W") is None:
            return self._svc.coefficients
        raise AttributeError(name)

    def _payload(self):
        return {"W": None if self._W is None else self._W.tolist(), "b": None if self._b is None else self._b.tolist()}

    def _restore(self, subs, payload, path):
        self._svc, self._platt = subs
        self._W = None if payload["W"] is None else np.asarray(payload["W"])
        self._b = None if payload["b"] is None else np.asarray(payload["b"])

    def _kernel_features(self, df: DataFrame, fcol: str) -> DataFrame:
        if self._W is None:
            return df.withColumn("_kf", F.col(fcol))
        rff = _rff_udf(self._W, self._b)
        return df.withColumn("_kf", array_to_vector(rff(vector_to_array(F.col(fcol)))))

    def _transform(self, df: DataFrame) -> DataFrame:
        x = self._kernel_features(df, self.getFeaturesCol())
        svc = self._svc.copy().setFeaturesCol("_kf").setRawPredictionCol("_raw").setPredictionCol("_svp")
        y = svc.transform(x).withColumn("_m", array_to_vector(F.array(vector_to_array("_raw")[1])))
        platt = self._platt.copy().setFeaturesCol("_m").setProbabilityCol("_ppr").setPredictionCol("_pp").setRawPredictionCol("")
        z = platt.transform(y)
        return (z.withColumn(self.getProbabilityCol(), F.col("_ppr"))
                .withColumn(self.getPredictionCol(), (vector_to_array("_raw")[1] > 0).cast("double"))
                .drop("_kf", "_raw", "_svp", "_m", "_ppr", "_pp"))


# ------------------------------------------------------------------------------------------
# kNN classifier
# ------------------------------------------------------------------------------------------
class KNNClassifier(Estimator, _ClfParams, CompositeModelIO):
    k = Param(Params._dummy(), "k", "neighbours", typeConverter=TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "'uniform' or 'distance'", typeConverter=TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique integer row id", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", k=5, weights="uniform", idCol="id", seed=42):
        super().__init__()
        self._setDefault(k=5, weights="uniform", idCol="id", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KNNModel":
        pts = df.select(F.col(self.getOrDefault(self.idCol)).cast("bigint").alias("_pid"),
                        F.col(self.getFeaturesCol()).alias("_f"), F.col(self.getLabelCol()).cast("double").alias("_y"))
        m = KNNModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                     probabilityCol=self.getProbabilityCol(), k=self.getOrDefault(self.k),
                     weights=self.getOrDefault(self.weights), idCol=self.getOrDefault(self.idCol))
        m._points = pts
        return m


class KNNModel(Model, _ClfParams, CompositeModelIO):
    k = KNNClassifier.k
    weights = KNNClassifier.weights
    idCol = KNNClassifier.idCol

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", probabilityCol="probability",
                 k=5, weights="uniform", idCol="id"):
        super().__init__()
        self._setDefault(k=5, weights="uniform", idCol="id")
        self._set(**self._input_kwargs)
        self._points = None

    def _save_extra(self, path):
        self._points.write.mode("overwrite").parquet(f"{path}/points")

    def _restore(self, subs, payload, path):
        from pyspark.sql import SparkSession

        self._points = SparkSession.active().read.parquet(f"{path}/points")

    def predictions_of(self, df: DataFrame, points: list[tuple[int, str]]) -> DataFrame:
        """Predictions ``_at0``, ``_at1``, ... of several (k, weights), from one join with the largest k.

        The first k of a query's neighbours are its k neighbours, so each column equals that of a model fitted for its point.
        """
        from retentio.operators.knn import knn_join

        idc = self.getOrDefault(self.idCol)
        nb = knn_join(df, self._points, k=max(k for k, _ in points), query_id=idc, point_id="_pid", features=self.getFeaturesCol(), point_features="_f")
        nb = nb.join(self._points.select("_pid", "_y"), nb.neighbor_id == F.col("_pid"))
        # zero distance: only the exact matches vote, and they are the first neighbours
        zero = F.min("distance").over(Window.partitionBy("query_id")) == 0
        near = F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("distance"))
        nb = nb.withColumn("_near", near)
        sums = []
        for i, (k, weights) in enumerate(points):
            w = F.when(F.col("rank") <= k, F.col("_near") if weights == "distance" else F.lit(1.0))
            sums.append((F.sum(w * F.col("_y")) / F.sum(w)).alias(f"_at{i}"))
        votes = nb.groupBy("query_id").agg(*sums)
        out = df.join(votes, df[idc].cast("bigint") == votes.query_id, "left").drop("query_id")
        return out.withColumns({f"_at{i}": (F.coalesce(F.col(f"_at{i}"), F.lit(0.0)) > 0.5).cast("double") for i in range(len(points))})

    def _transform(self, df: DataFrame) -> DataFrame:
        from retentio.operators.knn import knn_join

        idc = self.getOrDefault(self.idCol)
        k = self.getOrDefault(self.k)
        nb = knn_join(df, self._points, k=k, query_id=idc, point_id="_pid", features=self.getFeaturesCol(),
                      point_features="_f")
        nb = nb.join(self._points.select("_pid", "_y"), nb.neighbor_id == F.col("_pid"))
        if self.getOrDefault(self.weights) == "distance":
            # zero distance: only the exact matches vote (as the library does)
            zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
            w = F.when(zero == 1, (F.col("distance") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("distance"))
        else:
            w = F.lit(1.0)
        nb = nb.withColumn("_wt", w)
        votes = nb.groupBy("query_id").agg((F.sum(F.col("_wt") * F.col("_y")) / F.sum("_wt")).alias("_p1"))
        out = df.join(votes, df[idc].cast("bigint") == votes.query_id, "left").drop("query_id")
        p = F.coalesce(F.col("_p1"), F.lit(0.0))
        return (out.withColumn(self.getProbabilityCol(), _prob_vector(p))
                .withColumn(self.getPredictionCol(), (p > 0.5).cast("double")).drop("_p1"))


# ------------------------------------------------------------------------------------------
# Stacking: rf + gb + lr -> lr on out-of-fold probabilities
# ------------------------------------------------------------------------------------------
def _base_estimators(seed: int, n_rows: int):
    """The base models; the regression's penalty is that of C = 1: 1 / (C * rows)."""
    return [
        ("rf", RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed)),
        ("gb", GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed)),
        ("lr", LogisticRegression(maxIter=100, regParam=1.0 / max(n_rows, 1), standardization=False)),
    ]


def _apply_base(models, df: DataFrame, fcol: str) -> DataFrame:
    out = df
    for name, m in models:
        mm = m.copy()
        mm.setFeaturesCol(fcol).setPredictionCol(f"_{name}_pred").setProbabilityCol(f"_{name}_prob").setRawPredictionCol(f"_{name}_raw")
        out = mm.transform(out).withColumn(f"_{name}_p", p1(f"_{name}_prob")).drop(f"_{name}_pred", f"_{name}_prob", f"_{name}_raw")
    return out


class StackingClassifier(Estimator, _ClfParams, CompositeModelIO):
    numFolds = Param(Params._dummy(), "numFolds", "folds for out-of-fold predictions", typeConverter=TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "row key for the fold hash", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", numFolds=5, idCol="student_id", seed=42):
        super().__init__()
        self._setDefault(numFolds=5, idCol="student_id", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "StackingModel":
        from retentio.operators.split import assign_folds

        fcol, lcol = self.getFeaturesCol(), self.getLabelCol()
        seed, k = self.getOrDefault(self.seed), self.getOrDefault(self.numFolds)
        data = df.select(F.col(self.getOrDefault(self.idCol)).alias("_key"), F.col(fcol).alias("_f"),
                         F.col(lcol).cast("double").alias("_y"))
        data = assign_folds(data, "_y", "_key", k, seed, exact=True).persist(StorageLevel.MEMORY_AND_DISK)
        from concurrent.futures import ThreadPoolExecutor

        def fit_on(tr):
            return [(n, e.copy().setFeaturesCol("_f").setLabelCol("_y").fit(tr)) for n, e in _base_estimators(seed, tr.count())]

        # the k fold fits and the final refit are independent jobs: run them concurrently
        with ThreadPoolExecutor(max_workers=k + 1) as ex:
            futs = [ex.submit(fit_on, data.filter(F.col("fold") != f)) for f in range(k)]
            full = ex.submit(fit_on, data)
            fold_models = [fu.result() for fu in futs]
            base = full.result()
        oof = None
        for f, fitted in enumerate(fold_models):
            part = _apply_base(fitted, data.filter(F.col("fold") == f), "_f").select("_key", "_y", "_rf_p", "_gb_p", "_lr_p")
            oof = part if oof is None else oof.unionByName(part)
        meta_in = VectorAssembler(inputCols=["_rf_p", "_gb_p", "_lr_p"], outputCol="_meta").transform(oof)
        meta = LogisticRegression(featuresCol="_meta", labelCol="_y", maxIter=100, regParam=1.0 / max(data.count(), 1), standardization=False).fit(meta_in)
        data.unpersist()
        model = StackingModel(featuresCol=fcol, predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol())
        model._base, model._meta = base, meta
        return model


class StackingModel(Model, _ClfParams, CompositeModelIO):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", probabilityCol="probability"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._base: list = []
        self._meta = None

    def _sub_models(self):
        return [m for _, m in self._base] + [self._meta]

    def _payload(self):
        return {"names": [n for n, _ in self._base]}

    def _restore(self, subs, payload, path):
        self._base = list(zip(payload["names"], subs[:-1]))
        self._meta = subs[-1]

    def _transform(self, df: DataFrame) -> DataFrame:
        x = _apply_base(self._base, df, self.getFeaturesCol())
        x = VectorAssembler(inputCols=["_rf_p", "_gb_p", "_lr_p"], outputCol="_meta").transform(x)
        meta = self._meta.copy().setFeaturesCol("_meta").setPredictionCol(self.getPredictionCol()) \
            .setProbabilityCol(self.getProbabilityCol()).setRawPredictionCol("_meta_raw")
        return meta.transform(x).drop("_rf_p", "_gb_p", "_lr_p", "_meta", "_meta_raw")


__all__ = ["AdaBoostClassifier", "AdaBoostModel", "SVMClassifier", "SVMModel", "KNNClassifier", "KNNModel",
           "StackingClassifier", "StackingModel", "p1", "DecisionTreeClassificationModel", "LinearSVCModel",
           "LogisticRegressionModel"]
