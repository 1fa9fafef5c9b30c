"""Train, tune, cross-validate, score and explain dropout models.

The whole flow stays on the executors: the feature pipeline and the model are one
``PipelineModel`` fitted on the training split only (no leakage into the test split or
the validation folds), predictions are DataFrames, and only metric rows and model
parameters come back to the driver.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.bins import RISK_LEVELS, risk_level
from retentio.ml.estimators import boosted_predictions_of, p1
from retentio.ml.registry import grid_points, make_estimator
from retentio.operators.evaluation import binary_metrics, roc_auc
from retentio.operators.features import ID_NAMES, add_features, build_feature_pipeline, feature_kinds, feature_names
from retentio.operators.running import exact_quantiles
from retentio.operators.split import assign_folds, stratified_split

HELPER_COLS = ("label", "row_id", "split", "fold")
#: Rows of a task of an iterative learner: at least, where there are as many; and at most, once there is a task per slot.
ROWS_PER_TASK, MOST_ROWS = 20_000, 2_000_000


def prepare(students: DataFrame, target: str = "dropout", key: str = "student_id") -> DataFrame:
    """Derived features + ``label`` (when the target exists) + integer ``row_id`` from the key."""
    df = add_features(students)
    if target in df.columns:
        df = df.withColumn("label", F.col(target).cast("double"))
    return df.withColumn("row_id", F.xxhash64(F.col(key)))


def training_rows(x: DataFrame, n: int) -> DataFrame:
    """``x`` of ``n`` rows in as many partitions as its rows need, not as many as the shuffle before it had.

    A learner runs all partitions once per iteration or tree level, and each of them sends statistics of every open
    node, however few its rows. Open nodes grow with the rows, so partitions that did too would send their square:
    beyond one for each slot of the cluster there are more only where a partition would be too large to hold.
    """
    slots = max(2, x.sparkSession.sparkContext.defaultParallelism)
    return x.coalesce(max(1, min(math.ceil(n / ROWS_PER_TASK), slots), math.ceil(n / MOST_ROWS)))


def fit_pipeline(train_df: DataFrame, model: str = "random_forest", target: str = "dropout", key: str = "student_id",
                 seed: int = 42, params: dict | None = None) -> PipelineModel:
    """Fit features + model on ``train_df`` and return one PipelineModel."""
    # iterative learners scan their input once per iteration / tree level: cache it
    src = train_df.persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = src.count()
    rows = training_rows(src, n_rows)
    feats = build_feature_pipeline(rows, target=target, ids=(*ID_NAMES, key, *HELPER_COLS)).fit(rows)
    x = feats.transform(src if model == "knn" else rows).persist(StorageLevel.MEMORY_AND_DISK)
    width = x.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    if width is None:
        width = len(x.select("features").first()[0])
    est = make_estimator(model, n_features=int(width), n_rows=n_rows, key_col=key, seed=seed, **(params or {}))
    fitted = est.fit(x)
    # a kNN model refers to its training rows: it derives them again when it is used, so no fit keeps a cache
    x.unpersist()
    src.unpersist()
    return PipelineModel(stages=[*feats.stages, fitted])


def evaluate(model: PipelineModel, df: DataFrame) -> dict:
    """Accuracy, precision, recall, F1 and ROC AUC of ``model`` on ``df`` (one small job each)."""
    pred = model.transform(df).select("label", "prediction", p1("probability").alias("score"))
    pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
    m = binary_metrics(pred, "label", "prediction").first().asDict()
    m["roc_auc"] = roc_auc(pred, "label", "score").first()["roc_auc"]
    pred.unpersist()
    return m


def cross_validate(data: DataFrame, model: str = "random_forest", k: int = 5, target: str = "dropout",
                   key: str = "student_id", seed: int = 42, params: dict | None = None,
                   parallelism: int = 5) -> DataFrame:
    """k-fold accuracy: one row per fold (fold, accuracy), folds stratified by the label."""
    spark = data.sparkSession
    d = assign_folds(data, "label", key, k, seed, exact=True).persist(StorageLevel.MEMORY_AND_DISK)

    def one(f):
        m = fit_pipeline(d.filter(F.col("fold") != f), model, target, key, seed, params)
        return f, float(evaluate(m, d.filter(F.col("fold") == f))["accuracy"])

    # folds are independent Spark jobs: submit them concurrently (CrossValidator-style parallelism)
    with ThreadPoolExecutor(max_workers=min(k, parallelism)) as ex:
        rows = list(ex.map(one, range(k)))
    d.unpersist()
    return spark.createDataFrame(rows, "fold int, accuracy double")


#: Parameters of which the largest fit answers all: more rounds begin with fewer, more neighbours with the nearest.
NESTED = {"knn": ("n_neighbors", "weights"), "adaboost": ("n_estimators",), "gradient_boosting": ("n_estimators",)}


def nested_groups(model: str, grid: list[dict]) -> list[list[int]]:
    """Grid points that one fit answers, the largest last in each group."""
    nested = NESTED.get(model, ())
    groups: dict[str, list[int]] = {}
    for i, point in enumerate(grid):
        rest = json.dumps({k: v for k, v in point.items() if k not in nested}, default=str) if nested else str(i)
        groups.setdefault(rest, []).append(i)
    size = lambda i: [grid[i].get(k, 0) for k in nested if k != "weights"]
    return [sorted(g, key=size) for g in groups.values()]


def _nested_f1(model: str, fitted, test: DataFrame, points: list[dict]) -> list[float]:
    """F1 of each point from one fit and one pass over the test rows."""
    if model == "knn":
        pred = fitted.predictions_of(test, [(p["n_neighbors"], p["weights"]) for p in points])
    elif model == "adaboost":
        pred = fitted.predictions_of(test, [p["n_estimators"] for p in points])
    else:
        pred = boosted_predictions_of(fitted, test, [p["n_estimators"] for p in points])
    y = F.col("label") == 1
    cells = []
    for i in range(len(points)):
        hit = F.col(f"_at{i}") == 1
        cells += [F.count_if(y & hit).alias(f"tp{i}"), F.count_if(~y & hit).alias(f"fp{i}"), F.count_if(y & ~hit).alias(f"fn{i}")]
    r = pred.agg(*cells).first()
    return [2 * r[f"tp{i}"] / n if (n := 2 * r[f"tp{i}"] + r[f"fp{i}"] + r[f"fn{i}"]) else 0.0 for i in range(len(points))]


def tune(train_df: DataFrame, model: str, k: int = 3, target: str = "dropout", key: str = "student_id",
         seed: int = 42, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """Grid search scored by the positive-class F1 over k stratified folds.

    The feature pipeline is fitted once per fold (on that fold's training part) and both
    sides are cached. Grid points that differ only in rounds, neighbours or their weighting share
    one fit (``NESTED``), which is scored for all of them in one pass; each group runs
    concurrently (``parallelism`` Spark jobs at a time), like CrossValidator. Returns the
    best parameters and a DataFrame (params json, mean_f1).
    """
    spark = train_df.sparkSession
    grid = grid_points(model)
    if not grid:
        return {}, spark.createDataFrame([], "params string, mean_f1 double")
    d = assign_folds(train_df, "label", key, k, seed + 1, exact=True).persist(StorageLevel.MEMORY_AND_DISK)
    folds = []
    for f in range(k):
        tr_f, te_f = d.filter(F.col("fold") != f), d.filter(F.col("fold") == f)
        rows = training_rows(tr_f, tr_f.count())
        feats = build_feature_pipeline(rows, target=target, ids=(*ID_NAMES, key, *HELPER_COLS)).fit(rows)
        xtr = feats.transform(tr_f if model == "knn" else rows).persist(StorageLevel.MEMORY_AND_DISK)
        xte = feats.transform(te_f).persist(StorageLevel.MEMORY_AND_DISK)
        width = xtr.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or len(xtr.first()["features"])
        folds.append((xtr, xte, int(width), xtr.count()))

    def score(group):
        """Mean F1 over the folds of each point of a group that shares its fits."""
        total = [0.0] * len(group)
        for xtr, xte, width, n in folds:
            largest = grid[group[-1]]
            est = make_estimator(model, n_features=width, n_rows=n, key_col=key, seed=seed, **largest)
            fitted = est.fit(xtr)
            if len(group) == 1:
                f1s = [float(evaluate(PipelineModel(stages=[fitted]), xte)["f1"])]
            else:
                f1s = _nested_f1(model, fitted, xte, [grid[i] for i in group])
            total = [t + f for t, f in zip(total, f1s, strict=True)]
        return [t / len(folds) for t in total]

    groups = nested_groups(model, grid)
    scores = [0.0] * len(grid)
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        for group, found in zip(groups, ex.map(score, groups), strict=True):
            for i, f1 in zip(group, found, strict=True):
                scores[i] = f1
    for xtr, xte, _, _ in folds:
        xtr.unpersist()
        xte.unpersist()
    d.unpersist()
    best = grid[max(range(len(grid)), key=lambda i: scores[i])]
    res = spark.createDataFrame([(json.dumps(g, default=str), s) for g, s in zip(grid, scores)],
                                "params string, mean_f1 double")
    return best, res


def train(students: DataFrame, model: str = "random_forest", target: str = "dropout", key: str = "student_id",
          test_size: float = 0.2, hyperparameter_tuning: bool = False, seed: int = 42, cv_folds: int = 5,
          exact_split: bool = True) -> tuple[PipelineModel, DataFrame]:
    """Split -> (tune) -> fit -> test metrics -> k-fold CV accuracy. Returns (model, one metrics row)."""
    spark = students.sparkSession
    t0 = time.time()
    data = prepare(students, target, key)
    data = stratified_split(data, "label", key, test_size, seed, exact=exact_split).persist(StorageLevel.MEMORY_AND_DISK)
    tr = data.filter(F.col("split") == "train")
    te = data.filter(F.col("split") == "test")
    params: dict = {}
    if hyperparameter_tuning:
        params, _ = tune(tr, model, 3, target, key, seed)
    fitted = fit_pipeline(tr, model, target, key, seed, params)
    m = evaluate(fitted, te)
    if cv_folds and cv_folds > 1:
        cv = cross_validate(data.drop("split"), model, cv_folds, target, key, seed, params)
        cvs = cv.agg(F.avg("accuracy").alias("m"), F.stddev_pop("accuracy").alias("s")).first()
    else:  # cross-validation skipped (reported by cross_validate on its own)
        cvs = {"m": None, "s": None}
    n_train, n_test = tr.count(), te.count()
    data.unpersist()
    row = (model, float(m["accuracy"]), float(m["precision"]), float(m["recall"]), float(m["f1"]),
           None if m["roc_auc"] is None else float(m["roc_auc"]), None if cvs["m"] is None else float(cvs["m"]), None if cvs["m"] is None else float(cvs["s"] or 0.0),
           int(n_train), int(n_test), bool(hyperparameter_tuning), json.dumps(params, default=str), time.time() - t0)
    schema = ("model_name string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
              "cv_accuracy_mean double, cv_accuracy_std double, train_rows long, test_rows long, "
              "hyperparameter_tuning boolean, best_params string, training_time double")
    return fitted, spark.createDataFrame([row], schema)


def score_students(model: PipelineModel, students: DataFrame, target: str = "dropout", key: str = "student_id",
                   labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
    """student_id, dropout_probability, prediction and risk level for every student (and ``split``, if it is there)."""
    pred = model.transform(prepare(students, target, key))
    p = p1("probability")
    split = ["split"] if "split" in students.columns else []
    return pred.select(F.col(key).alias("student_id"), p.alias("dropout_probability"),
                       F.col("prediction").cast("int").alias("prediction"), risk_level(p, labels).alias("risk_level"), *split)


def feature_importance(model: PipelineModel, transformed: DataFrame, col: str = "features",
                       top_n: int | None = None) -> DataFrame:
    """(feature, importance, kind) from the fitted model, largest absolute value first; the first ``top_n`` if given.

    Tree models (boosted stumps among them) give importances, logistic regression and the
    linear SVM their coefficients; other models have none (empty result). ``transformed``
    supplies the vector's slot names.
    """
    spark = transformed.sparkSession
    last = model.stages[-1]
    names = feature_names(transformed, col)
    if hasattr(last, "featureImportances"):
        vals, kind = last.featureImportances.toArray().tolist(), "importance"
    elif hasattr(last, "coefficients"):
        vals, kind = last.coefficients.toArray().tolist(), "coefficient"
    else:
        return spark.createDataFrame([], "feature string, importance double, kind string")
    rows = [(n, float(v), kind) for n, v in zip(names, vals)]
    df = spark.createDataFrame(rows, "feature string, importance double, kind string")
    df = df.orderBy(F.abs("importance").desc(), "feature")
    return df if top_n is None else df.limit(top_n)


def key_factors(students: DataFrame, importance: DataFrame, threshold: float = 0.5, top_features: int = 10,
                top_factors: int = 3, prob: str = "dropout_probability", key: str = "student_id") -> DataFrame:
    """Up to ``top_factors`` reasons per student with probability >= threshold.

    Among the ``top_features`` most important features (largest absolute importance first): a
    numeric column whose value is above that column's median (over all students) gives
    ``"name (value)"``; a one-hot feature ``column_category`` whose column (the longest that fits)
    equals the category gives its name.
    Medians come from the distributed exact quantile operator and enter as literals; the
    factor list is an array expression per row — no join, no shuffle.
    """
    top = [r["feature"] for r in importance.orderBy(F.abs("importance").desc(), "feature").limit(top_features).collect()]
    num_cols = {f.name for f in students.schema.fields if str(f.dataType) in
                ("IntegerType()", "LongType()", "DoubleType()", "FloatType()", "ShortType()")}
    str_cols = [f.name for f in students.schema.fields if str(f.dataType) == "StringType()"]
    cands = []
    base = students
    num_top = [n for n in top if n in num_cols]
    # medians over all students (exact, distributed); a handful of numbers like model parameters
    meds = {r["column_name"]: r["quantile"] for r in exact_quantiles(students, num_top, 0.5).collect()} if num_top else {}
    for name in top:
        if name in num_cols:
            x = F.col(name).cast("double")
            cands.append(F.when(x > F.lit(meds.get(name)).cast("double"),
                                F.concat(F.lit(f"{name} ("), F.format_string("%.2f", x), F.lit(")"))))
        else:
            c = max((c for c in str_cols if name.startswith(f"{c}_")), key=len, default=None)
            if c is not None:
                cands.append(F.when(F.col(c) == F.lit(name[len(c) + 1:]), F.lit(name)))
    p = F.col(prob)
    base = base.withColumn("_cands", F.array(*cands) if cands else F.array().cast("array<string>"))
    lst = F.slice(F.filter(F.col("_cands"), lambda v: v.isNotNull()), 1, top_factors)
    factors = F.when(p >= F.lit(threshold), F.concat_ws(", ", lst))
    return base.select(key, p.alias("dropout_probability"), risk_level(p).alias("risk_level"),
                       factors.alias("key_factors"))


def save_model(model: PipelineModel, path: str, model_name: str, info: dict | None = None) -> None:
    """Save the whole fitted pipeline (features + model) and a one-row metadata table."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    meta = {"model_name": model_name, "saved_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "info": json.dumps(info or {})}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    """Load a saved pipeline; a bare model directory gets its name from the directory name."""
    import os

    spark = SparkSession.active()
    try:
        meta = spark.read.json(f"{path}/metadata").first().asDict()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return PipelineModel.load(path), {"model_name": os.path.basename(path.rstrip("/"))}  # a bare model directory
    return PipelineModel.load(f"{path}/model"), meta


__all__ = ["prepare", "fit_pipeline", "evaluate", "cross_validate", "tune", "train", "score_students",
           "feature_importance", "key_factors", "save_model", "load_model", "feature_kinds"]
