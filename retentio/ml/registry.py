"""Model registry and hyper-parameter grids.

Names and defaults follow the reference's model list; Spark equivalents:
logistic regression (C -> regParam = 1 / (C * n)), random forest (100 trees, unlimited
depth -> Spark's maximum 30), gradient boosting (100 rounds, step 0.1, depth 3), AdaBoost
(50 stumps), SVM (rbf, Platt probabilities), kNN (k = 5), decision tree, a neural network
with one hidden layer of 100 (relu, L2 term, Adam), and stacking (rf + gb + lr -> lr).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)

from retentio.ml.estimators import AdaBoostClassifier, KNNClassifier, SVMClassifier, StackingClassifier
from retentio.ml.forest import ForestClassifier
from retentio.ml.neural import NeuralNetworkClassifier

# --- fixed values: model names, grids and defaults -----------------------------------------------
MAX_DEPTH = 30  # Spark's limit; stands for "unlimited"
# rows keep the node they are at: a level of a deep tree neither sends the tree to the tasks nor goes down it again
DEEP = {"cacheNodeIds": True}
# up to so many rows Spark grows deep trees: their nodes are few. Beyond, statistics and driver memory of a node of a few rows cost too much
SPARK_TREE_ROWS = 20_000

MODEL_NAMES = ("logistic_regression", "random_forest", "gradient_boosting", "adaboost", "svm", "knn",
               "decision_tree", "neural_network", "stacking")


def make_estimator(name: str, *, n_features: int, n_rows: int, label: str = "label", features: str = "features",
                   id_col: str = "row_id", key_col: str = "student_id", seed: int = 42, **params) -> Estimator:
    """A fresh estimator for a registered model name (unknown name -> ValueError)."""
    common = {"featuresCol": features, "labelCol": label}
    if name == "logistic_regression":
        c = params.get("C", 1.0)
        return LogisticRegression(maxIter=1000, regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0,
                                  standardization=False, **common)
    if name in ("random_forest", "decision_tree") and n_rows > SPARK_TREE_ROWS:
        return ForestClassifier(numTrees=params.get("n_estimators", 100) if name == "random_forest" else 1,
                                maxDepth=params.get("max_depth") or MAX_DEPTH,
                                minInstancesPerNode=max(1, params.get("min_samples_split", 2) // 2),
                                impurity=params.get("criterion", "gini"), seed=seed, **common)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=params.get("n_estimators", 100),
                                      maxDepth=params.get("max_depth") or MAX_DEPTH,
                                      minInstancesPerNode=max(1, params.get("min_samples_split", 2) // 2), seed=seed, **DEEP, **common)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=params.get("n_estimators", 100), stepSize=params.get("learning_rate", 0.1),
                             maxDepth=params.get("max_depth", 3), seed=seed, **common)
    if name == "adaboost":
        return AdaBoostClassifier(numRounds=params.get("n_estimators", 50), learningRate=params.get("learning_rate", 1.0),
                                  seed=seed, **common)
    if name == "svm":
        return SVMClassifier(C=params.get("C", 1.0), kernel=params.get("kernel", "rbf"),
                             gamma=str(params.get("gamma", "scale")), seed=seed, **common)
    if name == "knn":
        return KNNClassifier(k=params.get("n_neighbors", 5), weights=params.get("weights", "uniform"), idCol=id_col,
                             **common)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=params.get("max_depth") or MAX_DEPTH,
                                      minInstancesPerNode=max(1, params.get("min_samples_split", 2) // 2),
                                      impurity=params.get("criterion", "gini"), seed=seed, **DEEP, **common)
    if name == "neural_network":
        return NeuralNetworkClassifier(hidden=list(params.get("hidden_layer_sizes", (100,))), activation=params.get("activation", "relu"),
                                       alpha=params.get("alpha", 0.0001), seed=seed, **common)
    if name == "stacking":
        return StackingClassifier(idCol=key_col, seed=seed, **common)
    raise ValueError(f"unknown model {name!r}; available: {', '.join(MODEL_NAMES)}")


# Grids of the reference (parameters Spark has no counterpart for are left out).
PARAM_GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10, 100]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [None, 10, 20, 30],
                      "min_samples_split": [2, 5, 10]},
    "gradient_boosting": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
    "adaboost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 1.0]},
    "svm": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
    "knn": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"]},
    "decision_tree": {"max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10],
                      "criterion": ["gini", "entropy"]},
    "neural_network": {"hidden_layer_sizes": [(50,), (100,), (50, 50)], "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001, 0.01]},
}


def grid_points(name: str) -> list[dict]:
    """Every parameter combination of a model's grid ([] when it has none, e.g. stacking)."""
    g = PARAM_GRIDS.get(name)
    if not g:
        return []
    keys = list(g)
    points = [dict(zip(keys, vals)) for vals in product(*(g[k] for k in keys))]
    # "unlimited" depth is Spark's largest one, and only half of min_samples_split counts: equal fits once
    same = {json.dumps({k: _effective(k, v) for k, v in p.items()}): p for p in reversed(points)}
    return [p for p in points if any(p is x for x in same.values())]


def _effective(name: str, value):
    if name == "max_depth":
        return value or MAX_DEPTH
    return max(1, value // 2) if name == "min_samples_split" else value


def registry() -> dict[str, Callable[..., Estimator]]:
    return {n: (lambda n=n, **kw: make_estimator(n, **kw)) for n in MODEL_NAMES}
