"""Feed-forward network with relu or tanh, an L2 term and Adam, trained over the cluster.

Rows are dealt at random into blocks, and blocks into batches. One step reads one batch: each task adds up the
gradients of its blocks in numpy, partial sums are added up in a tree, and the driver, which holds nothing but
the weights, makes one Adam step. Every step sees the same weights on all tasks, so the result does not depend
on the number of tasks beyond the order of sums. With one batch (the default up to ``batchRows`` rows) a step is an epoch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.ml.composite import CompositeModelIO
from retentio.ml.estimators import _ClfParams, _prob_vector

ACTIVATIONS = ("relu", "tanh")
#: Rows of one block.
ROWS = 4096
#: Partial sums that are added up by one task.
FAN_IN = 64
# Adam
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def shapes(n_features: int, hidden: list[int]) -> list[tuple[int, int]]:
    sizes = [n_features, *hidden, 1]
    return list(zip(sizes, sizes[1:], strict=False))


def unpack(theta: np.ndarray, layers: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of each layer as views of one vector."""
    out, at = [], 0
    for a, b in layers:
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def initial(layers: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Weights and biases uniform within sqrt(6 / (inputs + outputs)) of each layer."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b + b) * math.sqrt(6 / (a + b)) for a, b in layers])


def forward(x: np.ndarray, theta: np.ndarray, layers: list[tuple[int, int]], activation: str) -> tuple[list[np.ndarray], np.ndarray]:
    """What enters each layer, and the log-odds of class 1."""
    inputs = [x]
    for i, (w, b) in enumerate(unpack(theta, layers)):
        z = inputs[-1] @ w + b
        if i + 1 < len(layers):
            inputs.append(np.maximum(z, 0) if activation == "relu" else np.tanh(z))
    return inputs, z[:, 0]


def gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, layers: list[tuple[int, int]], activation: str) -> tuple[float, np.ndarray]:
    """Sum of the log losses of all rows, and its gradient."""
    inputs, z = forward(x, theta, layers, activation)
    loss = float((np.logaddexp(0, z) - y * z).sum())
    out = np.empty_like(theta)
    grads, weights = unpack(out, layers), unpack(theta, layers)
    delta = (0.5 * (1 + np.tanh(z / 2)) - y)[:, None]  # the logistic function, without overflow
    for i in reversed(range(len(layers))):
        grads[i][0][...] = inputs[i].T @ delta
        grads[i][1][...] = delta.sum(axis=0)
        if i:
            slope = inputs[i] > 0 if activation == "relu" else 1 - inputs[i] ** 2
            delta = (delta @ weights[i][0].T) * slope
    return loss, out


def penalty(theta: np.ndarray, layers: list[tuple[int, int]], alpha: float) -> tuple[float, np.ndarray]:
    """alpha / 2 times the sum of squared weights (biases are free), and its gradient."""
    out = np.zeros_like(theta)
    for (w, _), (g, _) in zip(unpack(theta, layers), unpack(out, layers), strict=True):
        g[...] = alpha * w
    return float(0.5 * theta @ out), out


# ---- tasks --------------------------------------------------------------------------------
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for b in batches:
        y = b.column("y").to_numpy(zero_copy_only=False)
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(y), -1) if len(y) else np.zeros((0, 0))
        for s in range(0, len(y), ROWS):
            place = TaskContext.get().partitionId() + 7919 * at
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "x": pa.array([x[s : s + ROWS].tobytes()], pa.binary()),
                                              "y": pa.array([y[s : s + ROWS].astype("<f8").tobytes()], pa.binary())})
            at += 1


SUMS = "task int, n long, loss double, grad binary"
_SUMS = pa.schema([("task", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("grad", pa.binary())])


def _sums(theta: np.ndarray, layers: list[tuple[int, int]], activation: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: rows, loss and gradient added up."""
    n, loss, grad = 0, 0.0, np.zeros_like(theta)
    for b in batches:
        for xs, ys in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            y = np.frombuffer(ys, "<f8")
            one, g = gradient(np.frombuffer(xs, "<f8").reshape(len(y), -1), y, theta, layers, activation)
            n, loss = n + len(y), loss + one
            grad += g
    if n:
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "n": [n], "loss": [loss], "grad": [grad.tobytes()]}, schema=_SUMS)


def _add(t: pa.Table) -> pa.Table:
    """Partial sums added up in the order of their tasks."""
    rows = sorted(t.to_pylist(), key=lambda r: r["task"])
    grad = sum(np.frombuffer(r["grad"]) for r in rows)
    return pa.Table.from_pydict({"task": [rows[0]["task"]], "n": [sum(r["n"] for r in rows)], "loss": [sum(r["loss"] for r in rows)],
                                 "grad": [grad.tobytes()]}, schema=_SUMS)


class NeuralNetworkClassifier(Estimator, _ClfParams, CompositeModelIO):
    hidden = Param(Params._dummy(), "hidden", "units of each hidden layer", typeConverter=TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "'relu' or 'tanh'", typeConverter=TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "L2 term: alpha / (2 n) times the squared weights", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "epochs at most", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "Adam's step", typeConverter=TypeConverters.toFloat)
    tol = Param(Params._dummy(), "tol", "least gain of an epoch", typeConverter=TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without that gain", typeConverter=TypeConverters.toInt)
    batchRows = Param(Params._dummy(), "batchRows", "rows of a batch, about", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", hidden=None,
                 activation="relu", alpha=1e-4, maxIter=100, stepSize=0.02, tol=1e-4, patience=10, batchRows=1_000_000, seed=42):
        super().__init__()
        self._setDefault(hidden=[100], activation="relu", alpha=1e-4, maxIter=100, stepSize=0.02, tol=1e-4, patience=10, batchRows=1_000_000, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "NeuralNetworkModel":
        get = self.getOrDefault
        activation, alpha = get(self.activation), get(self.alpha)
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation!r}; available: {', '.join(ACTIVATIONS)}")
        rows = df.select(vector_to_array(self.getFeaturesCol(), "float64").alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        # at random, whatever order the rows come in; the hash of a row gives the same order every time
        parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)))
        order = F.xxhash64("x", "y", F.lit(get(self.seed)))
        dealt = rows.repartition(parts, order).sortWithinPartitions(order)
        blocks = dealt.mapInArrow(_blocks, "place long, x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = blocks.agg(F.sum(F.octet_length("y")), F.max(F.octet_length("x") / F.octet_length("y"))).first()
            if not size[0]:
                raise ValueError("no rows to train on")
            n, width = int(size[0]) // 8, int(size[1])
            layers = shapes(width, list(get(self.hidden)))
            theta = initial(layers, get(self.seed))
            n_batches = max(1, math.ceil(n / get(self.batchRows)))
            m, v, step, best, stale, losses = np.zeros_like(theta), np.zeros_like(theta), 0, math.inf, 0, []
            for _ in range(get(self.maxIter)):
                total = 0.0
                for k in range(n_batches):
                    batch = blocks if n_batches == 1 else blocks.filter(F.pmod("place", F.lit(n_batches)) == k)
                    seen, loss, grad = self._sum(batch, parts, theta, layers, activation)
                    if not seen:
                        continue
                    extra, slope = penalty(theta, layers, alpha / seen)
                    grad = grad / seen + slope
                    total += loss + extra * seen
                    step += 1
                    m = BETA1 * m + (1 - BETA1) * grad
                    v = BETA2 * v + (1 - BETA2) * grad**2
                    rate = get(self.stepSize) * math.sqrt(1 - BETA2**step) / (1 - BETA1**step)
                    theta = theta - rate * m / (np.sqrt(v) + EPSILON)
                losses.append(total / n)
                stale = stale + 1 if losses[-1] > best - get(self.tol) else 0
                best = min(best, losses[-1])
                if stale >= get(self.patience):
                    break
        finally:
            blocks.unpersist()
        model = NeuralNetworkModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol())
        model._theta, model._layers, model._activation, model._losses = theta, layers, activation, losses
        return model

    @staticmethod
    def _sum(batch: DataFrame, parts: int, theta: np.ndarray, layers: list[tuple[int, int]], activation: str) -> tuple[int, float, np.ndarray]:
        found = batch.mapInArrow(partial(_sums, theta, layers, activation), SUMS)
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            found = found.groupBy(F.pmod("task", F.lit(parts)).alias("to")).applyInArrow(_add, SUMS)
        rows = sorted(found.collect(), key=lambda r: r["task"])
        return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), sum((np.frombuffer(r["grad"]) for r in rows), np.zeros_like(theta))


class NeuralNetworkModel(Model, _ClfParams, CompositeModelIO):
    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", probabilityCol="probability"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._theta, self._layers, self._activation, self._losses = np.zeros(0), [], ACTIVATIONS[0], []

    def _payload(self):
        return {"theta": self._theta.tolist(), "layers": self._layers, "activation": self._activation, "losses": self._losses}

    def _restore(self, subs, payload, path):
        self._theta, self._losses, self._activation = np.array(payload["theta"]), payload["losses"], payload["activation"]
        self._layers = [tuple(x) for x in payload["layers"]]

    @property
    def losses(self) -> list[float]:
        """Mean loss of each epoch, the L2 term included."""
        return list(self._losses)

    def _transform(self, df: DataFrame) -> DataFrame:
        theta, layers, activation = self._theta, self._layers, self._activation

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(0.5 * (1 + np.tanh(forward(np.stack(x.to_numpy()), theta, layers, activation)[1] / 2)))

        out = df.withColumn("_p1", score(vector_to_array(self.getFeaturesCol(), "float64")))
        return (out.withColumn(self.getProbabilityCol(), _prob_vector(F.col("_p1")))
                .withColumn(self.getPredictionCol(), (F.col("_p1") > 0.5).cast("double")).drop("_p1"))
