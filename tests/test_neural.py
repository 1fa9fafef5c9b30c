import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retentio.ml import neural as N
from retentio.ml.registry import grid_points, make_estimator


def data(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1.2)).astype(float)  # no straight line parts these
    return x, y, spark.createDataFrame([(i, Vectors.dense(r), float(t)) for i, (r, t) in enumerate(zip(x, y))], ["id", "features", "label"])


@pytest.mark.parametrize("activation", ["relu", "tanh"])
@pytest.mark.parametrize("hidden", [[5], [4, 3], []])
def test_gradients_equal_finite_differences(activation, hidden):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (30, 6)), rng.integers(0, 2, 30).astype(float)
    layers = N.shapes(6, hidden)
    theta = N.initial(layers, 3)

    def whole(t):
        return N.gradient(x, y, t, layers, activation)[0] + N.penalty(t, layers, 0.3)[0]

    slope = N.gradient(x, y, theta, layers, activation)[1] + N.penalty(theta, layers, 0.3)[1]
    h = 1e-6
    near = np.array([(whole(theta + h * e) - whole(theta - h * e)) / (2 * h) for e in np.eye(len(theta))])
    assert np.allclose(slope, near, rtol=1e-5, atol=1e-6)


def local_fit(x, y, hidden, activation, alpha, epochs, rate, seed):
    """Adam on all rows at once, without Spark."""
    layers = N.shapes(x.shape[1], hidden)
    theta = N.initial(layers, seed)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        g = N.gradient(x, y, theta, layers, activation)[1] / len(x) + N.penalty(theta, layers, alpha / len(x))[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    return theta


def test_weights_equal_a_fit_on_one_machine(spark):
    x, y, df = data(spark, 700)
    made = [N.NeuralNetworkClassifier(hidden=[6], activation="tanh", alpha=0.5, maxIter=12, stepSize=0.05, tol=-1.0, seed=5).fit(d)
            for d in (df.repartition(5), df.orderBy("label").coalesce(1))]
    want = local_fit(x, y, [6], "tanh", 0.5, 12, 0.05, 5)
    for m in made:
        assert np.allclose(m._theta, want, rtol=1e-6, atol=1e-8)
        assert len(m.losses) == 12 and m.losses[-1] < m.losses[0]


def test_learns_what_a_line_cannot_and_comes_back(spark, tmp):
    _, _, df = data(spark)
    m = N.NeuralNetworkClassifier(hidden=[20], stepSize=0.03, maxIter=120).fit(df)
    got = m.transform(df)
    assert got.filter(F.col("prediction") == F.col("label")).count() / 600 > 0.9
    m.write().overwrite().save(f"{tmp}/m")
    back = N.NeuralNetworkModel.read().load(f"{tmp}/m").transform(df)
    key = lambda d: sorted((r["id"], r["prediction"], tuple(r["probability"])) for r in d.collect())
    assert key(back) == key(got)


def test_batches_and_a_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(N, "FAN_IN", 2)
    monkeypatch.setattr(N, "ROWS", 40)
    _, _, df = data(spark, 3000)
    m = N.NeuralNetworkClassifier(hidden=[10], batchRows=700, stepSize=0.03, maxIter=15).fit(df)
    assert m.losses[-1] < 0.8 * m.losses[0]


def test_no_rows_and_unknown_activation(spark):
    _, _, df = data(spark, 10)
    with pytest.raises(ValueError, match="no rows"):
        N.NeuralNetworkClassifier().fit(df.limit(0))
    with pytest.raises(ValueError, match="activation"):
        N.NeuralNetworkClassifier(activation="cubic").fit(df)


def test_grid_has_every_point_of_the_model():
    points = grid_points("neural_network")
    assert len(points) == 18 and len({str(p) for p in points}) == 18
    e = make_estimator("neural_network", n_features=3, n_rows=10, **points[-1])
    assert (e.getOrDefault(e.hidden), e.getOrDefault(e.activation), e.getOrDefault(e.alpha)) == ([50, 50], "tanh", 0.01)
