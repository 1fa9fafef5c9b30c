import threading

import numpy as np
from pyspark.ml.linalg import Vectors

from retentio.ml import estimators


def test_kernel_features_are_dealt_by_their_bytes_and_fits_wait(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, Vectors.dense(v), float(v[0] * v[1] > 0)) for i, v in enumerate(rng.normal(size=(240, 4)))]
    x = spark.createDataFrame(rows, ["row_id", "features", "label"]).coalesce(2)
    seen, running, most, lock = [], [0], [0], threading.Lock()

    class Watched(estimators.LinearSVC):
        def fit(self, part):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
                seen.append(part.rdd.getNumPartitions())
            out = super().fit(part)
            with lock:
                running[0] -= 1
            return out

    monkeypatch.setattr(estimators, "LinearSVC", Watched)
    est = estimators.SVMClassifier(numFourierFeatures=32, maxIter=5, plattFolds=2)
    p = [r["p"] for r in est.fit(x).transform(x).orderBy("row_id").select(estimators.p1().alias("p")).collect()]
    assert seen == [2, 2, 2]
    size = 8 * 240 * 32
    monkeypatch.setattr(estimators, "KERNEL_PART_BYTES", size // 6)
    monkeypatch.setattr(estimators, "KERNEL_FITS_BYTES", size)
    seen.clear()
    most[0] = 0
    again = [r["p"] for r in est.fit(x).transform(x).orderBy("row_id").select(estimators.p1().alias("p")).collect()]
    assert seen == [6, 6, 6] and most[0] == 1
    assert np.allclose(p, again, atol=1e-3)
