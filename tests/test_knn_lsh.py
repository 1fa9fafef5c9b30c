import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import knn_lsh as L
from retentio.operators.knn import knn_join
from retentio.sources import fixtures as fx


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, v.tolist(), 1) for i, v in enumerate(x)], "id long, features array<double>, rank int")


def clustered(n, dim=16, centres=20, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 1, (centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(0, 0.15, (n, dim))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_recall_and_exact_distances(spark, metric):
    x = clustered(1500)
    points, queries = frame(spark, x), frame(spark, x[:200])
    lsh, measured = L.fit_lsh(points, k=5, metric=metric)
    got = L.knn_lsh_join(queries, points, lsh, k=5, exclude_self=True).cache()
    exact = knn_join(queries, points, 5, metric=metric, exclude_self=True)
    assert measured >= 0.95 and L.knn_recall(got, exact) >= 0.9
    rows = got.collect()
    assert sorted({(r["query_id"], r["rank"]) for r in rows}) == [(i, r) for i in range(200) for r in range(1, 6)] and len(rows) == 1000
    for r in rows:
        d = x[r["query_id"]] - x[r["neighbor_id"]]
        assert r["neighbor_id"] != r["query_id"]
        assert r["distance"] == pytest.approx(np.abs(d).sum() if metric == "manhattan" else np.sqrt((d * d).sum()), rel=1e-12, abs=1e-12)


def test_recall_on_the_given_embeddings(spark):
    """Wide clusters: the k-th neighbour is hardly nearer than any point, and recall costs many candidates."""
    points = fx.vectors(spark, "/root/testdata/sf0.01")
    lsh, measured = L.fit_lsh(points, k=5, features="embedding", point_id="vec_id")
    args = dict(query_id="vec_id", point_id="vec_id", features="embedding", exclude_self=True)
    got = L.knn_lsh_join(points, points, lsh, k=5, **args)
    assert measured >= 0.95 and L.knn_recall(got, knn_join(points, points, 5, **args)) >= 0.9


def test_short_queries_are_answered_exactly(spark):
    x = clustered(300)
    far = np.full((3, 16), 50.0) + np.arange(3)[:, None]  # alone in their buckets
    points, queries = frame(spark, x), frame(spark, np.concatenate((x[:5], far)), 1000)
    lsh, _ = L.fit_lsh(points, k=4)
    got = L.knn_lsh_join(queries, points, lsh, k=4).filter("query_id >= 1005")
    want = knn_join(queries.filter("id >= 1005"), points, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = frame(spark, x[:3])
    assert L.knn_lsh_join(queries, few, lsh, k=4).count() == 8 * 3
    assert L.knn_lsh_join(queries, points.limit(0), lsh, k=4).count() == 0
    assert L.knn_lsh_join(queries.limit(0), points, lsh, k=4).count() == 0


def test_hot_bucket_is_dealt_into_cells(spark):
    x = np.concatenate((np.repeat(clustered(1), 400, axis=0), clustered(100, seed=3)))
    points = frame(spark, x)
    lsh, _ = L.fit_lsh(points, k=3)
    got = L.knn_lsh_join(points, points, lsh, k=3, block_rows=50)
    assert L.knn_recall(got, knn_join(points, points, 3)) >= 0.9
    # of equal points the smaller ids are taken, in whatever cell they lie
    assert {r["neighbor_id"] for r in got.filter("query_id < 400").collect()} == {0, 1, 2}


def test_queries_of_a_hot_bucket_are_dealt_too(spark):
    held = spark.createDataFrame([(i, 7) for i in range(90)] + [(i, 8) for i in range(5)], "_id long, _key long")
    asked = spark.createDataFrame([(i, 7) for i in range(900)] + [(i, 8) for i in range(5)], "_id long, _key long")
    h, a = L.dealt(held, asked, 30)
    for side in (h, a):
        sizes = {r["_key"]: r["most"] for r in side.groupBy("_key", "_part", "_ask").count().groupBy("_key").agg(F.max("count").alias("most")).collect()}
        assert sizes[7] < 60 and sizes[8] == 5
    meet = h.select("_key", "_part", "_ask", F.col("_id").alias("p")).join(a.select("_key", "_part", "_ask", F.col("_id").alias("q")), ["_key", "_part", "_ask"])
    assert meet.count() == meet.distinct().count() == 90 * 900 + 25


def test_probes_are_neighbouring_buckets_and_keys_do_not_depend_on_the_batch():
    lsh = L.Lsh(8, 1.0, tables=3, hashes=4, probes=6)
    x = np.random.default_rng(2).normal(0, 1, (50, 8))
    own, probed = lsh.keys(x), lsh.keys(x, 6)
    assert probed.shape == (50, 21) and (probed.reshape(50, 3, 7)[:, :, 0] == own).all()
    assert all(len(set(r)) == 21 for r in probed.tolist())
    assert (np.concatenate([lsh.keys(r[None]) for r in x]) == own).all()


def test_recall_counts_equally_near_points(spark):
    exact = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 1.0), (2, 1, 7, 0.1)], "query_id long, rank int, neighbor_id long, distance double")
    assert L.knn_recall(exact, exact) == 1.0
    assert L.knn_recall(exact.withColumn("neighbor_id", F.lit(9)), exact) == 1.0
    assert L.knn_recall(exact.filter("neighbor_id <> 6"), exact) == pytest.approx(2 / 3)
    assert L.knn_recall(exact.limit(0), exact) == 0.0
