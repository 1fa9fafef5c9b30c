import hashlib
import math

import numpy as np
import pytest

from retentio.llm import simplex_kmeans as K


def slow(rows, k=8, rounds=10, size=64, by=1024.0, limit=1 << 27):
    kept = [(i, [math.floor(max(min(x * by, float(limit)), -float(limit))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for i, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = [sum(d for _, n, d in got if n == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, min(own[c], K.LONG), min(sum(own), K.LONG), names[c]) for i, c, d in got), key=str)


def found(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(3)
    out = K.cluster(df, **args)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.3, 64)).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(400, 440)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("-inf")] * 64)]
    assert found(spark, rows) == slow(rows)


@pytest.mark.parametrize("pivots", [1, 2, 5])
def test_other_sizes_ties_and_few_vectors(spark, pivots):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(24)]
    assert found(spark, rows, k=4, rounds=3, size=2, by=2.0, pivots=pivots) == slow(rows, 4, 3, 2, 2.0)
    assert found(spark, rows[:3], k=4, rounds=0, size=2, by=2.0, pivots=pivots) == slow(rows[:3], 4, 0, 2, 2.0)
    same = [(i, [0.5, -0.5]) for i in range(9)]
    assert found(spark, same, k=3, rounds=2, size=2, pivots=pivots) == slow(same, 3, 2, 2)
    assert found(spark, [], size=2) == [] and found(spark, [(1, None)], size=2) == []


def test_huge_components_have_a_defined_result(spark):
    rows = [(i, [float(i), -float(i)]) for i in range(20)] + [(50, [1e300, -1e300]), (51, [1e9, 3.0]), (52, [-1e300, 1e300])]
    assert found(spark, rows, k=3, rounds=4, size=2) == slow(rows, 3, 4, 2)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    for scale in (1, 1000, 1 << 20):
        v = (rng.normal(0, 1, (400, 64)) * scale).astype(np.int64)
        near = v[:20] + rng.integers(-3, 4, (20, 64))
        s = K.Simplex(np.concatenate((v[:60], v[:2], v[:1] + v[1:2] - v[2:3])))  # repeated and dependent pivots
        assert 60 <= len(s.pivots) <= 61
        low, high = K.bounds(s.apexes(v), s.apexes(near), s.gain)
        exact = np.stack([K.squared(v, c) for c in near], axis=1)
        assert (low <= exact).all() and (exact <= high).all()
        assert (low <= high.min(axis=1, keepdims=True)).mean() < 0.5


def test_far_vectors_over_close_pivots_stay_exact():
    rng = np.random.default_rng(3)
    pivots = 10**6 + rng.integers(-2, 3, (16, 64))
    v = rng.integers(-(1 << 27), 1 << 27, (200, 64))
    centroids = np.concatenate((v[:4] + 1, v[:4] - 1, pivots[:2]))
    s = K.Simplex(pivots)
    want = [min((int(K.squared(r[None], c)[0]), n) for n, c in enumerate(centroids))[1] for r in v]
    assert K.nearest(v, s.apexes(v), centroids, s).tolist() == want
