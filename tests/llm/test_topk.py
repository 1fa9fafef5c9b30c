import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import topk as K


def slow(rows, k=5, asks=lambda i: i % 3 == 0):
    clip = lambda x: math.floor(max(min(256 * x, 2.0**50), -(2.0**50)))
    vectors = [(i, [clip(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(vectors):
        if asks(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(vectors) if m != n and len(b) == len(a))[:k]
            out += [(q, r, i, min(max(-s, K.LEAST), K.MOST)) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, data, k=5, **sizes):
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<double>, block int, id long")
    got = K.top_k(df, F.col("vec_id") % 3 == 0, k, **sizes)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("sizes", [{}, {"rows": 16, "queries": 8}])
def test_matches_brute_force(spark, sizes):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(10)]) for i in range(120)]
    rows += [(200 + i, [0.25] * 10) for i in range(40)] + [(300 + i, [-0.1] * 10) for i in range(9)]
    rows += [(400, None), (401, [None] * 10), (402, [float("nan")] * 10), (403, [float("inf")] + [0.0] * 9), (None, [9.0] * 10), (404, []), (405, []), (408, [])]
    rows += [(3, rows[3][1]), (6, [0.01] * 10), (501, [0.5] * 3), (504, [0.1, 0.2, 0.3]), (510, [1.0])]
    assert found(spark, rows, **sizes) == slow(rows)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(3, [1.0, 2.0]), (4, [0.0, -1.0]), (6, [5.0, 5.0])]
    assert found(spark, rows) == slow(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-2**20, 2**20)) for _ in range(4)]) for i in range(12)]
    assert found(spark, rows) == slow(rows)


def test_uniform_threshold_keeps_every_candidate_at_the_cutoff():
    rng = np.random.default_rng(3)
    q, v = rng.integers(-200, 200, (20, 16)).astype(float), rng.integers(-200, 200, (500, 16)).astype(float)
    cell = K.Cell(np.arange(1000, 1020), q, np.arange(500), v)
    gathered = {i: (s, low) for i, s, low in cell.gather(5)}
    for r in range(20):
        scores, low = gathered[r]
        got = list(cell.resolve(5, {r: (scores[-1], low)}))
        want = sorted((-int(s), i) for i, s in enumerate(q[r] @ v.T))[:5]
        assert [(i, s) for _, i, s in got] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("sizes", [{}, {"rows": 2, "queries": 1}])
def test_rows_that_share_an_id_are_rows_of_their_own(spark, sizes, monkeypatch):
    monkeypatch.setattr(K, "MERGED", 2)
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.5, 0.0]), (3, [1.0, 0.0]), (3, [9.0, 0.0]), (6, [1.0, 1.0])] + [(7, [1.0, 0.5])] * 9
    got = found(spark, rows, **sizes)
    assert got == slow(rows)
    assert (3, 1, 3, 256 * 256 * 9) in got and (6, 2, 1, 256 * 256 * 3) in got


def test_components_of_any_size_have_a_defined_result(spark):
    rows = [(3, [1e300, 1.0]), (6, [-1e300, 2.0]), (9, [1e15, -1e15]), (12, [1e300, 1e300]), (4, [1e300, 1e300]), (5, [-1e300, 1e300]), (1, [1.0, 1.0]), (2, [1e10, -1e9]), (7, [0.0, 0.0])]
    assert found(spark, rows) == slow(rows)
    assert found(spark, rows, k=2, rows=2, queries=1) == slow(rows, 2)
