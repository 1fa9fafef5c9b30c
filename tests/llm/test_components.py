import random

from retentio.llm.components import connected_components


def slow(edges):
    parent = {}

    def root(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {n: root(n) for n in parent}


def found(spark, edges):
    df = spark.createDataFrame([(*e, 1) for e in edges], "a long, b long, node long")
    return {r.node: r.component for r in connected_components(df, "a", "b").collect()}


def test_chains_stars_loops_and_nulls(spark):
    rng = random.Random(1)
    chain = list(range(1000, 1080))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, i) for i in range(6, 300)] + [(7777, 7777), (None, 3), (3, None), (-4, -9), (-4, -9), (-9, -4)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    assert found(spark, edges) == slow(edges)


def test_empty(spark):
    assert found(spark, []) == {}
