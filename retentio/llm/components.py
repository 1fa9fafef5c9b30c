"""Connected components as alternating large-star / small-star steps on DataFrames.

Edges stay distributed; each round is cut by a reliable ``checkpoint()`` in the shared folder.
The minimum per node is a partially aggregated ``groupBy``, and the join that sends it to the
node's neighbours is left to AQE's skew split, so a node with very many neighbours is no
single task. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import checkpointed


def _minimum(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = _minimum(e)
    moved = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Columns ``a`` and ``b`` hold nodes of one orderable type (long or string). Edges with a
    null end are ignored, repeated edges count once; a node that only has an edge to itself
    is its own component. An empty table gives an empty result.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    e = checkpointed(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    loops = e.filter("u = v").select(F.col("u").alias("node"))
    e = e.filter("u <> v")
    seen = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        e = checkpointed(_small_star(_large_star(e)))
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).unionByName(loops).distinct()
    alone = roots.join(members.select("node"), "node", "left_anti")
    return members.unionByName(alone.select("node", F.col("node").alias("component")))
