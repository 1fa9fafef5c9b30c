"""Approximate k-nearest-neighbour join by p-stable hash tables with multi-probe.

Each of ``tables`` hash tables cuts ``hashes`` random projections into steps of one width (Gaussian
projections for Euclidean, Cauchy for Manhattan distance); near points fall into one bucket. A point lies in its own
bucket of each table; a query also looks into the ``probes`` buckets whose border is nearest to it. Candidates
are ranked by their exact distances, inside the cell that holds their buckets, so only k rows per
query leave a cell and no pair is ever a row. A bucket with more points or more queries than a cell may hold is dealt into
several cells. A query that finds fewer than k points goes through the exact join.

It is for callers who ask for it: :func:`retentio.operators.knn.knn_join` stays exact at every size. What
recall the tables give depends on the data: :func:`fit_lsh` measures it on a sample, :func:`knn_recall` on a result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.operators import knn
from retentio.session import checkpoint_dir

#: Widths tried by ``fit_lsh``, as multiples of the median distance to the k-th neighbour.
WIDTHS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0)
#: Points and queries of the sample on which it measures.
SAMPLE_POINTS, SAMPLE_QUERIES = 4096, 256
#: A cell of buckets holds rows of many tables at once: this part of an exact join's block.
CELL_SHARE = 4


@dataclass(frozen=True)
class Lsh:
    """Hash tables over vectors of ``dim`` components; all of it follows from these numbers."""

    dim: int
    width: float
    tables: int = 8
    hashes: int = 4
    probes: int = 8
    metric: str = "euclidean"
    seed: int = 7

    def projections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        shape = (self.dim, self.tables * self.hashes)
        a = rng.standard_normal(shape) if self.metric == "euclidean" else rng.standard_cauchy(shape)
        mix = rng.integers(1 << 62, size=self.tables * self.hashes, dtype=np.int64) * 2 + 1
        return a, rng.uniform(0, 1, shape[1]), mix

    def moves(self) -> list[tuple[tuple[int, int], ...]]:
        """Steps of at most two of a table's hashes to a neighbouring cut."""
        one = [(h, s) for h in range(self.hashes) for s in (-1, 1)]
        return [(x,) for x in one] + [(x, y) for x, y in itertools.combinations(one, 2) if x[0] != y[0]]

    def keys(self, v: np.ndarray, probes: int = 0) -> np.ndarray:
        """Bucket keys: of each vector, for each table its own and those of its ``probes`` nearest others."""
        a, shift, mix = self.projections()
        x = (v @ a / self.width + shift).reshape(len(v), self.tables, self.hashes)
        cut = np.floor(x).astype(np.int64)
        mix = mix.reshape(self.tables, self.hashes)
        with np.errstate(over="ignore"):
            own = (cut * mix).sum(axis=2) + np.arange(self.tables, dtype=np.int64) * np.int64(0x2545F4914F6CDD1D)
            if not probes:
                return own
            moves = self.moves()
            after = x - cut  # share of the step behind the lower cut
            cost = np.stack([sum((after[:, :, h] if s < 0 else 1 - after[:, :, h]) ** 2 for h, s in m) for m in moves], axis=2)
            step = np.stack([sum(s * mix[:, h] for h, s in m) for m in moves], axis=1)  # table x move
            n = min(probes, len(moves))
            best = np.argpartition(cost, n - 1, axis=2)[:, :, :n]
            others = own[:, :, None] + np.take_along_axis(np.broadcast_to(step, cost.shape), best, axis=2)
        return np.concatenate((own[:, :, None], others), axis=2).reshape(len(v), -1)


def _recall_of(lsh: Lsh, q: np.ndarray, x: np.ndarray, near: np.ndarray) -> float:
    """Share of the true neighbours that share a bucket with their query."""
    held, asked = lsh.keys(x), lsh.keys(q, lsh.probes)
    return float(np.mean([len(np.intersect1d(held[p], asked[i], assume_unique=False)) > 0 for i, row in enumerate(near) for p in row]))


def fit_lsh(points: DataFrame, k: int = 5, features: str = "features", point_id: str = "id", recall: float = 0.95, tables: int = 8,
            hashes: int = 4, probes: int = 8, metric: str = "euclidean", seed: int = 7) -> tuple[Lsh, float]:
    """Tables with the least width that reaches ``recall`` on a sample of the points, and that recall.

    The sample is fixed by a hash of the ids: ``SAMPLE_POINTS`` points, of which ``SAMPLE_QUERIES`` ask.
    On all points the k nearest are nearer than in the sample, so recall there is seldom lower.
    """
    rows = (points.select(F.col(point_id).cast("bigint").alias("_id"), knn._as_array(features, points).alias("_v"))
            .orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(SAMPLE_POINTS).collect())
    if not rows:
        raise ValueError("no points to fit hash tables on")
    x = np.array([r["_v"] for r in rows], np.float64)
    ids = np.arange(len(x))
    n = min(len(x), SAMPLE_QUERIES)
    _, near, dist = knn.nearest(x[:n], ids[:n], x, ids, k, metric, True)
    per = len(near) // n if n else 0
    width = float(np.median(dist[per - 1 :: per])) if per and dist.max() > 0 else 1.0
    lsh, got = Lsh(x.shape[1], width, tables, hashes, probes, metric, seed), 1.0
    for w in WIDTHS if per else ():
        lsh = Lsh(x.shape[1], w * (width or 1.0), tables, hashes, probes, metric, seed)
        got = _recall_of(lsh, x[:n], x, near.reshape(n, per))
        if got >= recall:
            break
    return lsh, got


def _keyed(lsh: Lsh, probes: int):
    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"_id": f["_id"], "_v": f["_v"], "_keys": list(lsh.keys(knn.stacked(f), probes))})

    return fn


def _bucket_cell(k: int, metric: str, exclude_self: bool):
    """The k best per query of a cell, bucket by bucket."""
    def fn(qp: pd.DataFrame, pp: pd.DataFrame) -> pd.DataFrame:
        Q, X, qids, pids = knn.stacked(qp), knn.stacked(pp), qp["_id"].to_numpy(), pp["_id"].to_numpy()
        groups, parts = pp.groupby(["_key", "_part", "_ask"], sort=False).indices, []
        for key, rows in qp.groupby(["_key", "_part", "_ask"], sort=False).indices.items():
            mine = groups.get(key)
            if mine is not None:
                parts.append(knn.nearest(Q[rows], qids[rows], X[mine], pids[mine], k, metric, exclude_self))
        if not parts:
            return knn.found(qids[:0], pids[:0], np.empty(0))
        q, p, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        # a pair may meet in several buckets of the cell
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1])
        return knn.found(*knn._first_k(q[new], p[new], d[new], k))

    return fn


def dealt(held: DataFrame, asked: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part`` and ``_ask``: of each bucket the parts of its points and of its queries, of about ``rows`` each.

    Every part of the points meets every part of the queries. Only buckets with more than ``rows`` of either are dealt,
    and there are at most as many of them as all rows by ``rows``.
    """
    one, none = F.lit(1), F.lit(0)
    sizes = (held.select("_key", one.alias("p"), none.alias("q")).unionByName(asked.select("_key", none.alias("p"), one.alias("q")))
             .groupBy("_key").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter((F.col("p") > rows) | (F.col("q") > rows)))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / rows), one).cast("int")
    hot = F.broadcast(sizes.select("_key", parts("p").alias("_ps"), parts("q").alias("_qs")))
    ps, qs = F.coalesce("_ps", one), F.coalesce("_qs", one)
    own = lambda n: F.pmod(F.xxhash64("_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(none, n - 1))
    return (held.join(hot, "_key", "left").withColumn("_part", own(ps)).withColumn("_ask", every(qs)),
            asked.join(hot, "_key", "left").withColumn("_ask", own(qs)).withColumn("_part", every(ps)))


def knn_lsh_join(queries: DataFrame, points: DataFrame, lsh: Lsh, k: int = 5, query_id: str = "id", point_id: str = "id",
                 features: str = "features", exclude_self: bool = False, point_features: str | None = None, block_rows: int = 50_000) -> DataFrame:
    """For every query row, k near points, most of them the nearest: (query_id, rank, neighbor_id, distance).

    Distances are exact, ties go to the smaller id. Ids must be unique integers. Every query gets min(k, points)
    rows: those with fewer candidates are answered by the exact join.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).cast("bigint").alias("_id"), knn._as_array(features, queries).alias("_v"))
    pf = point_features or features
    p = points.select(F.col(point_id).cast("bigint").alias("_id"), knn._as_array(pf, points).alias("_v"))
    schema = "_id bigint, _v array<double>, _keys array<bigint>"
    spread = lambda df, probes: (df.mapInPandas(_keyed(lsh, probes), schema)
                                 .select("_id", "_v", F.explode(F.array_distinct("_keys")).alias("_key")))
    held, asked = spread(p, 0), spread(q, lsh.probes)
    n_q, n_p = queries.count(), points.count()
    slots = spark.sparkContext.defaultParallelism
    # rows of either side that a bucket's cell holds at most; a cell of small buckets holds about as many of both together
    rows = max(1, block_rows // CELL_SHARE)
    all_rows = lsh.tables * (n_p + (1 + min(lsh.probes, len(lsh.moves()))) * n_q)
    cells = min(max(knn.CELLS_PER_SLOT * slots, math.ceil(all_rows / rows)), knn.MAX_TASKS)
    held, asked = dealt(held, asked, rows)
    cell = F.pmod(F.xxhash64("_key", "_part", "_ask"), F.lit(cells)).cast("int").alias("_cell")
    held, asked = (df.select("_id", "_v", "_key", "_part", "_ask", cell).repartition(cells, "_cell") for df in (held, asked))
    found = (asked.groupBy("_cell").cogroup(held.groupBy("_cell"))
             .applyInPandas(_bucket_cell(k, lsh.metric, exclude_self), "query_id bigint, neighbor_id bigint, distance double"))
    best = found.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id")
    ranked = (best.withColumn("rank", F.row_number().over(w.orderBy("distance", "neighbor_id"))).filter(F.col("rank") <= k)
              .withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") == k).drop("n"))
    checkpoint_dir(spark)
    ranked = ranked.select("query_id", "rank", "neighbor_id", "distance").checkpoint()
    short = queries.join(ranked.filter("rank = 1").select(F.col("query_id").alias(query_id)), query_id, "left_anti")
    exact = knn.knn_join(short, points, k, query_id, point_id, features, lsh.metric, exclude_self, point_features, block_rows)
    return ranked.unionByName(exact)


def knn_recall(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact join's rows that the approximate one has: the same point, or one just as near."""
    far = exact.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    hits = F.count_if(F.col("distance") <= F.col("far") * (1 + 1e-12))
    per = approximate.join(far, "query_id", "right").groupBy("query_id").agg(hits.alias("hits"), F.first("n").alias("n"))
    row = per.agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
