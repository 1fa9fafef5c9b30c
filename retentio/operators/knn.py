"""Exact k-nearest-neighbour join.

Exact kNN compares every query with every point: O(n_q * n_p) distance work by
definition. The work is spread evenly: queries are hashed into ``q_blocks`` and points
into ``p_blocks``; every (query block, point block) cell is one task
(``cogroup`` + ``applyInPandas``) that computes distances in vectorised NumPy chunks and
emits only its k best points per query — pairs are never materialised as rows. A final
shuffle on the query id keeps the k best of the ``p_blocks * k`` candidates per query.
A block holds at most ``block_rows`` rows, and queries are cut further until there are a few
cells per cluster slot, so a small search uses all slots; a hot key cannot form because
blocks are assigned by hashing unique ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# numbers in one chunk's distance matrix (~32 MB of doubles), whatever the block size
CELL_VALUES = 1 << 22
# groups of points whose minima bound the k-th distance, for each of the k
GROUPS = 64
# cells per cluster slot, and queries in a cell, at least
CELLS_PER_SLOT, MIN_QUERIES = 2, 64
# tasks of one search; beyond that a task handles several cells, one after another
MAX_TASKS = 50_000


def _as_array(col: str, df: DataFrame):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.ml.functions import vector_to_array

    dt = df.schema[col].dataType
    if isinstance(dt, VectorUDT):
        return vector_to_array(F.col(col), "float64")
    return F.col(col).cast("array<double>")


def _first_k(rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its k smallest by (distance, id)."""
    order = np.lexsort((ids, dist, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], ids[keep], dist[keep]


def _kth_at_most(d: np.ndarray, kk: int) -> np.ndarray:
    """Of each row a number that at least ``kk`` of its numbers do not exceed, mostly little above the kk-th smallest.

    It is the kk-th smallest of the minima of groups of columns: a minimum costs far less than a selection. No number may be NaN.
    """
    groups = GROUPS * kk
    size = d.shape[1] // groups
    if size < 2:
        return np.partition(d, kk - 1, axis=1)[:, kk - 1:kk]
    # group i has the columns i, i + groups, ...; the columns left over are in no group, which only raises the bound
    least = d[:, :size * groups].reshape(len(d), size, groups).min(axis=1)
    return np.partition(least, kk - 1, axis=1)[:, kk - 1:kk]


def nearest(Q: np.ndarray, qids: np.ndarray, X: np.ndarray, pids: np.ndarray, k: int, metric: str,
            exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, point id, distance) of the k nearest of the points ``X`` to each of ``Q``, by (distance, id)."""
    if not len(Q) or not len(X):
        return qids[:0], pids[:0], np.empty(0)
    # distances do not change with the origin: near the data's centre the expansion loses least
    centre = X.mean(axis=0)
    Qc, Xc = Q - centre, X - centre
    xx = (Xc * Xc).sum(axis=1)
    # |q|^2 + |x|^2 - 2 q x as one product
    Xp = np.column_stack((Xc, np.ones(len(Xc)), xx)).T if metric == "euclidean" else Xc
    out_q, out_p, out_d = [], [], []
    kk = min(k + (1 if exclude_self else 0), len(pids))
    # queries per chunk so that one chunk's distance matrix holds ~CELL_VALUES numbers
    per = len(pids) if metric == "euclidean" else X.size
    step = max(1, CELL_VALUES // max(1, per))
    for s in range(0, len(qids), step):
        q, qc = Q[s:s + step], Qc[s:s + step]
        if metric == "euclidean":
            qq = (qc * qc).sum(axis=1)
            d = np.column_stack((-2.0 * qc, qq, np.ones(len(qc)))) @ Xp  # squared
            # bound of what rounding the expansion can lose
            slack = 8.0 * np.finfo(np.float64).eps * (X.shape[1] + 4) * (qq + xx.max())[:, None]
        else:  # manhattan
            d = np.abs(q[:, None, :] - X[None, :, :]).sum(axis=2)
            slack = 1e-12 * (1.0 + np.abs(d).max(axis=1, keepdims=True))
        if exclude_self:
            d = np.where(qids[s:s + step, None] == pids[None, :], np.inf, d)
        plain = np.isfinite(4.0 * (np.abs(q).max() ** 2 + np.abs(X).max() ** 2) * X.shape[1])  # then no distance is NaN
        # every point that may be within the k-th distance is a candidate; exact distances are
        # taken of a bounded number of candidates at a time, and of each query the k best by
        # (distance, neighbour id) stay, the order of the final ranking
        kth = _kth_at_most(d, kk) if plain else np.partition(d, kk - 1, axis=1)[:, kk - 1:kk]
        rows, cols = np.nonzero(d <= kth + 2.0 * slack)
        finite = np.isfinite(d[rows, cols])
        rows, cols = rows[finite], cols[finite]
        del d
        n = np.bincount(rows, minlength=len(q))
        ends = np.cumsum(n)
        most = max(1, CELL_VALUES // (4 * X.shape[1]))
        lo = 0
        while lo < len(q):
            first = ends[lo] - n[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, first + most, side="right")))
            best = []
            for c in range(first, ends[hi - 1], most):  # more than one turn only for a single query
                r, p = rows[c:min(c + most, ends[hi - 1])], cols[c:min(c + most, ends[hi - 1])]
                diff = q[r] - X[p]
                dist = np.sqrt((diff * diff).sum(axis=1)) if metric == "euclidean" else np.abs(diff).sum(axis=1)
                best.append(_first_k(r, pids[p], dist, k))
            r, p, dist = _first_k(*(np.concatenate(x) for x in zip(*best)), k) if best else (rows[:0], pids[:0], np.empty(0))
            out_q.append(qids[s:s + step][r])
            out_p.append(p)
            out_d.append(dist)
            lo = hi
    return np.concatenate(out_q), np.concatenate(out_p), np.concatenate(out_d)


def stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["_v"].to_numpy()).astype(np.float64) if len(frame) else np.empty((0, 0))


def found(q: np.ndarray, p: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": q.astype("int64"), "neighbor_id": p.astype("int64"), "distance": d.astype("float64")})


def _topk_cell(k: int, metric: str, exclude_self: bool):
    def fn(qp: pd.DataFrame, pp: pd.DataFrame) -> pd.DataFrame:
        return found(*nearest(stacked(qp), qp["_id"].to_numpy(), stacked(pp), pp["_id"].to_numpy(), k, metric, exclude_self))

    return fn


def knn_join(queries: DataFrame, points: DataFrame, k: int = 5, query_id: str = "id", point_id: str = "id",
             features: str = "features", metric: str = "euclidean", exclude_self: bool = False,
             point_features: str | None = None,
             block_rows: int = 50_000, q_blocks: int | None = None, p_blocks: int | None = None) -> DataFrame:
    """For every query row, its k nearest points: (query_id, rank, neighbor_id, distance).

    Ids must be unique integers. Distance ties are broken by the smaller neighbour id.
    ``exclude_self`` drops a point whose id equals the query id (self-join use).
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError("metric must be 'euclidean' or 'manhattan'")
    if q_blocks is None or p_blocks is None:
        n_q, n_p = queries.count(), points.count()
        slots = queries.sparkSession.sparkContext.defaultParallelism
        p_blocks = p_blocks or max(1, math.ceil(n_p / block_rows))
        # a few cells per slot, of at least MIN_QUERIES queries each
        spread = min(math.ceil(CELLS_PER_SLOT * slots / p_blocks), math.ceil(n_q / MIN_QUERIES))
        q_blocks = q_blocks or max(1, math.ceil(n_q / block_rows), spread)
    q = queries.select(F.col(query_id).cast("bigint").alias("_id"), _as_array(features, queries).alias("_v"))
    pf = point_features or features
    p = points.select(F.col(point_id).cast("bigint").alias("_id"), _as_array(pf, points).alias("_v"))
    # block numbers have one type on both sides: an int and a long of equal value hash apart
    q = (q.withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(q_blocks)).cast("int"))
         .withColumn("_pb", F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1)))))
    p = (p.withColumn("_pb", F.pmod(F.xxhash64("_id"), F.lit(p_blocks)).cast("int"))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    schema = "query_id bigint, neighbor_id bigint, distance double"
    # a given number of partitions: adaptive execution would join small cells into one task
    cells = min(q_blocks * p_blocks, MAX_TASKS)
    q, p = q.repartition(cells, "_qb", "_pb"), p.repartition(cells, "_qb", "_pb")
    cand = (q.groupBy("_qb", "_pb").cogroup(p.groupBy("_qb", "_pb"))
            .applyInPandas(_topk_cell(k, metric, exclude_self), schema))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", "distance"))
