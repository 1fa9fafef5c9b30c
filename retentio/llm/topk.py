"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are packed into blocks; each block holds ``LISTS`` local score lists per query, one for
each slice of the dimensions: a candidate's entry in a list is its partial inner product, and
its score is the sum over the lists.

1. Every block gives, per query and list, its highest entries with the candidates' whole
   scores, and its lowest entry. The k-th highest whole score found is a safe cutoff: no
   candidate below it can be among the k best.
2. The cutoff is sent to all blocks. A candidate that reaches it must lie, in at least one list,
   at least the uniform share (cutoff - sum of lowest entries) / lists above the list's
   lowest entry; each block collects the candidates with such an entry, and drops
   those whose entries cannot add up to the cutoff even if all others were at the share.
3. The scores of the remaining candidates are resolved exactly; the block's k best of those go
   on, and the k best over all blocks are the result.

Queries are dealt into blocks too, and a task handles one pair of blocks, so neither side is
collected. Per query and block at most k rows leave a task, whatever ties there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import materialise

LISTS = 4
#: Vectors and queries of a block: a task compares a pair of blocks.
ROWS, QUERIES = 4096, 1024
#: Blocks whose best are merged at a time.
MERGED = 256
EXACT = float(1 << 53)
#: Components beyond count as this; scores beyond a long as the nearest long.
LIMIT = float(1 << 50)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, by: float = 256.0) -> Column:
    """floor(by * x) of each component, within +-``LIMIT``; null where the vector or a component is null or not finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    within = lambda x: F.greatest(F.least(x * by, F.lit(LIMIT)), F.lit(-LIMIT))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(within(x)).cast("double")))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles: exact while sums stay below 2^53, else by Python's integers."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return q @ v.T
    whole = [np.array([[int(x) for x in r] for r in m], object) for m in (q, v)]
    return whole[0] @ whole[1].T


def slices(dim: int, lists: int = LISTS) -> list[slice]:
    at = [dim * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def copies(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of sorted rows, the number of each among those equal to it."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(axis=1)
    return np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(ids) else np.zeros(0, np.int64)


class Cell:
    """A block of queries and a block of candidates, both sorted by id and components; a query's own row is no candidate of it."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray):
        self.q_ids, self.q, self.v_ids, self.v = q_ids, q, v_ids, v
        self.lists = [products(q[:, s], v[:, s]) for s in slices(q.shape[1])]
        self.other = np.ones((len(q_ids), len(v_ids)), bool)
        r, c = np.nonzero(q_ids[:, None] == v_ids[None, :])
        # of rows equal in all that is read, the first is the first query's own, and so on
        own = (copies(q_ids, q)[r] == copies(v_ids, v)[c]) & (q[r] == v[c]).all(axis=1)
        self.other[r[own], c[own]] = False

    def whole(self, row: int, at: np.ndarray) -> np.ndarray:
        return sum(x[row, at] for x in self.lists)

    def gather(self, k: int) -> Iterator[tuple[int, list, list]]:
        """Phase 1: per query row, the best whole scores among the list heads, and each list's lowest entry."""
        for r in range(len(self.q_ids)):
            mine = np.flatnonzero(self.other[r])
            if not len(mine):
                continue
            entries = [x[r, mine] for x in self.lists]
            n = min(k, len(mine)) - 1
            heads = np.unique(np.concatenate([mine[np.argpartition(-e, n)[: n + 1]] for e in entries]))
            scores = sorted((int(x) for x in self.whole(r, heads)), reverse=True)[:k]
            # a cutoff may be too low, never too high; any number will do for a list's lowest entry
            yield r, [min(x, MOST) for x in scores if x >= LEAST], [min(max(int(e.min()), LEAST), MOST) for e in entries]

    def resolve(self, k: int, cutoff: dict[int, tuple[int | None, list[int]]]) -> Iterator[tuple[int, int, int]]:
        """Phases 2 and 3: query row, candidate and score of the block's best k that reach the cutoff."""
        for r in range(len(self.q_ids)):
            if r not in cutoff:
                continue
            least, low = cutoff[r]
            mine = np.flatnonzero(self.other[r])
            if least is not None:
                share = (least - sum(low)) / len(low)
                above = np.stack([x[r, mine] - b for x, b in zip(self.lists, low, strict=True)])
                enough = above >= share - 1e-9 * abs(share)
                sums = np.where(enough, above, share).sum(axis=0) + sum(low)
                mine = mine[enough.any(axis=0) & (sums >= least - 1e-6 * (1 + abs(least)))]
            scores = self.whole(r, mine)
            best = np.lexsort((self.v_ids[mine], -scores))[:k] if scores.dtype != object else sorted(range(len(mine)), key=lambda i: (-scores[i], self.v_ids[mine[i]]))[:k]
            for i in best:
                if least is None or scores[i] >= least:
                    yield r, int(self.v_ids[mine[i]]), int(scores[i])


def _pack(t: pa.Table) -> pa.Table:
    """The vectors of one block as one row: ids and components, sorted by both."""
    rows = sorted(zip(t.column("id").to_pylist(), t.column("v").to_pylist(), strict=True))
    ids = np.array([i for i, _ in rows], np.int64)
    data = np.array([v for _, v in rows], np.float64)
    return pa.table({"dim": t.column("dim")[:1], "block": t.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Cell]]:
    for b in batches:
        for row in b.to_pylist():
            q_ids, v_ids = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "v_ids"))
            q, v = (np.frombuffer(row[c], np.float64).reshape(n, row["dim"]) for c, n in (("q_data", len(q_ids)), ("v_data", len(v_ids))))
            yield row, Cell(q_ids, q, v_ids, v)


ROW = {"dim": pa.int32(), "q_block": pa.int32(), "q_row": pa.int32(), "merge": pa.int32()}


def _gather(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, cell in _cells(batches):
        rows = [(row["dim"], row["q_block"], r, row["v_block"] // MERGED, *x) for r, *x in cell.gather(k)]
        yield _columns(rows, ROW | {"scores": pa.list_(pa.int64()), "low": pa.list_(pa.int64())})


def _resolve(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, cell in _cells(batches):
        cutoff = {c["q_row"]: (c["cutoff"], c["low"]) for c in row["cutoffs"] or []}
        rows = [(row["dim"], row["q_block"], r, row["v_block"] // MERGED, int(cell.q_ids[r]), i, *_ordered(x)) for r, i, x in cell.resolve(k, cutoff)]
        yield _columns(rows, ROW | {"query_id": pa.int64(), "vec_id": pa.int64(), "high": pa.int64(), "rest": pa.int64()})


def _ordered(score: int) -> tuple[int, int]:
    """A score of any size as two longs that order as it does."""
    return score >> 62, score & ((1 << 62) - 1)


def _columns(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns, strict=True)})


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Packed blocks of at most about ``size`` of the ``n`` vectors each; vectors of one length share a block."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / size)))).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, ids binary, data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row.

    Components are floor(256 x). Candidates are all rows of the query's length but the query's own; rows that share an
    id are rows of their own, as queries and as candidates. Ties go to the smaller vec_id; fewer candidates
    give fewer rows, an empty table none. Vectors that are null or hold null or non-finite components, and null ids,
    take no part. Other columns are not read. Components beyond +-2^50 count as 2^50; scores are compared exactly
    and given as the nearest long.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("asks")).filter("id is not null and v is not null")
    packed = own.select("id", "v", F.size("v").alias("dim"), "asks")
    n, n_queries = packed.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    v = materialise(_blocks(packed.drop("asks"), rows, n), "vectors")
    q = materialise(_blocks(packed.filter("asks").drop("asks"), queries, n_queries), "queries")
    asked = q.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    held = v.select("dim", F.col("block").alias("v_block"), F.col("ids").alias("v_ids"), F.col("data").alias("v_data"))
    n_cells = max(1, math.ceil(n / rows)) * max(1, math.ceil(n_queries / queries))
    # blocks meet blocks, never rows: each query block with each block of vectors of its length
    pairs = held.select("dim", "v_block").join(asked.select("dim", "q_block"), "dim").repartition(max(1, min(n_cells, 100_000)), "dim", "q_block", "v_block")
    cells = pairs.join(asked, ["dim", "q_block"]).join(held, ["dim", "v_block"])
    row, row_ddl = ["dim", "q_block", "q_row"], "dim int, q_block int, q_row int, merge int"
    lists = cells.mapInArrow(partial(_gather, k), f"{row_ddl}, scores array<long>, low array<long>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), False), 1, k)  # k scores of each block
    low = F.array(*(F.min(F.col("low")[i]) for i in range(LISTS)))
    found = lists
    for by in ([*row, "merge"], row):  # of so many blocks at a time, so that no list grows with the table
        found = found.groupBy(*by).agg(best.alias("scores"), low.alias("low"))
    cutoff = F.when(F.size("scores") >= k, F.element_at("scores", -1))
    sent = materialise(found.groupBy("dim", "q_block").agg(F.collect_list(F.struct("q_row", cutoff.alias("cutoff"), "low")).alias("cutoffs")), "cutoffs")
    resolved = cells.join(sent, ["dim", "q_block"]).mapInArrow(partial(_resolve, k), f"{row_ddl}, query_id long, vec_id long, high long, rest long")
    order = F.struct((-F.col("high")).alias("h"), (-F.col("rest")).alias("r"), F.col("vec_id").alias("i"))
    first = resolved.select(*row, "merge", "query_id", F.array(order).alias("top"))
    for by in ([*row, "query_id", "merge"], [*row, "query_id"]):
        first = first.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))  # k rows of each block
    high, rest = -F.col("x.h"), -F.col("x.r")
    score = F.when(high >= 2, F.lit(MOST)).when(high < -2, F.lit(LEAST)).otherwise(high * F.lit(1 << 62) + rest)
    return first.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), score.alias("score"))
