"""SimHash near-duplicates, found exactly by the generalised pigeonhole principle.

A document's fingerprint has bit i set where more than half of its shingles' XXH64 values
have it. Fingerprints that differ in at most ``radius`` bits are linked, and the classes are
the connected components of these links.

The 64 bits are grouped into ``m`` parts, correlated bits together (measured over all distinct
fingerprints). If thresholds t_1..t_m (each at least -1) satisfy sum(t_i + 1) = radius + 1, two
fingerprints within the radius agree up to t_i bits on at least one part i. Each fingerprint
chooses its own thresholds by dynamic programming over the number of candidates it would
meet, estimated from the counts of part values; it then probes, in each part, the values
within t_i bits of its own (-1: none). Every fingerprint is indexed in every part, so no link
is lost whatever is chosen. Candidates are verified by their whole fingerprints inside the
task that holds the bucket, and only a spanning forest of the links found leaves it.

Scale: exact copies collapse to one fingerprint first. A bucket larger than ``BUCKET`` is dealt
into cells of two blocks each, so that no task collects a bucket. ``m`` falls (wider
parts, more probes, smaller buckets) as the number of fingerprints grows, by estimated cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import documents_of, materialise, text_bytes
from retentio.llm.components import connected_components

BITS = 64
#: Bits of a part that the table of counts distinguishes: at most 4 * 2^16 counters in all.
HEAD = 16
#: Rows of a bucket that one task compares with each other.
BUCKET = 2048
#: Cost of shuffling one probe, in comparisons.
PROBE_COST = 20.0


# ---- fingerprints -------------------------------------------------------------------------
def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = text.lower().split()  # on bytes both know ASCII only
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, h = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        hashes = [h(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    a, ones = np.array(hashes, "<u8"), np.zeros(BITS, np.int64)
    for i in range(0, len(a), 1 << 16):
        part = a[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<u8")[0])


def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x, width) for x in text_bytes(b.column("text"))], np.uint64)
        kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(fp.view(np.int64), pa.int64())], [*names, "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with ``fp`` (64 bits as a long) in place of ``text``; a null text has no words."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(partial(_fingerprints, width), f"{kept}, fp long")


# ---- parts --------------------------------------------------------------------------------
def _both_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        total += bits.T @ bits
        n += len(fp)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, -1), pa.int32()), "j": pa.array(np.append(j, -1), pa.int32()),
                                      "n": pa.array(np.append(total[i, j], n).astype(np.int64), pa.int64())})


def correlated_parts(distinct: DataFrame, m: int) -> tuple[list[list[int]], int]:
    """``m`` parts of the bits, correlated bits together, and the number of rows of ``distinct``."""
    rows = distinct.mapInArrow(_both_set, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in rows if r.i < 0)  # 2081 rows at most
    both = np.zeros((BITS, BITS))
    for r in rows:
        if r.i >= 0:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    return group_bits(corr, m), n


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """Greedy: start a part with the bit most correlated with the rest, add the bit nearest to the part."""
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [max(left, key=lambda i: (corr[i, left].sum(), -i))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda i: (corr[i, part].sum(), -i)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def best_m(n: int, radius: int) -> int:
    """The number of parts with the least probes and comparisons for ``n`` evenly spread fingerprints."""
    def cost(m: int) -> float:
        e, total = radius + 1, 0.0
        for k in range(m):
            t, bits = e // m + (k < e % m) - 1, BITS // m + (k < BITS % m)
            total += sum(math.comb(bits, j) for j in range(t + 1)) * (PROBE_COST + n / 2.0**bits)
        return total
    return min(range(2, radius + 2), key=cost) if radius else 1


# ---- estimates and thresholds ---------------------------------------------------------------
def _heads(parts: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(parts), 1 << HEAD), np.int64)
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for i, bits in enumerate(parts):
            counts[i] += np.bincount(part_values(fp, bits[:HEAD]).astype(np.int64), minlength=1 << HEAD)
    i, v = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"part": pa.array(i, pa.int32()), "head": pa.array(v, pa.int32()), "n": pa.array(counts[i, v], pa.int64())})


def shells(counts: np.ndarray, radius: int) -> np.ndarray:
    """For each 16-bit value, how many rows have a value at exactly 0..radius bits from it."""
    values = np.arange(counts.size)
    out = [counts.astype(np.float64)]
    for r in range(1, radius + 1):
        if r <= 2:
            s = np.zeros_like(out[0])
            for flip in combinations(range(HEAD), r):
                s += out[0][values ^ sum(1 << f for f in flip)]
        else:  # sum over one more flip counts each path r times, and steps back to r-2
            s = sum(out[r - 1][values ^ (1 << f)] for f in range(HEAD))
            s = np.maximum((s - (HEAD - r + 2) * out[r - 2]) / r, 0)
        out.append(s)
    return np.stack(out)


def estimated_cost(head_counts: np.ndarray, parts: list[list[int]], radius: int) -> np.ndarray:
    """cost[part, e, head]: probes and candidates of threshold e-1, from the counts of all rows."""
    cost = np.zeros((len(parts), radius + 2, 1 << HEAD), np.float32)
    for i, bits in enumerate(parts):
        tail, s = len(bits) - HEAD, shells(head_counts[i], radius)
        for e in range(1, radius + 2):
            near = sum(s[a] * sum(math.comb(tail, b) for b in range(e - a)) for a in range(e)) / 2.0**tail
            cost[i, e] = PROBE_COST * sum(math.comb(len(bits), j) for j in range(e)) + near
    return cost


def allocate(cost: np.ndarray, radius: int) -> np.ndarray:
    """cost[row, part, e] -> e per row and part with the least sum of costs and sum(e) = radius + 1."""
    n, m, _ = cost.shape
    best = np.full((n, radius + 2), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, radius + 2), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for total in range(radius + 2):
            for e in range(total + 1):
                c = best[:, total - e] + cost[:, i, e]
                better = c < new[:, total]
                new[better, total], took[i, better, total] = c[better], e
        best = new
    out, left, rows = np.zeros((n, m), np.int8), np.full(n, radius + 1), np.arange(n)
    for i in reversed(range(m)):
        out[:, i] = took[i, rows, left]
        left = left - out[:, i]
    return out


# ---- probing --------------------------------------------------------------------------------
def _spread(fp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A block in [0, n) for each fingerprint."""
    h = (fp ^ (fp >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)


def _signatures(parts: list[list[int]], radius: int, tables, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows and probes: part, value, cell of the bucket, fingerprint, whether it probes there."""
    heads, cost = tables.value
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        values = [part_values(fp, bits) for bits in parts]
        low = [(v & np.uint64((1 << HEAD) - 1)).astype(np.int64) for v in values]
        e = allocate(np.stack([cost[i][:, low[i]].T for i in range(len(parts))], axis=1), radius)
        for i, bits in enumerate(parts):
            rows, flips, probes = [np.arange(len(fp))], [np.zeros(len(fp), np.uint64)], [e[:, i] > 0]  # every row is indexed
            for j in range(1, radius + 1):
                who = np.flatnonzero(e[:, i] > j)
                masks = np.array([sum(1 << f for f in flip) for flip in combinations(range(len(bits)), j)] if len(who) else [], np.uint64)
                rows.append(np.repeat(who, len(masks)))
                flips.append(np.tile(masks, len(who)))
                probes.append(np.ones(len(rows[-1]), bool))
            who, v = np.concatenate(rows), np.concatenate(flips)
            v ^= values[i][who]
            n = np.ceil(heads[i][(v & np.uint64((1 << HEAD) - 1)).astype(np.int64)] / 2.0 ** (len(bits) - HEAD) / BUCKET)
            yield from _cells(i, v, fp[who], np.concatenate(probes), n.astype(np.int64).clip(1))


def _cells(part: int, v: np.ndarray, fp: np.ndarray, probe: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket of n blocks has a cell for each two of them; each row goes to the cells of its block."""
    block = _spread(fp, n)
    at = np.repeat(np.arange(len(fp)), n)
    other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    x, y = np.minimum(block[at], other), np.maximum(block[at], other)
    for s in range(0, len(at), 1 << 16):
        k = at[s : s + (1 << 16)]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(len(k), part), pa.int32()), "value": pa.array(v[k].view(np.int64), pa.int64()),
            "cell": pa.array(x[s : s + len(k)] * n[k] + y[s : s + len(k)], pa.int64()),
            "fp": pa.array(fp[k].view(np.int64), pa.int64()), "probe": pa.array(probe[k])})


def forest(fp: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints that can be reached from the probing ones."""
    left, out = np.ones(len(fp), bool), []
    rest = np.arange(len(fp))
    for s in np.flatnonzero(probe).tolist():
        if not left[s]:
            continue
        left[s], todo = False, [s]
        while todo and len(rest):
            u = todo.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= radius
            hits = rest[near]
            rest = rest[~near]  # u itself goes with the first
            hits = hits[left[hits]]
            left[hits] = False
            out += [(u, h) for h in hits.tolist()]
            todo += hits.tolist()
    return out


def _links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket's cell, from rows sorted by part, value and cell; no cell is held beyond its own rows."""
    held = None
    for b in _with_end(batches):
        if b is not None:
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in ("part", "value", "cell", "fp", "probe")]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if held is None or not len(held[0]):
            continue
        new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
        if b is not None and not len(new):
            continue
        upto = new[-1] if b is not None else len(held[0])
        starts = np.concatenate(([0], new[new < upto]))
        sizes = np.diff(np.append(starts, upto))
        probes = np.add.reduceat(held[4][:upto].astype(np.int64), starts)
        fp, flag, found = held[3].view(np.uint64), held[4], []
        for s, n in zip(starts[(sizes > 1) & (probes > 0)].tolist(), sizes[(sizes > 1) & (probes > 0)].tolist(), strict=True):
            found += [(s + u, s + v) for u, v in forest(fp[s : s + n], flag[s : s + n], radius)]
        if found:
            f = np.array(found)
            yield pa.RecordBatch.from_pydict({"a": pa.array(held[3][f[:, 0]], pa.int64()), "b": pa.array(held[3][f[:, 1]], pa.int64())})
        held = [c[upto:] for c in held]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_links(distinct: DataFrame, radius: int = 3, m: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within ``radius`` bits.

    ``distinct`` has one row per fingerprint. Without rows the result is empty.
    """
    spark = distinct.sparkSession
    if not radius:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    m = m or best_m(distinct.count(), radius)
    parts, _ = correlated_parts(distinct, m)
    rows = (distinct.mapInArrow(partial(_heads, parts), "part int, head int, n long")
            .groupBy("part", "head").agg(F.sum("n").alias("n")).toArrow())  # at most m * 2^16 rows
    heads = np.zeros((m, 1 << HEAD))
    heads[rows.column("part").to_numpy(), rows.column("head").to_numpy()] = rows.column("n").to_numpy()
    tables = spark.sparkContext.broadcast((heads, estimated_cost(heads, parts, radius)))  # 8 MB at most
    signed = distinct.mapInArrow(partial(_signatures, parts, radius, tables), "part int, value long, cell long, fp long, probe boolean")
    return (signed.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell")
            .mapInArrow(partial(_links, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    fingerprint   16 lower-case hex digits; a null or empty text, or one without words, has 0
                  and is linked like any other
    component_id  the smallest doc_id of the documents reachable over links of at most
                  ``radius`` differing bits, itself included
    Null ids are kept as rows and never become a component_id (a class of null ids only has a
    null one); repeated rows each keep their row; other columns are not read.
    """
    fp = materialise(fingerprints(documents_of(docs, id_col, text_col), width), "fingerprints")
    named = _components(fp, radius)
    return fp.join(named, fp.fp == named.f).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(fp: DataFrame, radius: int) -> DataFrame:
    """(f, label, component_id) for each distinct fingerprint of ``fp`` (doc_id, fp)."""
    least = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = near_links(least.select("fp"), radius)
    found = connected_components(links, "a", "b")
    labelled = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "label").select(F.col("fp").alias("f"), "label", "component_id")


def first_of_each_class(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that stay: one per class.

    Of each class the row with the smallest (doc_id, XXH64 of the text), null ids last; of
    rows equal in both, one.
    """
    keyed = documents_of(docs).withColumn("hash", F.xxhash64("text"))
    fp = materialise(fingerprints(keyed, width), "fingerprints")
    named = _components(fp.select("doc_id", "fp"), radius).select("f", "label")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))
    first = (fp.join(named, fp.fp == named.f).groupBy("label").agg(F.min(order).alias("first"))
             .select(F.col("first.doc_id").alias("id"), F.col("first.hash").alias("h")))
    whole = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    kept = whole.join(first, whole["doc_id"].eqNullSafe(first["id"]) & (whole["__hash"] == first["h"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
