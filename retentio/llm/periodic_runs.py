"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with a smallest period p that repeats often enough and that no
neighbouring word extends. If it starts at s and is n words long, the suffixes at s and s + p agree in
exactly n - p words. So runs are found where suffixes are united:

1. Suffixes of a document that share their first words are sorted by prefix doubling, which
   also gives the longest common prefix (LCP) of neighbours in that order.
2. Kruskal over those neighbours by decreasing LCP: each class of suffixes keeps its positions as an ordered
   set, and uniting two classes puts the smaller set into the larger.
3. Positions that become neighbours in the united set at level LCP = l, at a distance p that l reaches
   (p * (exponent - 1) <= l), seed a run: its period is p, its end is the second position + l. The seed at the run's own
   start is the one whose preceding words differ; others are inside a run that has it.

The period of a seed is its smallest: a smaller one would put a position between the two at a
higher level. No run is seeded below the least LCP that the shortest run needs (5 words for runs of 6
words and exponent 4), so suffixes that share fewer words with no other of their document are left
out before the sort; that changes no result.

Documents are independent, so there is no shuffle; a task holds one piece of bounded text at a time. A
very long text is a piece of its own size, at a few dozen bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import documents_of, text_bytes

#: Shortest run, and least number of periods in it.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Text bytes that are handled at a time.
PIECE_BYTES = 8 << 20


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The smallest LCP at which a run can be seeded, over all periods."""
    return max(1, min(max(min_length - p, (min_exponent - 1) * p) for p in range(1, max(2, min_length + 1))))


def layout(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all documents with a slot of -1 before each document and at the end; starts; document of each slot."""
    start = np.cumsum(counts + 1) - counts
    ids = np.full(int(counts.sum()) + len(counts) + 1, -1, np.int64)
    doc = np.repeat(np.arange(len(counts) + 1), np.append(counts + 1, 1))
    ids[np.arange(int(counts.sum())) + np.repeat(np.arange(1, len(counts) + 1), counts)] = words
    return ids, start, doc


def repeated_grams(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Positions, ascending, whose next ``width`` words may occur again in their document (by a hash: none is missed)."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    whole = np.cumsum(np.append(0, ids < 0))
    at = np.flatnonzero(whole[width : width + n] == whole[:n])  # no slot inside
    h = doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    order = np.argsort(h)
    same = np.flatnonzero(np.diff(h[order]) == 0)
    again = np.zeros(len(at), bool)
    again[order[same]] = again[order[same + 1]] = True
    return at[again]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the keys (the first decides first), and where in it a group of equal rows starts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys]) if len(order) > 1 else True
    return order, new


def neighbours(ids: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours i, j in the order of the suffixes of each document and their LCP, where it is ``width`` at least."""
    none = np.zeros(0, np.int64)
    repeated = repeated_grams(ids, doc, width)
    if not len(repeated):
        return none, none, none
    # a suffix that shares its first words with another is compared at most where a repeated gram has just ended
    at = np.union1d(repeated, repeated + width)
    padded = np.append(ids, np.full(width, -1))
    grams = [padded[at + k] for k in range(width)]
    for k in range(1, width):  # behind the document's end nothing is compared
        grams[k] = np.where(grams[k - 1] < 0, -1, grams[k])
    order, new = _groups(doc[at], *grams)
    sa = at[order]
    rank = np.full(len(ids) + width, -1, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels: list[tuple[int, np.ndarray, np.ndarray]] = []
    w = width
    # places in sa of suffixes that are equal in w words to another (two that are cut off by the end are never equal)
    inside = padded[sa] >= 0
    live = np.flatnonzero(inside & (~new | ~np.append(new[1:], True)))
    while len(live):
        levels.append((w, sa[live], rank[sa[live]]))
        after = rank[sa[live] + w]
        order, new = _groups(rank[sa[live]], after)
        # within its group each suffix moves to its place; groups stay where they are
        sa[live] = sa[live][order]
        first = np.flatnonzero(new)
        rank[sa[live]] = live[first][np.cumsum(new) - 1]
        live = live[~new | ~np.append(new[1:], True)]
        w *= 2
    width0, members, class0 = levels[0]
    held = np.full(len(ids) + width, -1, np.int64)
    held[members] = class0
    i, j = sa[:-1], sa[1:]
    near = (held[i] >= 0) & (held[i] == held[j])
    held[members] = -1
    i, j = i[near], j[near]
    lcp = np.zeros(len(i), np.int64)
    for w, members, classes in reversed(levels):
        held[members] = classes
        a, b = held[i + lcp], held[j + lcp]
        lcp += np.where((a >= 0) & (a == b), w, 0)
        held[members] = -1
    more = np.ones(len(i), bool)
    for _ in range(width - 1):
        a = padded[i + lcp]
        more &= (a >= 0) & (a == padded[j + lcp])
        lcp += more
    return i, j, lcp


def seeds(i: np.ndarray, j: np.ndarray, lcp: np.ndarray, ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run: Kruskal over the neighbours by decreasing LCP."""
    positions, places = np.unique(np.concatenate((i, j)), return_inverse=True)
    places = places.reshape(2, -1)
    order = np.argsort(-lcp, kind="stable")
    sets: list[list[int]] = [[p] for p in positions.tolist()]
    place_of = dict(zip(positions.tolist(), range(len(positions)), strict=True))
    word = ids.tolist() if len(positions) * 8 > len(ids) else ids
    times = min_exponent - 1
    out: list[tuple[int, int, int]] = []

    def adjacent(a: int, b: int, level: int) -> None:
        p = b - a
        if p * times <= level and p + level >= min_length and word[a - 1] != word[b - 1]:
            out.append((a, p + level, p))

    for x, y, level in zip(places[0, order].tolist(), places[1, order].tolist(), lcp[order].tolist(), strict=True):
        large, small = sets[x], sets[y]
        if len(large) < len(small):
            large, small = small, large
        if len(small) == 1:
            v = small[0]
            k = bisect_left(large, v)
            if k:
                adjacent(large[k - 1], v, level)
            if k < len(large):
                adjacent(v, large[k], level)
            large.insert(k, v)
            sets[place_of[v]] = large
            continue
        ks = [bisect_left(large, v) for v in small]
        last = len(small) - 1
        for n, (v, k) in enumerate(zip(small, ks, strict=True)):
            # neighbours in the united set, one of each class
            if k and (n == 0 or ks[n - 1] != k):
                adjacent(large[k - 1], v, level)
            if k < len(large) and (n == last or ks[n + 1] != k):
                adjacent(v, large[k], level)
            sets[place_of[v]] = large
        large += small
        large.sort()  # two ascending stretches: one merge
    return out


def runs_of(counts: np.ndarray, words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start, then period; words are numbers from 0."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    ids, start, doc = layout(counts, words)
    i, j, lcp = neighbours(ids, doc, least_lcp(min_length, min_exponent))
    if len(i):
        for s, n, p in sorted((s, n, p) for s, n, p in seeds(i, j, lcp, ids, min_length, min_exponent)):
            d = int(doc[s])
            found[d].append((s - int(start[d]), n, p))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by spaces: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(min_length: int, min_exponent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        size = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PIECE_BYTES)) + 1).tolist(), whole.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            piece = whole.slice(a, b - a)
            texts = [t.split() for t in text_bytes(piece.column("text"))]
            counts = np.array([len(t) for t in texts], np.int64)
            words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = runs_of(counts, words, min_length, min_exponent)
            flat = [r for f in runs for r in f]
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            kept = pa.array([collapsed(t, f) for t, f in zip(texts, runs, strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "n_words": pa.array(counts), "collapsed": kept.cast(pa.string(), safe=False),
                "runs": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(RUN)))}).select(["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed (the text without repeats).

    Words are stretches without ASCII white space. A run has at least ``min_length`` words and ``min_exponent`` (2 or
    more) periods. ``collapsed`` joins by one space the words that are in no run, or in the first period of each run
    that has them. One row per row: null ids and repeated rows stay, null and empty texts have no word, no run and an
    empty ``collapsed``; an empty table gives no row. Other columns are not read.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has two periods at least")
    rows = documents_of(docs, id_col, text_col).withColumn("text", F.make_valid_utf8("text"))
    return rows.mapInArrow(partial(_find, min_length, min_exponent), FOUND)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document (by crc32 of its id) has its words from some place on replaced by a repetition.

    With h = crc32(decimal doc_id), g = floor(h / 10) and n words: where h % 10 = 0, word i >= a becomes word a + (i - a) % p
    for a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    rows = documents_of(docs)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[at(i)]), " "))

    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(words), tail)[0]  # the lambda holds the words: they are split once
    return rows.select("doc_id", F.when(h % 10 == 0, F.coalesce(changed, "text")).otherwise(F.col("text")).alias("text"))
