"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; the
normalised form is the words between single spaces. Every run of ``window`` words of an item
(all of its words, if it has fewer) is a pattern. One scan of the normalised text finds all
occurrences; they are mapped to word numbers and to offsets in the original text.

The automaton is built from the benchmark, whose bytes are summed first: up to
``AUTOMATON_BYTES`` of patterns make one automaton, which is broadcast; a larger benchmark is
dealt into groups of items, one automaton and one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import documents_of, text_bytes

#: Bytes of normalised patterns in one automaton (it takes some fifty times as much memory).
AUTOMATON_BYTES = 4 << 20
#: Bytes of UTF-8 outside ASCII are all parts of words, so words can be cut on bytes.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns_of(words: list[bytes], window: int) -> list[bytes]:
    """Windows of an item, each between spaces."""
    if len(words) <= window:
        return [b" " + b" ".join(words) + b" "] if words else []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(len(words) - window + 1)]


class Matcher:
    """The automaton over the windows of items, given as (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        holders: dict[bytes, set[int | None]] = {}
        for item, text in items:
            for p in patterns_of(words_of(text), window):
                holders.setdefault(p, set()).add(item)
        self.items = [tuple(sorted(i for i in s if i is not None)) for s in holders.values()]  # an item without an id is found all the same
        self.sizes = [p.count(b" ") - 1 for p in holders]
        self.automaton = ahocorasick.Automaton()
        for n, p in enumerate(holders):
            self.automaton.add_word(p.decode("latin-1"), n)  # one character per byte
        if holders:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words, and (first word, word after the last, pattern) of each occurrence."""
        words = words_of(text)
        if not words or not self.items:
            return len(words), []
        normal = b" " + b" ".join(words) + b" "
        hits = list(self.automaton.iter(normal.decode("latin-1")))
        if not hits:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)  # the k-th space ends word k - 1
        after = np.searchsorted(spaces, [e for e, _ in hits]).tolist()
        return len(words), [(a - self.sizes[p], a, p) for a, (_, p) in zip(after, hits, strict=True)]


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the characters of the original text."""
    data = np.frombuffer(text.translate(NORMAL), np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return chars[edges[::2]], chars[edges[1::2]]


HIT = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = Matcher(*shared.value)
    for b in batches:
        n_words, spans, items = [], [], []
        for text in text_bytes(b.column("text")):
            n, hits = m.scan(text)
            n_words.append(n)
            items.append(sorted({i for *_, p in hits for i in m.items[p]}))
            runs: list[list[int]] = []
            for s, e, _ in sorted(hits):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            if runs:
                begin, end = word_offsets(text)
                spans.append([{"first_word": s, "end_word": e, "start": int(begin[s]), "end": int(end[e - 1])} for s, e in runs])
            else:
                spans.append([])
        kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, HIT)],
                                         [*names, "n_words", "items", "spans"])


def _batches_of_items(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items with words, in groups of at most about ``most`` bytes, by one sum over the benchmark; one group at a time."""
    usable = benchmark.filter("text is not null")
    size = int(usable.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0)
    groups = max(1, -(-size // most))
    dealt = usable.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    for g in range(groups):
        yield [(r.item_id, r.text.encode()) for r in dealt.filter(F.col("g") == g).collect()]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, items (sorted distinct item ids found), spans.

    spans   maximal runs of words inside occurrences: first_word, end_word (word numbers, end
            exclusive), start, end (characters of the original text, end exclusive)
    Null texts have no words, items without words are never found; words of an item with a null id are in spans, and it has no
    id to give; items that share an id count as one; repeated rows keep their rows; an empty table gives no
    row, an empty benchmark no spans; very long texts are scanned whole. Other columns are not read.
    """
    texts = documents_of(docs, id_col, text_col)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    span = "array<struct<first_word:long,end_word:long,start:long,end:long>>"
    # an item of k words has up to k windows of `window` words: about that many times its bytes
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast((g, window)) for g in _batches_of_items(bench, max(1, automaton_bytes // window))]
    if len(shared) == 1:
        return texts.mapInArrow(partial(_scan, shared[0]), f"doc_id long, n_words long, items array<long>, spans {span}")
    found = None
    keyed = texts.withColumn("hash", F.xxhash64("text"))
    for one in shared:
        part = keyed.mapInArrow(partial(_scan, one), f"doc_id long, hash long, n_words long, items array<long>, spans {span}")
        found = part if found is None else found.unionByName(part)
    # every row comes once per group of items; equal rows have equal findings, so their copies are counted
    merged = found.groupBy("doc_id", "hash", "n_words").agg(
        (F.count(F.lit(1)) / len(shared)).cast("int").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return merged.select("doc_id", "n_words", "items", _united("spans").alias("spans"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with an id or without, all columns as they are; null texts stay."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sc, left = docs.sparkSession.sparkContext, docs
    for g in _batches_of_items(bench, max(1, automaton_bytes // window)):
        left = left.mapInArrow(partial(_clean, sc.broadcast((g, window)), text_col), left.schema)
    return left


def _clean(shared, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = Matcher(*shared.value)
    for b in batches:
        yield b.filter(pa.array([not m.scan(t)[1] for t in text_bytes(b.column(text_col))], pa.bool_()))


def _united(col: str):
    """Sorted spans with overlapping or touching ones joined."""
    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = (F.struct(last["first_word"], F.greatest(last["end_word"], x["end_word"]), last["start"], F.greatest(last["end"], x["end"]))
                  .cast("struct<first_word:long,end_word:long,start:long,end:long>"))
        touches = (F.size(acc) > 0) & (x["first_word"] <= last["end_word"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.col(col), F.slice(F.col(col), 1, 0), step)
