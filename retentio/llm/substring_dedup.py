"""Substring deduplication: content-defined chunks, deduplicated by digest.

A gear rolling hash over the bytes (16 bits wide, so it depends on the last 16 bytes only)
declares a chunk boundary after a white-space byte where its top bits are zero. Where the last
``STRETCH`` bytes hold no white space (scripts without spaces, encoded or minified runs), it may
declare one before any character, with more zero bits. Boundaries
depend on nearby content alone, so an insertion moves the chunks around it and no others.
A chunk whose digest occurs earlier (in the order of doc_id, then position) is a repeat; a run
of repeats that is long enough (``min_words`` words, or ``min_bytes`` bytes for text without
spaces) is removed, so that short phrases which any two texts may share stay.

Digests are shared by the ask/answer exchange of ``common``: each block of documents sends
its distinct digests once, with the first document that has them, and gets back which of
them an earlier document owns. A line that every document holds is one key per block.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import BLOCK_BYTES, KEYS, answers_of, ask_and_answer, block_count, blocks, buckets_of, release_freed

WINDOW = 16
#: Bytes without white space (a power of two) after which a boundary needs none.
STRETCH = 64
#: The gear table: 256 pseudo-random 16-bit numbers, the same in every run.
GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 16, 256, dtype=np.uint16)
NO_ID = np.iinfo(np.int64).max
ASKED = {"d64": KEYS, "d32": "<u4", "doc": "<i8"}


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i-1] + GEAR[data[i]] mod 2^16 for all i at once, by doubling the window."""
    h = GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint16(s)
    return h


def trailing(found: np.ndarray, n: int) -> np.ndarray:
    """Whether all of the last n flags (a power of two) are set; before the n-th, all so far."""
    all_set, s = found.copy(), 1
    while s < n:
        all_set[s:] &= all_set[:-s]
        s *= 2
    return all_set


def stretch_cuts(data: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Ends of chunks inside stretches without white space: before a character, where the top
    ``bits`` + 2 bits of the hash are zero here and at no character of the ``WINDOW`` bytes
    before, so that a run of one character has no cut and cuts are over ``WINDOW`` bytes apart.
    """
    low = np.zeros(len(data), bool)
    low[:-1] = (h[:-1] < (1 << (WINDOW - bits - 2))) & ((data[1:] & 0xC0) != 0x80)
    first = low.copy()
    first[1:] &= trailing(~low, WINDOW)[:-1]
    return first & trailing(data > 32, STRETCH)


def chunk_starts(data: np.ndarray, offsets: np.ndarray, bits: int = 2, longest: int = 256) -> np.ndarray:
    """Sorted start positions of the chunks of texts that lie one after another in ``data``.

    On average every 2^bits-th word ends a chunk, and in a stretch without white space about
    every 40 to 70 bytes (with 2 bits); beyond ``longest`` bytes without either, as in a run of one
    character, a chunk is cut at the next character.
    """
    begin = offsets[:-1][np.diff(offsets) > 0]
    if not len(begin):
        return begin
    h = gear_hash(data)
    inside = stretch_cuts(data, h, bits)
    at = np.flatnonzero(inside | (data <= 32) & (h < (1 << (WINDOW - bits)))) + 1
    at = at[at < offsets[-1]]
    doc = np.searchsorted(begin, at, "right") - 1
    # before that the window holds bytes of another text
    at = at[at - begin[doc] >= np.where(inside[at - 1], STRETCH, WINDOW)]
    starts = np.union1d(begin, at)
    ends = np.append(starts[1:], offsets[-1])
    over = ends - starts > longest
    if over.any():
        more = np.concatenate([np.arange(s + longest, e, longest) for s, e in zip(starts[over], ends[over], strict=True)])
        for _ in range(3):
            inside = (data[more] & 0xC0) == 0x80
            more = more + inside
            more = more[more < offsets[-1]]
        starts = np.union1d(starts, more)
    return starts


class Chunks:
    """The chunks of one block's documents, in the order of doc_id and position.

    Rows equal in doc_id and text are one document; null ids come last.
    """

    def __init__(self, t: pa.Table, bits: int, longest: int):
        ids = [NO_ID if i is None else i for i in t.column("doc_id").to_pylist()]
        texts = t.column("text").cast(pa.large_binary()).to_pylist()
        keys = [(i, x or b"") for i, x in zip(ids, texts, strict=True)]
        docs = sorted(set(keys))
        place = {k: n for n, k in enumerate(docs)}
        self.row_doc = [place[k] for k in keys]
        self.raw = b"".join(x for _, x in docs)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for _, x in docs]))).astype(np.int64)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts = chunk_starts(self.data, self.offsets, bits, longest)
        self.ends = np.append(self.starts[1:], self.offsets[-1])[: len(self.starts)]
        digest, raw = xxhash.xxh3_128_digest, self.raw
        packed = b"".join([digest(raw[s:e]) for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])
        self.digests = np.frombuffer(packed, np.dtype([("d64", "<u8"), ("d32", "<u4"), ("rest", "<u4")]))
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        d64, d32 = self.digests["d64"], self.digests["d32"]
        order = np.argsort(d64, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (d64[order[1:]] != d64[order[:-1]]) | (d32[order[1:]] != d32[order[:-1]])
        self.first = order[new]  # of each distinct digest, the earliest chunk
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.doc_ids = np.array([i for i, _ in docs], np.int64)

    def asked(self, n: int) -> list[dict[str, np.ndarray]]:
        d = self.digests[self.first]
        doc = self.doc_ids[self.doc[self.first]] if len(self.first) else np.empty(0, np.int64)
        return [{"d64": d["d64"][s:e], "d32": d["d32"][s:e], "doc": doc[s:e]} for s, e in zip(*buckets_of(d["d64"], n), strict=True)]

    def removed(self, owned_elsewhere: np.ndarray, min_words: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of chunks of each run of repeats that goes."""
        repeat = np.ones(len(self.starts), bool)
        repeat[self.first] = False
        repeat |= owned_elsewhere[self.entry].astype(bool)
        if not repeat.any():
            return (np.empty(0, np.int64),) * 3
        joins = np.zeros(len(repeat), bool)  # continues the run of the chunk before
        joins[1:] = repeat[1:] & repeat[:-1] & (self.doc[1:] == self.doc[:-1])
        heads = np.flatnonzero(repeat & ~joins)
        tails = np.flatnonzero(repeat & ~np.append(joins[1:], False))
        space = self.data <= 32
        word = ~space
        word[1:] &= space[:-1]
        word[self.offsets[:-1][np.diff(self.offsets) > 0]] = ~space[self.offsets[:-1][np.diff(self.offsets) > 0]]
        words = np.zeros(len(word) + 1, np.int32)
        np.cumsum(word, out=words[1:])
        s, e = self.starts[heads], self.ends[tails]
        goes = (words[e] - words[s] >= min_words) | (e - s >= min_bytes)
        return s[goes], e[goes], (tails - heads + 1)[goes]


def _ask(n: int, bits: int, longest: int, t: pa.Table) -> list[dict[str, np.ndarray]]:
    release_freed()  # of the block before
    return Chunks(t, bits, longest).asked(n)


def _owned_elsewhere(asked: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    sizes = [len(a["d64"]) for a in asked]
    d64, d32, doc = (np.concatenate([a[n] for a in asked]) for n in ASKED)
    block = np.repeat(np.arange(len(asked)), sizes)
    order = np.lexsort((block, doc, d32, d64))
    same = np.zeros(len(order), bool)
    same[1:] = (d64[order[1:]] == d64[order[:-1]]) & (d32[order[1:]] == d32[order[:-1]])
    out = np.zeros(len(order), np.uint8)
    out[order] = same
    return np.split(out, np.cumsum(sizes)[:-1])


def _apply(bits: int, longest: int, min_words: int, min_bytes: int, t: pa.Table, answers: pa.Table) -> pa.Table:
    release_freed()
    c = Chunks(t, bits, longest)
    got = answers_of(answers, "u1")
    s, e, n = c.removed(np.concatenate(got) if got else np.empty(0, np.uint8), min_words, min_bytes)
    lo, hi = np.searchsorted(s, c.offsets[:-1], "left"), np.searchsorted(s, c.offsets[1:], "left")
    chunks = np.bincount(c.doc, minlength=len(c.doc_ids))
    nulls = t.column("text").is_null().to_pylist()
    cols: dict[str, list] = {k: [] for k in ("text", "n_chunks", "n_repeated", "removed_bytes", "removed")}
    for null, d in zip(nulls, c.row_doc, strict=True):
        at, end, parts, runs = int(c.offsets[d]), int(c.offsets[d + 1]), [], []
        begin = at
        for k in range(lo[d], hi[d]):
            parts.append(c.raw[at : int(s[k])])
            at = int(e[k])
            runs.append({"start": int(s[k]) - begin, "end": at - begin})
        parts.append(c.raw[at:end])
        cols["text"].append(None if null else b"".join(parts).decode())
        cols["n_chunks"].append(int(chunks[d]))
        cols["n_repeated"].append(int(n[lo[d] : hi[d]].sum()))
        cols["removed_bytes"].append(sum(r["end"] - r["start"] for r in runs))
        cols["removed"].append(runs)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    made = {"text": pa.array(cols["text"], pa.string())} | {k: pa.array(cols[k], pa.int64()) for k in ("n_chunks", "n_repeated", "removed_bytes")}
    return pa.table({"doc_id": t.column("doc_id")} | made | {"removed": pa.array(cols["removed"], span)}
                    | ({"row": t.column("row")} if "row" in t.column_names else {}))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 16,
                     min_bytes: int = 256, bits: int = 2, longest: int = 256, block_bytes: int = BLOCK_BYTES,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the text without repeated passages, and what went.

    doc_id, text (null stays null; a copy of an earlier text becomes empty), n_chunks,
    n_repeated and removed_bytes (of the removed runs), removed (byte spans in the given
    text), then the columns named in ``keep``. The occurrence with the smallest doc_id, then
    position, stays; null ids come last; rows equal in id and text are one document and get
    the same result. Other columns are not read, and an empty table gives an empty result.
    """
    picked = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    kept = docs.select(*keep).schema if keep else None
    texts = docs.select(*picked, *([F.struct(*keep).alias("row")] if keep else []))
    n = block_count(texts, block_bytes)
    dealt = blocks(texts, n)
    answers = ask_and_answer(dealt, n, partial(_ask, n, bits, longest), _owned_elsewhere, ASKED, "u1")
    schema = ("doc_id long, text string, n_chunks long, n_repeated long, removed_bytes long, "
              "removed array<struct<start:long,end:long>>" + (f", row {kept.simpleString()}" if keep else ""))
    out = (dealt.groupBy("block").cogroup(answers.groupBy("block"))
           .applyInArrow(partial(_apply, bits, longest, min_words, min_bytes), schema))
    own = [F.col(c) for c in ("doc_id", "text", "n_chunks", "n_repeated", "removed_bytes", "removed")]
    return out.select(*own, *(F.col("row")[c].alias(c) for c in keep))
