"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are encoded by a tokenizer of the ``tokenizers`` library and written, in ascending order of
document id, as a sequence of self-contained sections (little-endian numbers):

    magic (8 bytes), shard, section, tokens before in the shard, documents, tokens, ranks, data bytes (u8 each)
    document ids (i8 each), which of them are null (u1 each), tokens of each document (u8 each)
    ranks            u4 each: the section's distinct ids, the most frequent first (ties: the smaller id)
    control bytes    2 bits a token, four tokens a byte: bytes of its rank less one
    data bytes       the ranks, 1 to 4 bytes each, the lowest byte first

Frequent ids have small ranks and take one byte of data. Ranks count all ids of their section, so one scan
writes the files, a section is read without any other, and new files never need old ones coded
again. Control bytes stand apart from the data, so a reader gets the lengths of four tokens
by looking one byte up in a table, their sum gives all places at once, and no byte is
tested on its own.

Documents are dealt into shards by ranges of (id, hash of the text, row), so neither one id nor copies of one text
can fill a shard. A task streams its shard in order and holds one section at a time. Sections
go out by Spark's text writer, one row each, with a marker as the line separator: a lost
task leaves no part of a file behind.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import documents_of, release_freed

# fixed values of the format
MAGIC = b"TIDS\x00\x01\r\n"
MARKER = "\nTIDS-END\n"
HEAD = np.dtype([(n, "<i8") for n in ("shard", "section", "before", "documents", "tokens", "ranks", "data")])
#: Bytes of each of the four ranks that a control byte speaks of.
LENGTHS = (1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)).astype("u1")

#: Tokens of one section, about: a longer document is a section of its own size.
SECTION_TOKENS = 1 << 20
#: Sections of one file, at most.
SECTIONS = 8
#: Text bytes of one shard, at least; there are at most ``SHARDS`` shards.
SHARD_BYTES, SHARDS = 32 << 20, 100_000
#: Text bytes that are encoded at a time, and units of text that a worker remembers with their ids, at most.
ENCODE_BYTES, REMEMBERED = 6 << 20, 3 << 17
#: Units that the library encodes in one call, at most.
AT_ONCE = 1 << 14
#: Units longer than this are not remembered.
UNIT_BYTES = 64


# ---- encoding -----------------------------------------------------------------------------
# What a byte of UTF-8 is to a byte-level tokenizer with its usual pattern. It never joins a character that is no white space with
# white space behind it, a lone line break with what follows, or a letter with a mark behind it: texts are cut there.
SPACE, BREAK, BLANK, LETTER, MARK, WIDE = (1 << k for k in range(6))
KIND = np.zeros(256, "u1")
for _kind, _bytes in ((SPACE, b" "), (BREAK, b"\n"), (BLANK, b"\t\n\x0b\x0c\r "), (MARK, b".,!?;:%$#&*"), (WIDE, bytes(range(0x80, 0x100))),
                      (LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
    KIND[list(_bytes)] |= _kind
#: White space of two and three bytes, and the bytes of the latter as numbers.
WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS_2, BLANKS_3 = (np.array([int.from_bytes(c.encode(), "big") for c in WIDE_BLANKS if len(c.encode()) == n]) for n in (2, 3))
#: Units that are one word of the pattern, with a space before it or none: letters below U+0530 have been letters in all versions of Unicode since.
ONE_WORD = "^ ?[" + "".join(c for c in map(chr, range(0x530)) if c.isalpha()) + "]+$"


def byte_characters() -> dict[int, str]:
    """The character for each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    out, shifted = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out[b] = chr(b)
        else:
            out[b], shifted = chr(0x100 + shifted), shifted + 1
    return out


def wide_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space of more than one byte begins at each place."""
    a, b, c = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(3))
    return np.isin(a << 8 | b, BLANKS_2) | np.isin(a << 16 | b << 8 | c, BLANKS_3)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Before which bytes of texts in a row, as UTF-8, a text may be cut; the last of the flags is for the end."""
    cut = np.zeros(len(data) + 1, bool)
    kind = KIND[data]
    before, here = kind[:-1], kind[1:]
    cut[1:-1] = (here & (SPACE | BREAK) != 0) & (before & BLANK == 0)
    last = np.flatnonzero(cut[1:-1] & (before & WIDE != 0)) + 1
    two, three = np.maximum(last - 2, 0), np.maximum(last - 3, 0)
    cut[last[wide_blank(data, two) & (data[two] == 0xC2) | wide_blank(data, three) & (data[three] >= 0xE1)]] = False
    after = np.flatnonzero(cut[1:-1] & (here & BREAK != 0)) + 2  # behind a line break, if no white space follows
    after = after[after < len(data)]
    cut[after[(kind[after] & BLANK == 0) & ~wide_blank(data, after)]] = True
    cut[1:-1] |= (here & MARK != 0) & (before & LETTER != 0)
    return cut


def array_of(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The large strings or binaries that lie between ``offsets`` of ``data``."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, "<i8")), pa.py_buffer(data)])


def offsets_of(array: pa.Array) -> np.ndarray:
    if not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], "<i8", len(array) + 1, 8 * array.offset)


def bytes_of(array: pa.Array) -> np.ndarray:
    """The bytes of large strings or binaries in a row."""
    at, data = offsets_of(array), array.buffers()[2]
    return np.frombuffer(data, "u1", int(at[-1] - at[0]), int(at[0])) if at[-1] > at[0] else np.zeros(0, "u1")


class Encoder:
    """Ids of texts by a tokenizer file of the ``tokenizers`` library, without special tokens added.

    Under a byte-level tokenizer with its usual pattern and no normaliser texts are cut where the pattern never joins
    them (``cut_places``), and each distinct unit is encoded once per batch, or remembered; units that are one
    word go straight to the library's model. Under other tokenizers texts are encoded whole.
    Units and their ids are Arrow arrays throughout: one dictionary encoding of the remembered units and a batch's
    numbers them all, and a unit is a Python string only when the library is asked for it.
    Strings of special tokens within a text are ordinary text.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not config.get("normalizer") and not config.get("post_processor"))
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        of_bytes = byte_characters()
        self.bytes = np.array([ord(of_bytes[k]) for k in range(256)], "<u2")
        self.bytes[0x0A] = 0x0A  # stands between words
        self.space = of_bytes[0x20]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of pieces that begin with a space
        self.spaced[[i for p, i in vocabulary.items() if p.startswith(self.space)]] = True
        self.end = np.array([] if end_id is None else [end_id], "<u4")
        # two generations of units, no unit in both, and the ids of each
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.older, self.older_ids = self.known, self.known_ids

    def whole(self, texts: list[str]) -> pa.Array:
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return array_of(pa.large_binary(), 4 * np.cumsum([0, *map(len, ids)]), np.concatenate([self.end[:0], *ids]))

    def words(self, units: pa.Array, spaced: bool) -> pa.Array:
        """Ids of units that are one word of the tokenizer's pattern each: all begin with a space, or a space is put between them as a word."""
        out, between = [], pa.scalar("\n" if spaced else "\n \n", pa.large_string())
        for a in range(0, len(units), AT_ONCE):
            some = units[a : a + AT_ONCE]
            joined = bytes_of(pc.binary_join(pa.LargeListArray.from_arrays([0, len(some)], some), between))
            mapped = self.bytes[joined].tobytes().decode("utf-16-le")
            ids = np.array(self.model.encode_batch_fast([mapped if spaced else f"{self.space}\n{mapped}"], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.spaced[ids])
            if not spaced:
                ids, first = np.delete(ids, first), first - np.arange(len(first))
            out.append(array_of(pa.large_binary(), 4 * np.append(first, len(ids)), ids))
        return pa.chunked_array(out, pa.large_binary()).combine_chunks()

    def ids_of(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units, by the library."""
        one = pc.match_substring_regex(units, ONE_WORD).to_numpy(zero_copy_only=False)
        spaced = pc.starts_with(units, " ").to_numpy(zero_copy_only=False)
        places = [np.flatnonzero(x) for x in (one & spaced, one & ~spaced, ~one)]
        with_space, bare, other = (units.take(pa.array(x)) for x in places)
        got = pa.concat_arrays([self.words(with_space, True), self.words(bare, False), self.whole(other.to_pylist())])
        return got.take(pa.array(np.argsort(np.concatenate(places), kind="stable")))

    def units(self, units: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of the remembered units and of all distinct ones given, and the place of each given unit among them."""
        n, m = len(self.known), len(self.known) + len(self.older)
        coded = pa.chunked_array([self.known, self.older, units]).dictionary_encode().chunks  # none for an empty array
        every = coded[-1].dictionary if coded else units
        index = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded)])[m:]
        ids = pa.concat_arrays([self.known_ids, self.older_ids, self.ids_of(every[m:])])
        used = np.zeros(len(every), bool)
        used[index] = True
        size = REMEMBERED // 2
        new = np.flatnonzero(used[n:] & (np.diff(offsets_of(every))[n:] <= UNIT_BYTES))[:size] + n
        if n + len(new) > size:  # two generations: what was used since the last change stays
            self.older, self.older_ids = self.known, self.known_ids
            keep = new
        else:
            old = pa.array(np.flatnonzero(~used[n:m]) + n)
            self.older, self.older_ids = every.take(old), ids.take(old)
            keep = np.concatenate((np.arange(n), new))
        self.known, self.known_ids = every.take(pa.array(keep)), ids.take(pa.array(keep))
        return ids, index

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; null is empty, the end id closes each."""
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not n:
            return self.end[:0], np.zeros(0, np.int64)
        if self.cuts:
            data, at = bytes_of(texts), offsets_of(texts)
            at = at - at[0]
            cut = cut_places(data)
            cut[at] = True
            places = np.flatnonzero(cut)
            bounds = np.searchsorted(places, at)
            entries, index = self.units(array_of(pa.large_string(), places, data))
        else:
            entries, index, bounds = self.whole(texts.to_pylist()), np.arange(n), np.arange(n + 1)
        entries = pa.concat_arrays([entries, array_of(pa.large_binary(), np.array([0, self.end.nbytes]), self.end)])
        taken = entries.take(pa.array(np.insert(index, bounds[1:], len(entries) - 1)))
        return bytes_of(taken).view("<u4"), np.diff(offsets_of(taken)[bounds[1:] + np.arange(1, n + 1)] // 4, prepend=0)


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int | None) -> Encoder:
    """The worker's encoder, with the units it remembers, from one task to the next."""
    return Encoder(path, end_id)


# ---- coding -------------------------------------------------------------------------------
def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, the most frequent first (ties: the smaller), and the rank of each given id."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        order = distinct[np.argsort(-counts[distinct], kind="stable")]
        rank = np.zeros(len(counts), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return order.astype("<u4"), rank[ids]
    distinct, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return distinct[order].astype("<u4"), rank[place]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2^32."""
    extra = (values > 0xFF).astype("u1") + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, "u1")
    four[: len(values)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = int(extra.max(initial=0)) + 1
    planes = values.astype("<u4").view("u1").reshape(-1, 4)[:, :used].ravel()  # flat, as are the flags: a plain selection
    return control.astype("u1").tobytes(), planes[(np.arange(used, dtype="u1") <= extra[:, None]).ravel()].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of control and data bytes: lengths by table, places by their running sum."""
    lengths = LENGTHS[control].ravel()[:n]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate((data, np.zeros(4, "u1")))
    out = padded[start].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        out[more] |= padded[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def section_bytes(shard: int, section: int, before: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    ranks, coded = rank_ids(ids)
    control, data = pack(coded)
    head = np.array([(shard, section, before, len(doc_ids), len(ids), len(ranks), len(data))], HEAD)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    return b"".join((MAGIC, head.tobytes(), known.tobytes(), null.tobytes(), counts.astype("<u8").tobytes(), ranks.tobytes(), control, data))


def sections_of(data: bytes | memoryview) -> Iterator[tuple[np.void, list[int | None], np.ndarray, np.ndarray]]:
    """Head, document ids, tokens of each document, and ids of every section of a file."""
    at, marker = 0, MARKER.encode()
    while at < len(data):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError(f"no section at byte {at}")
        at += len(MAGIC)
        head = np.frombuffer(data, HEAD, 1, at)[0]
        at += HEAD.itemsize

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, dtype, int(n), at)
            at += a.nbytes
            return a

        docs, tokens = int(head["documents"]), int(head["tokens"])
        known, null, counts, ranks = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", head["ranks"])
        ids = ranks[unpack(take("u1", -(-tokens // 4)), take("u1", head["data"]), tokens)] if tokens else ranks[:0]
        if data[at : at + len(marker)] != marker:
            raise ValueError(f"no end of section at byte {at}")
        at += len(marker)
        yield head, [None if z else d for d, z in zip(known.tolist(), null.tolist(), strict=True)], counts.astype(np.int64), ids


# ---- Spark --------------------------------------------------------------------------------
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``ENCODE_BYTES`` of text."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // ENCODE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield b.slice(s, e - s)


def _sections(tokenizer: str, end_id: int | None, section_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(tokenizer, end_id)
    shard, section, before = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal section, before, held, size
        made = section_bytes(shard, section, before, [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        section, before, held, size = section + 1, before + size, [], 0
        release_freed()  # or what a section took stays with the worker, also while other stages run
        return pa.RecordBatch.from_pydict({"section": pa.array([made], pa.binary())})

    for b in _pieces(batches):
        doc_ids = b.column("doc_id").to_pylist()
        ids, counts = encoder.encode(b.column("text"))
        stop = np.cumsum(counts)
        s = 0
        while s < len(doc_ids):  # documents up to the one that fills the section
            done = int(stop[s - 1]) if s else 0
            e = min(len(doc_ids), int(np.searchsorted(stop, done + section_tokens - size)) + 1)
            held.append((doc_ids[s:e], counts[s:e], ids[done : int(stop[e - 1])]))
            size += int(stop[e - 1]) - done
            s = e
            if size >= section_tokens:
                yield flush()
    if held:
        yield flush()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                      section_tokens: int = SECTION_TOKENS, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every text to files under ``path`` (a new folder), in ascending order of document id.

    tokenizer   file of the ``tokenizers`` library, at the same place on every machine
    end_id      id put after each document, if any

    Null texts are empty and make just the end id; bytes that are no UTF-8 count as U+FFFD; null ids come first; rows that share an id are all kept, in the
    order of a hash of their texts; a very long text is one document of one section. Other columns are not read. An
    empty table makes a folder without sections.
    """
    rows = (documents_of(docs, id_col, text_col).withColumn("text", F.make_valid_utf8(F.coalesce("text", F.lit(""))))
            .withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(SHARDS, max(1, math.ceil(total / shard_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = dealt.mapInArrow(partial(_sections, tokenizer, end_id, section_tokens), "section binary")
    made.select(F.col("section").cast("string").alias("value")).write.option("lineSep", MARKER).option("maxRecordsPerFile", SECTIONS).text(path)


DOCUMENT = "shard long, section long, place long, doc_id long, before long, n_tokens long, ids_crc32 long, ids array<long>"


def _documents(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            for head, doc_ids, counts, ids in sections_of(memoryview(content.as_buffer())):
                n = len(doc_ids)
                stop = np.cumsum(counts)
                whole = ids.astype("<u4")
                crc = [zlib.crc32(whole[e - c : e]) for e, c in zip(stop.tolist(), counts.tolist(), strict=True)]
                values = pa.array(ids.astype(np.int64)) if with_ids else pa.array([], pa.int64())
                offsets = pa.array(np.concatenate(([0], stop if with_ids else 0 * stop)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(n, head["shard"])), "section": pa.array(np.full(n, head["section"])), "place": pa.array(np.arange(n)),
                    "doc_id": pa.array(doc_ids, pa.int64()), "before": pa.array(int(head["before"]) + stop - counts), "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array(crc, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, values)})
    release_freed()


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian u4), ids.

    One row per document of the files that :func:`write_token_files` wrote under ``path``; ``ids`` is empty unless
    ``with_ids``. The tokens of each shard (at most ``SHARDS`` numbers) pass through the driver. A file that is cut
    off or not of the format is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    rows = files.mapInArrow(partial(_documents, with_ids), DOCUMENT)
    totals = files.mapInArrow(_totals, "shard long, tokens long").groupBy("shard").agg(F.sum("tokens").alias("tokens")).collect()
    offsets, at = [], 0
    for shard, tokens in sorted(map(tuple, totals)):
        offsets.append((shard, at))
        at += tokens
    found = rows.join(F.broadcast(spark.createDataFrame(offsets, "shard long, offset long")), "shard")
    return found.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each section by the heads alone."""
    for b in batches:
        for content in b.column("content"):
            heads = list(heads_of(memoryview(content.as_buffer())))
            yield pa.RecordBatch.from_pydict({k: pa.array([int(h[k]) for h in heads], pa.int64()) for k in ("shard", "tokens")})


def heads_of(data: bytes | memoryview) -> Iterator[np.void]:
    """The heads of a file's sections, skipping what lies between."""
    at = 0
    while at < len(data):
        head = np.frombuffer(data, HEAD, 1, at + len(MAGIC))[0]
        yield head
        docs, tokens, ranks, packed = (int(head[k]) for k in ("documents", "tokens", "ranks", "data"))
        at += len(MAGIC) + HEAD.itemsize + 17 * docs + 4 * ranks + -(-tokens // 4) + packed + len(MARKER)
