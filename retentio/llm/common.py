"""Helpers shared by the operators of this subpackage.

``blocks`` / ``ask_and_answer`` implement one communication pattern used where a model or an
index grows with the corpus and therefore cannot be broadcast: documents are dealt into
blocks of bounded size, each block sends its *distinct* keys (packed numpy arrays) to key
buckets, each bucket answers every block that asked, and the block is processed together
with its answers. A key that is frequent everywhere is sent once per block, so no bucket
receives a hot key's occurrences. All steps are plain shuffles: a lost executor recomputes
its blocks or buckets, and nothing passes through the driver.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.session import checkpoint_dir

#: Text bytes of one block, at least: bounds what one task holds (a longer single text is a block of its own size).
BLOCK_BYTES = 8 << 20
#: Text bytes per packed message between a block and a bucket, at least: blocks grow with the root of the corpus.
MESSAGE_BYTES = 4 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the folder of ``spark.checkpoint.dir``."""
    return os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names: other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str, parts: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == remainder


def text_bytes(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], col: str, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text column ``col``; a longer text is a batch of its own."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield b.slice(at, end - at)
            at = end
        if not b.num_rows:
            yield b


def release_freed() -> None:
    """Give memory that is no longer used back to the system: a Python worker serves one stage after another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the texts make (one aggregate over all rows).

    n blocks exchange n * n messages, so a block holds ``block_bytes`` or, if that is more, as
    much as keeps a message at ``MESSAGE_BYTES`` of text: 8 MB up to 16 GB, 650 MB at 100 TB.
    """
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = int(total or 0) + 64 * int(rows)
    return max(1, math.ceil(size / max(block_bytes, math.isqrt(size * MESSAGE_BYTES))))


def pack_counts(n: np.ndarray) -> bytes:
    """Non-negative numbers, mostly small, at a byte each; those of 255 and more follow in full."""
    big = np.flatnonzero(n >= 255)
    return np.int64(len(big)).tobytes() + big.astype("<i8").tobytes() + n[big].astype("<i8").tobytes() + np.minimum(n, 255).astype("u1").tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    k = int(np.frombuffer(packed, "<i8", 1)[0])
    at, full = np.frombuffer(packed, "<i8", 2 * k, 8).reshape(2, k)
    n = np.frombuffer(packed, "u1", offset=8 + 16 * k).astype(np.int64)
    n[at] = full
    return n


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane: the upper planes are zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T.tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


#: In place of a numpy type: numbers sent by ``pack_counts``, sorted keys sent by ``pack_keys``.
COUNTS, KEYS = "counts", "keys"


def _pack(a: np.ndarray, dtype: str) -> bytes:
    return pack_counts(a) if dtype == COUNTS else pack_keys(a) if dtype == KEYS else np.ascontiguousarray(a, dtype).tobytes()


def _unpack(packed: bytes, dtype: str) -> np.ndarray:
    return unpack_counts(packed) if dtype == COUNTS else unpack_keys(packed) if dtype == KEYS else np.frombuffer(packed, dtype)


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ``n`` blocks by a hash of both columns (null ids are no hot key)."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "block")


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one ``key`` each, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and k[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = k[s]
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def ask_and_answer(
    docs: DataFrame,
    n_blocks: int,
    ask: Callable[[pa.Table], list[dict[str, np.ndarray]]],
    answer: Callable[[list[dict[str, np.ndarray]]], list[np.ndarray]],
    dtypes: dict[str, str],
    answer_dtype: str,
) -> DataFrame:
    """(block, bucket, answer) for documents that ``blocks`` has dealt out.

    ask      documents of one block -> one dict of packed arrays per bucket (``n_blocks`` buckets)
    answer   the asked arrays of one bucket, one dict per block -> one array per block
    dtypes   numpy types (or ``COUNTS``, ``KEYS``) of the asked arrays by name, and of the answers
    """
    names = list(dtypes)
    asked = "bucket int, block int, " + ", ".join(f"{n} binary" for n in names)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "block"):
            block = t.column("block")[0].as_py()
            for bucket, arrays in enumerate(ask(t)):
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([bucket], pa.int32()), "block": pa.array([block], pa.int32())}
                    | {n: pa.array([_pack(arrays[n], dtypes[n])], pa.binary()) for n in names})

    def answering(t: pa.Table) -> pa.Table:
        who = t.column("block").to_numpy()
        order = np.argsort(who, kind="stable")
        parts = [t.column(n).to_pylist() for n in names]
        got = answer([{n: _unpack(p[i], dtypes[n]) for n, p in zip(names, parts, strict=True)} for i in order])
        return pa.table({"block": pa.array(who[order], pa.int32()), "bucket": t.column("bucket"),
                         "answer": pa.array([_pack(a, answer_dtype) for a in got], pa.binary())})

    return (docs.sortWithinPartitions("block").mapInArrow(asking, asked)
            .groupBy("bucket").applyInArrow(answering, "block int, bucket int, answer binary"))


def answers_of(t: pa.Table, dtype: str) -> list[np.ndarray]:
    """The answers to one block in the order of buckets."""
    bucket = t.column("bucket").to_numpy()
    raw = t.column("answer").to_pylist()
    return [_unpack(raw[i], dtype) for i in np.argsort(bucket, kind="stable")]


def buckets_of(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct 64-bit keys: where each of ``n`` equal ranges starts and ends."""
    width = (1 << 64) // n + 1
    at = np.searchsorted(keys, np.array([min(i * width, (1 << 64) - 1) for i in range(1, n)], np.uint64))
    return np.concatenate(([0], at)), np.concatenate((at, [len(keys)]))
