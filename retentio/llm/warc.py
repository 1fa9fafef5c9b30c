"""WARC archives: writing with payload-identical revisits and segments, reading with reassembly.

The writer turns each page into a ``response`` record (an HTTP head and the payload in chunked
transfer framing). Of pages with equal payloads, long enough ones keep one response and become
``revisit`` records that refer to it. A block longer than ``segment_bytes`` goes out as a first
segment and ``continuation`` records. Records are written by Spark's text writer, one row a
record, with the blank line between records as the line separator, so a lost task leaves no part
of a file behind.

The reader parses each archive, groups segments by the identifier of their origin, orders
them by number, verifies the total length and decodes the chunked framing. Only segments are
shuffled; whole records never move.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the formats
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: The date of all records: archives of the same pages are the same bytes.
DATE = b"2024-01-01T00:00:00Z"
#: Records of one file, at most; with ``segment_bytes`` this bounds what one task unpacks.
RECORDS = 4096
#: Bytes of a gzip file that are unpacked at a time.
GZIP_BYTES = 1 << 16


# ---- writing ------------------------------------------------------------------------------
def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def record(kind: bytes, name: bytes, block: bytes, *fields: tuple[bytes, bytes | None]) -> bytes:
    """One record without the blank line after its block; fields without a value are left out."""
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<%s>" % name), (b"WARC-Date", DATE), *fields, (b"Content-Length", b"%d" % len(block))]
    return VERSION + b"\r\n" + b"".join(b"%s: %s\r\n" % (k, v) for k, v in head if v is not None) + b"\r\n" + block


def records_of(name: str, url: str | None, payload: bytes, sha1: str, refers: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    uri = None if url is None else re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], url.encode())
    own = name.encode()
    common = ((b"WARC-Target-URI", uri), (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(sha1))), (b"Content-Type", b"application/http; msgtype=response"))
    if refers is not None:
        return [record(b"revisit", own, HEAD, *common, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", b"<%s>" % refers.encode()))]
    block = HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record(b"response", own, block, *common)]
    out, n = [], -(-len(block) // segment_bytes)
    for k in range(n):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            out.append(record(b"response", own, part, *common, (b"WARC-Segment-Number", b"1")))
        else:
            total = b"%d" % len(block) if k == n - 1 else None
            out.append(record(b"continuation", b"%s:%d" % (own, k + 1), part, (b"WARC-Segment-Origin-ID", b"<%s>" % own),
                              (b"WARC-Segment-Number", b"%d" % (k + 1)), (b"WARC-Segment-Total-Length", total)))
    return out


def _records(segment_bytes: int, chunk_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[bytes] = []
        size = 0
        for row in zip(*(b.column(n).to_pylist() for n in ("name", "url", "payload", "sha1", "refers")), strict=True):
            out += (new := records_of(*row, segment_bytes, chunk_bytes))
            size += sum(map(len, new))
            if size > 8 << 20:
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                out, size = [], 0
        yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   revisit_bytes: int = 1000, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13) -> None:
    """Writes one record (and its continuations) per row of ``pages`` to gzipped archives under ``path``.

    Null payloads are empty, null urls have no target. Of equal payloads of at least
    ``revisit_bytes`` bytes the largest id's is the response (rows repeated with that id all
    are), the others, null ids among them, revisit it; if all ids are null, all are responses.
    Other columns are not read; an empty table writes no record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    # one row per payload that occurs again; partial counts, so a payload of many copies is no single task
    again = (rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and first is not null").select(F.col("sha1").alias("digest"), "first"))
    joined = rows.join(again, F.col("sha1") == F.col("digest"), "left")  # AQE splits a payload of many copies
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    named = joined.select(_name("id").alias("name"), "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "sha1",
                          F.when(revisit, _name("first")).alias("refers"))
    out = named.mapInArrow(partial(_records, segment_bytes, chunk_bytes), "record binary")
    (out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS).text(path))


def _name(id_col: str):
    """Record identifier of a page: its id and payload digest."""
    return F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.col("sha1"))


# ---- reading ------------------------------------------------------------------------------
def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers (names in lower case) and block.

    What is no record comes with the header ``error`` and its bytes, up to where the next record
    begins; so does a record without a type, an identifier or a usable length.
    """
    at, n = 0, len(data)
    while True:
        while data.startswith(b"\r\n", at):
            at += 2
        if at >= n:
            return
        end = data.find(END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            at, start = _next_record(data, at), at
            yield {"error": "no record"}, data[start:at]
            continue
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        start, length = end + len(END), fields.get("content-length", "")
        missing = [k for k in ("warc-type", "warc-record-id") if not fields.get(k)]
        wrong = [k for k in ("warc-segment-number", "warc-segment-total-length") if not _number(fields.get(k, "0"))]
        if not _number(length):
            at = _next_record(data, start - 2)
            fields["error"] = "no usable content-length"
        else:
            at = start + int(length)
            if at > n:
                fields["error"] = "cut short"
            elif missing or wrong:
                fields["error"] = "no usable " + ", ".join(missing + wrong)
        yield fields, data[start:at]


def _number(text: str) -> bool:
    return text.isascii() and text.isdigit() and len(text) < 18


def _next_record(data: bytes, at: int) -> int:
    """Where the next record behind a place begins, or the end."""
    found = data.find(b"\nWARC/", at)
    return len(data) if found < 0 else found + 1


def gunzip(data: bytes) -> tuple[bytes, int]:
    """All members of a gzip file, and how many are damaged (what they give up to the fault is kept); anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        return data, 0
    out, damaged, at, n, view = [], 0, 0, len(data), memoryview(data)
    while 0 <= at < n:
        d, pos, good = zlib.decompressobj(31), at, False
        try:
            while pos < n and not d.eof:  # by parts: what lies behind a member is not copied with it
                out.append(d.decompress(view[pos : pos + GZIP_BYTES]))
                pos += GZIP_BYTES
            good = d.eof
        except zlib.error:
            pass
        if good:
            at = min(pos, n) - len(d.unused_data)
            if at >= n or data[at : at + 2] == b"\x1f\x8b":
                continue
        damaged += 1
        at = data.find(b"\x1f\x8b\x08", at + (not good))
    return b"".join(out), damaged


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP message, chunked framing decoded; None if it is cut short."""
    head, mark, body = block.partition(END)
    if not mark:
        return None
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or len(body) < end + 2 + size:
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "digest": "warc-payload-digest"}
PARSED = ", ".join(f"{k} string" for k in _FIELDS) + ", error string, origin string, number long, total long, block binary"
_ARROW = {**dict.fromkeys(_FIELDS, pa.string()), "error": pa.string(), "origin": pa.string(), "number": pa.int64(), "total": pa.int64(), "block": pa.binary()}


def _parse(segments: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            rows: list[tuple] = []
            size = 0
            data, damaged = gunzip(b.column("content")[i].as_py())
            if damaged and not segments:
                rows += [(*[None] * len(_FIELDS), "damaged gzip member", None, None, None, b"")] * damaged
            for f, block in parse(data):
                error = f.get("error")
                number = None if error else f.get("warc-segment-number")
                if (number is not None) != segments or (f.get("warc-type") == "warcinfo" and not error):
                    continue
                values = [f.get(k) for k in _FIELDS.values()]
                values[0], values[3] = (v and v.strip("<>") for v in (values[0], values[3]))
                origin = (f.get("warc-segment-origin-id") or f.get("warc-record-id") or "").strip("<>")
                total = None if error else f.get("warc-segment-total-length")
                rows.append((*values, error, origin, number and int(number), total and int(total), block))
                size += len(block)
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(_ARROW.items(), columns, strict=True)})


def reassemble(segments: pa.Table) -> pa.Table:
    """One whole record of the segments of one origin; its block is null if a segment is missing or the length is wrong."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["number"])
    first = rows[0] if rows[0]["number"] == 1 else dict.fromkeys(rows[0], None) | {"record_id": rows[0]["origin"], "record_type": "response", "origin": rows[0]["origin"]}
    block = b"".join(r["block"] for r in rows)
    whole = [r["number"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["total"] == len(block)
    error = None if whole else "segments missing or of another length"
    return pa.Table.from_pylist([first | {"total": len(block), "block": block if whole else None, "error": error}], pa.schema(list(_ARROW.items())))


def _digest(text: str | None) -> str | None:
    """Hex of a SHA-1 in base 32; null if it is none."""
    try:
        return base64.b32decode(text[5:]).hex() if text and text.startswith("sha1:") else None
    except ValueError:
        return None


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        types, blocks, digests, errors = (b.column(n).to_pylist() for n in ("record_type", "block", "digest", "error"))
        payload = [None if x is None or e or t == "revisit" else payload_of(x) for t, x, e in zip(types, blocks, errors, strict=True)]
        framing = [e or ("damaged framing" if p is None and t == "response" else None) for t, p, e in zip(types, payload, errors, strict=True)]
        columns = {n: b.column(n) for n in ("record_id", "record_type", "target_uri", "refers_to")}
        yield pa.RecordBatch.from_pydict(columns | {"digest": pa.array(map(_digest, digests), pa.string()), "payload": pa.array(payload, pa.binary()), "error": pa.array(framing, pa.string())})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, digest (hex SHA-1), payload, error of each record under ``path``.

    Continuations are joined to their origin. The payload is null for revisits, and for records with an ``error``:
    without a type, an identifier or a usable length, cut short, with segments that do not add up, or in
    damaged framing. Bytes that are no record, and damaged gzip members, are rows with an error too;
    the reader goes on behind them. A record that occurs again with the same
    identifier is returned as often as its first segment is there. An archive without records gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files.mapInArrow(partial(_parse, False), PARSED)
    parts = files.mapInArrow(partial(_parse, True), PARSED)
    once = parts.dropDuplicates(["origin", "number"])
    joined = once.groupBy("origin").applyInArrow(reassemble, PARSED)
    copies = parts.filter("number = 1").groupBy("origin").agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumnRenamed("origin", "o")
    again = joined.join(copies, F.col("origin") == F.col("o"), "left").withColumn("c", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    records = whole.unionByName(again.select(whole.columns))
    return records.mapInArrow(_payloads, "record_id string, record_type string, target_uri string, refers_to string, digest string, payload binary, error string")


def resolved(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes, payload_digest of narrow ``records`` rows.

    ``records`` has record_id, record_type, refers_to, payload_bytes and payload_digest, null in
    the last two for revisits, which take them from the record they refer to (null if it is not there).
    """
    held = (records.filter("record_type = 'response'").groupBy("record_id")
            .agg(F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d")).withColumnRenamed("record_id", "held"))
    plain = records.filter("record_type <> 'revisit'")
    back = (records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
            .join(held, F.col("refers_to") == F.col("held"), "left").withColumnsRenamed({"b": "payload_bytes", "d": "payload_digest"}).drop("held"))
    return plain.unionByName(back.select(plain.columns))
