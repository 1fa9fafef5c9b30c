import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from retentio.llm import warc as W
from retentio.llm.queries import digests_of_archives

SCHEMA = "page_id long, url string, html string, payload string, name string, id long"


def slow(rows, least=1000):
    first = {}
    for i, _, h in rows:
        if i is not None:
            k = (h or "").encode()
            first[k] = max(first.get(k, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        back = len(p) >= least and p in first and first[p] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if back else "response", first[p] if back else None))
    return sorted(out, key=str)


def run(spark, rows, path, **sizes):
    pages = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)
    W.write_archives(pages, path, **sizes)
    got = digests_of_archives(spark, path)
    return sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def pages():
    rng = random.Random(1)
    page = lambda n: "<p>" + "".join(rng.choices("abcé\r\n 漢", k=n))
    same, short, long = page(1500), page(100), page(90_000)
    rows = [(i, f"http://h/{i}", page(rng.randint(0, 5000))) for i in range(30)]
    rows += [(40, "u", same), (41, "u v\r\nX: y", same), (42, None, same), (43, "u", short), (44, "u", short), (45, "u", long), (46, "u", long), (47, "u", page(200_000))]
    rows += [(50, "u", None), (51, "u", ""), (None, "u", same), (None, "u", page(70_000)), (None, None, None), (42, None, same), (46, "u", long), (45, "u", long)]
    rows += [(60, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (61, "u", "\r\n\r\n" * 400), (62, "u", "0\r\n\r\n")]
    return rows


def test_round_trip_with_revisits_segments_and_odd_rows(spark, tmp):
    assert run(spark, pages(), f"{tmp}/a") == slow(pages())
    assert run(spark, pages(), f"{tmp}/b", segment_bytes=700, chunk_bytes=64) == slow(pages())


def test_all_null_ids_are_responses(spark, tmp):
    rows = [(None, "u", "x" * 2000)] * 3
    assert run(spark, rows, f"{tmp}/a") == slow(rows)


def test_empty_table(spark, tmp):
    assert run(spark, [], f"{tmp}/a") == []


def test_payloads_and_headers_come_back(spark, tmp):
    rows = pages()
    spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA).transform(lambda d: W.write_archives(d, f"{tmp}/a", segment_bytes=4000) or d)
    got = W.read_archives(spark, f"{tmp}/a").collect()
    back = {bytes(r.payload) for r in got if r.record_type == "response"}
    assert back == {(h or "").encode() for _, _, h in rows} and len(got) == len(rows)
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.digest for r in got if r.payload is not None)
    assert any(r.target_uri == "u%20v%0D%0AX:%20y" for r in got) and any(r.target_uri is None for r in got)


def segmented(name, payload, size=300):
    return W.records_of(name, "u", payload, hashlib.sha1(payload).hexdigest(), None, size, 64)


def test_segments_in_any_order_over_several_files(spark, tmp_path):
    rng = random.Random(3)
    payloads = {f"urn:x-page:{i}:s": bytes(rng.choices(b"abc\r\n", k=2000)) for i in range(5)}
    records = [r for n, p in payloads.items() for r in segmented(n, p)]
    rng.shuffle(records)
    (tmp_path / "a").mkdir()
    for k in range(3):
        members = [gzip.compress(r + W.END) for r in records[k::3]]  # a gzip member per record
        (tmp_path / "a" / f"part-{k}.txt.gz").write_bytes(b"".join(members))
    got = {r.record_id: bytes(r.payload) for r in W.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == payloads


@pytest.mark.parametrize("drop", [0, 2, -1])
def test_a_missing_segment_leaves_no_payload(spark, tmp_path, drop):
    records = segmented("urn:x-page:1:s", b"abc" * 900)
    del records[drop]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.txt").write_bytes(W.END.join(records) + W.END)
    got = W.read_archives(spark, str(tmp_path / "a")).select("record_id", F.col("payload").isNull().alias("none")).collect()
    assert [tuple(r) for r in got] == [("urn:x-page:1:s", True)]


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n"
    assert W.payload_of(head + b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: v\r\n\r\n") == b"abc0123456789"
    for cut in (b"3\r\nab", b"", b"zz\r\n", b"3\r\nabc\r\n"):
        assert W.payload_of(head + cut) is None
    assert W.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and W.payload_of(b"no head") is None


def plain(name, payload=b"payload"):
    return W.record(b"response", name, W.HEAD + W.chunked(payload, 64))


def test_bad_records_are_rows_with_an_error_and_the_others_come(spark, tmp_path):
    good = [plain(b"n:%d" % i) for i in range(9)]
    cut = lambda old, new: plain(b"bad:x").replace(old, new)
    bad = [cut(b"Content-Length", b"Content-Size"), cut(b"WARC-Type", b"WARC-Kind"), cut(b"WARC/1.1", b"JUNK"), cut(b"Content-Length: ", b"Content-Length: -"),
           cut(b"WARC-Record-ID", b"X"), cut(b"Content-Length", b"WARC-Segment-Number: one\r\nContent-Length"), cut(b"0\r\n\r\n", b"zz\r\n\r")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.txt").write_bytes(W.END.join(x for p in zip(good, bad) for x in p) + W.END + good[7] + W.END + good[8][:-3])
    got = W.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted(r.record_id for r in got if not r.error) == [f"n:{i}" for i in range(8)]
    assert all(bytes(r.payload) == b"payload" for r in got if not r.error)
    errors = sorted(r.error for r in got if r.error)
    assert errors == sorted(["no usable content-length"] * 2 + ["no usable warc-type", "no record", "no usable warc-record-id", "no usable warc-segment-number", "damaged framing", "cut short"])
    assert all(r.payload is None for r in got if r.error)


def test_damaged_gzip_members(spark, tmp_path):
    members = [gzip.compress(plain(b"n:%d" % i, random.Random(i).randbytes(3000)) + W.END) for i in range(5)]
    members[1] = members[1][:1500] + b"\xff" * 40 + members[1][1540:]
    members[3] = members[3][:100]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.txt.gz").write_bytes(b"".join(members))
    (tmp_path / "a" / "part-1.txt.gz").write_bytes(b"")
    got = W.read_archives(spark, str(tmp_path / "a")).collect()
    assert {"n:0", "n:2", "n:4"} <= {r.record_id for r in got if not r.error}
    assert sum(r.error == "damaged gzip member" for r in got) >= 2 and not {"n:1", "n:3"} & {r.record_id for r in got if not r.error}


def test_many_members_take_linear_time():
    data = gzip.compress(b"x" * 50) * 200_000
    assert W.gunzip(data) == (b"x" * 10_000_000, 0)
