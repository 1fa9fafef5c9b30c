import random

import numpy as np
import pyarrow as pa

from retentio.llm import substring_dedup as D

SF = "/root/testdata/sf0.01"


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = (2 * h + int(D.GEAR[b])) % 65536
        out.append(h)
    return out


def slow_chunks(text, longest=256):
    """(start, end) of the chunks of one text, by the rolling definition."""
    data = text.encode()
    h = slow_gear(data)
    cuts = [0] if data else []
    for i, b in enumerate(data[:-1]):
        if b <= 32 and h[i] < 1 << 14 and i + 1 >= 16:
            cuts.append(i + 1)
    out = []
    for s, e in zip(cuts, cuts[1:] + [len(data)]):
        at = s
        for p in range(s + longest, e, longest):
            while p < len(data) and data[p] & 0xC0 == 0x80:
                p += 1
            if p < len(data):
                out.append((at, p))
                at = p
        if at < e:
            out.append((at, e))
    return out


def slow_dedup(rows, min_words=16, min_bytes=256):
    """doc -> cleaned text, visiting documents in the order of doc_id."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        data, chunks = (text or "").encode(), slow_chunks(text or "")
        repeat = []
        for s, e in chunks:
            repeat.append(data[s:e] in seen)
            seen.add(data[s:e])
        kept, k = b"", 0
        while k < len(chunks):
            j = k
            while j < len(chunks) and repeat[j]:
                j += 1
            run = data[chunks[k][0]:chunks[j - 1][1]] if j > k else b""
            if j > k and len(run) < min_bytes and len([w for w in __import__("re").split(rb"[\x00-\x20]+", run) if w]) < min_words:
                kept += run
            if j < len(chunks):
                kept += data[chunks[j][0]:chunks[j][1]]
            k = j + 1
        out[i, text] = None if text is None else kept.decode()
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijé", k=rng.randint(1, 9))) for _ in range(n))


def cleaned(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_gear_hash_and_chunks_match_the_rolling_definition():
    rng = random.Random(1)
    texts = [words(rng, 200), "", "ab", "é" * 3000, words(rng, 40) + "x" * 1000 + words(rng, 30)]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        if len(data):
            assert D.gear_hash(data)[15:].tolist() == slow_gear(t.encode())[15:]
    table = pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": texts})
    c = D.Chunks(table, 2, 256)
    got = {}
    for s, e, d in zip(c.starts.tolist(), c.ends.tolist(), c.doc.tolist()):
        got.setdefault(d, []).append((s - int(c.offsets[d]), e - int(c.offsets[d])))
    assert [got.get(d, []) for d in range(5)] == [slow_chunks(t) for t in texts]


def test_matches_brute_force_on_the_documents(spark):
    from retentio.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = slow_dedup(rows)
    assert cleaned(QUERIES["op1_substring_dedup"](spark, SF)) == sorted(((i, want[i, t]) for i, t in rows), key=str)


def test_many_blocks_and_odd_rows(spark, docs):
    rng = random.Random(2)
    passage, line = words(rng, 60), words(rng, 7)
    rows = [(i, f"{words(rng, rng.randint(0, 50))} {passage if i % 3 == 0 else ''} {line} {words(rng, 30)}") for i in range(40)]
    rows += [(90, None), (91, ""), (92, rows[4][1]), (93, "z" * 5000), (94, "z" * 5000), (None, rows[6][1]), (None, None),
             (7, rows[8][1]), (5, rows[5][1]), (95, words(rng, 20_000))]
    want = slow_dedup(rows)
    df = docs(rows).selectExpr("doc_id", "text", "1 as block", "2 as bucket", "3 as removed", "4 as answer")
    for size in (1 << 20, 3000):
        got = D.dedup_substrings(df, block_bytes=size)
        assert cleaned(got) == sorted(((i, want[i, t]) for i, t in rows), key=str)


def test_planted_passages_go_and_clean_documents_stay(spark, docs):
    rng = random.Random(4)
    passages = [words(rng, 55) for _ in range(30)]
    rows, clean = [], {}
    for i in range(120):
        body = words(rng, 150).split()
        if i % 2:
            clean[i] = " ".join(body)
            rows.append((i, clean[i]))
        else:
            rows.append((i, " ".join([*body[:70], passages[(i // 2) % 30], *body[70:]])))
    got = {r.doc_id: r for r in D.dedup_substrings(docs(rows), keep=("lang", "source")).collect()}
    assert all(got[i].text == t and got[i].removed_bytes == 0 and got[i].lang == "en" for i, t in clean.items())
    assert all(got[2 * p].removed_bytes == 0 for p in range(30))
    lost = [len(passages[p]) - got[60 + 2 * p].removed_bytes for p in range(30)]
    assert all(0 <= got[60 + 2 * p].removed_bytes for p in range(30)) and sum(x < len(passages[0]) * 0.7 for x in lost) >= 29
    for i, text in rows:
        data = text.encode()
        kept = data
        for r in reversed(got[i].removed):
            kept = kept[:r.start] + kept[r.end:]
        assert kept.decode() == got[i].text


def test_insertion_moves_only_nearby_chunks():
    rng = random.Random(6)
    text = words(rng, 2000)
    cut = len(text) // 2
    a = {text.encode()[s:e] for s, e in slow_chunks(text)}
    other = text[:cut] + " inserted words here " + text[cut:]
    b = {other.encode()[s:e] for s, e in slow_chunks(other)}
    assert len(a - b) <= 6


def test_empty_table(spark, docs):
    assert D.dedup_substrings(docs([])).collect() == []


def cjk(rng, n):
    return "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))


def spans(texts):
    c = D.Chunks(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), 2, 256)
    got = [[] for _ in texts]
    for s, e, d in zip(c.starts.tolist(), c.ends.tolist(), c.doc.tolist()):
        got[d].append((s - int(c.offsets[d]), e - int(c.offsets[d])))
    return got


def test_cuts_of_stretches_match_the_rolling_definition():
    rng = random.Random(7)
    base64 = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=4000))
    texts = [cjk(rng, 1500), base64, words(rng, 50) + " " + cjk(rng, 300) + "\u3000" + cjk(rng, 300) + " " + words(rng, 50), "é" * 2000, "z" * 3000, cjk(rng, 40) + "y" * 63]
    for t, got in zip(texts, spans(texts)):
        data, h = t.encode(), slow_gear(t.encode())
        low = [i + 1 < len(data) and h[i] < 1 << 12 and data[i + 1] & 0xC0 != 0x80 for i in range(len(data))]
        cuts = [0]
        for i in range(15, len(data) - 1):
            space = data[i] <= 32 and h[i] < 1 << 14
            inside = i >= 63 and low[i] and not any(low[i - 16:i]) and all(b > 32 for b in data[i - 63:i + 1])
            if space or inside:
                cuts.append(i + 1)
        assert [s for s, _ in got if s in cuts] == cuts
        for s, e in got:
            assert s in cuts or (s - max(c for c in cuts if c <= s)) >= 256  # a last resort
            assert e - s <= 256 + 3 and "".join([data[s:e].decode()])
    assert len(spans(texts)[3]) <= 4000 // 256 + 1 and len(spans(texts)[4]) <= 3000 // 256 + 1


def test_insertion_in_front_of_text_without_spaces_moves_only_nearby_chunks():
    rng = random.Random(8)
    base64 = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=6000))
    for text in (cjk(rng, 2000), base64):
        for front in ("x", "漢", "漢字" * 30 + "q"):
            a, b = ({t.encode()[s:e] for s, e in got} for t, got in zip((text, front + text), spans([text, front + text])))
            assert len(a) > 60 and len(a - b) <= 4


def test_passage_without_spaces_goes_at_any_offset(spark, docs):
    rng = random.Random(9)
    passage, bodies = cjk(rng, 600), [cjk(rng, n) for n in (100, 137, 301, 555)]
    rows = [(i, b + passage + cjk(rng, 90 + 31 * i)) for i, b in enumerate(bodies)]
    rows += [(8, "x" + rows[2][1])]
    got = {r.doc_id: r for r in D.dedup_substrings(docs(rows)).collect()}
    assert got[0].removed_bytes == 0
    for i in (1, 2, 3):
        assert 0.6 * 1800 <= got[i].removed_bytes <= 1800 and bodies[i] in got[i].text
    assert got[8].removed_bytes >= 0.9 * len(rows[4][1].encode())
