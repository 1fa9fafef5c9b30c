import random
from itertools import combinations

import numpy as np
import xxhash

from retentio.llm import simhash as S

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(rows, radius=3):
    """(doc_id, hex, component) by comparing all pairs of distinct fingerprints."""
    fps = [slow_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for (i, _), f in zip(rows, fps):
        r = root(f)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(rows, fps)), key=str)


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_matches_brute_force_on_the_documents(spark):
    from retentio.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op10_simhash"](spark, SF)) == slow_classes(rows)


def test_spark_hash_is_the_same_function(spark):
    assert spark.sql("select xxhash64('ab cd ef') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"ab cd ef", 42)


def test_odd_rows(spark, docs):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    long = " ".join(rng.choices(words, k=30_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One  two\tthree"), (2, "one two three"), (2, "one two three"), (7, "one"),
            (None, "one two three"), (None, "quite other words here"), (11, long), (10, long + " more"), (12, "É é ß  x y"), (13, "x" * 200_000)]
    df = docs(rows).selectExpr("doc_id", "text", "1 as fp", "2 as block", "3 as component_id", "4 as label")
    assert result(S.near_duplicates(df)) == slow_classes(rows)


def test_empty_table(spark, docs):
    assert S.near_duplicates(docs([])).collect() == []


def test_links_for_every_number_of_parts_and_small_buckets(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            f = c
            for b in rng.choice(20, rng.integers(0, 5), replace=False).tolist():
                f ^= 1 << (b * 3)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    want = slow_components(fps, 3)
    monkeypatch.setattr(S, "BUCKET", 16)
    for m in (2, 3, 4):
        got = S.near_links(df, 3, m).collect()
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in got)
        assert union(fps, [(r.a % 2**64, r.b % 2**64) for r in got]) == want


def slow_components(fps, radius):
    return union(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= radius])


def union(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    cost = rng.random((50, 4, 5))
    e = S.allocate(cost, 3)
    assert (e.sum(axis=1) == 4).all()
    for r in range(50):
        best = min(sum(cost[r, i, x[i]] for i in range(4)) for x in np.ndindex(5, 5, 5, 5) if sum(x) == 4)
        assert abs(sum(cost[r, i, e[r, i]] for i in range(4)) - best) < 1e-9


def test_shells_count_exact_distances():
    rng = np.random.default_rng(2)
    counts = np.zeros(1 << 16)
    at = rng.integers(0, 1 << 16, 500)
    np.add.at(counts, at, 1)
    s = S.shells(counts, 3)
    for v in rng.integers(0, 1 << 16, 20):
        d = np.bitwise_count(at ^ v)
        assert [round(x) for x in s[:, v]] == [(d == r).sum() for r in range(4)]


def test_one_document_of_each_class_stays(spark, docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    base = rng.choices(words, k=800)
    near = base[:400] + ["changed"] + base[400:]
    rows = [(4, " ".join(base)), (2, " ".join(near)), (2, " ".join(near)), (9, "other words here"), (None, "other words here"),
            (None, "alone with no id"), (None, "alone with no id"), (7, None), (8, "")]
    linked = (S.fingerprint(rows[0][1].encode()) ^ S.fingerprint(rows[1][1].encode())).bit_count() <= 3
    kept = sorted((r.doc_id or 0, r.text) for r in S.first_of_each_class(docs(rows)).collect())
    assert kept == sorted([(2, rows[1][1]), (9, rows[3][1]), (0, rows[5][1]), (7, None)] + ([] if linked else [(4, rows[0][1])]), key=lambda r: r[0])
