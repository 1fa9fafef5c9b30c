import random
import re

from retentio.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def slow(text, items, window=10):
    """(n_words, found item ids, hit word numbers, character spans of hit words)."""
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low(text))]
    words = [w for w, _, _ in found]
    hit, ids = set(), set()
    for item, t in items:
        iw = WORD.findall(low(t))
        if not iw:
            continue
        n = min(len(iw), window)
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit.update(range(i, i + n))
                ids |= {item} - {None}
    return len(words), sorted(ids), hit, [found[i][1:] for i in sorted(hit)]


def check(got, rows, items):
    got = sorted(((r.doc_id, r.n_words, r["items"], r.spans) for r in got.collect()), key=str)
    want = sorted(((i, *slow(t, items), t) for i, t in rows), key=lambda r: str((r[0], r[1])))
    got = sorted(got, key=lambda r: str((r[0], r[1])))
    assert [g[:3] for g in got] == [tuple(w[:3]) for w in want]
    for g, w in zip(got, want):
        assert {k for s in g[3] for k in range(s.first_word, s.end_word)} == w[3]
        inside = [c for c in w[4] if any(s.start <= c[0] and c[1] <= s.end for s in g[3])]
        assert inside == w[4]
        for s in g[3]:  # spans start and end with a hit word
            assert s.start in {a for a, _ in w[4]} and s.end in {b for _, b in w[4]}


def make(spark, docs):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(1, 3))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(2, 14)]
    items += [(20, None), (21, ""), (22, "?!"), (None, "a b c"), (30, items[3][1]), (5, "Zwölf Ärzte, 3x"), (5, "other text of item five")]
    rows = []
    for i in range(40):
        body = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 2:
            body[5:5] = [w.title() for w in rng.choice(items[:12])[1].split()] * rng.randint(1, 2)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    rows += [(90, None), (91, ""), (92, "…—"), (None, items[4][1]), (95, "x a b c y"), (3, rows[3][1]), (3, "zwölf ärzte 3X"), (93, "Zwölf Ärzte 3x"), (94, "ab " * 30_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs(rows).selectExpr("doc_id", "text", "1 as items", "2 as spans", "3 as hash"), rows, bench, items


def test_matches_brute_force(spark, docs):
    df, rows, bench, items = make(spark, docs)
    check(D.find_benchmark(df, bench), rows, items)


def test_several_automata_find_the_same(spark, docs):
    df, rows, bench, items = make(spark, docs)
    check(D.find_benchmark(df, bench, automaton_bytes=2000), rows, items)


def test_empty_tables(spark, docs):
    df, rows, bench, _ = make(spark, docs)
    assert D.find_benchmark(df.limit(0), bench).collect() == []
    check(D.find_benchmark(df, bench.limit(0)), rows, [])


def test_item_without_an_id_is_found_and_rejects(spark, docs):
    bench = spark.createDataFrame([(None, "one two three"), (4, "four five")], "item_id long, text string")
    df = docs([(1, "zero One, two three four"), (2, "four five"), (3, "clean"), (4, None)])
    got = {r.doc_id: (r["items"], [(s.first_word, s.end_word) for s in r.spans]) for r in D.find_benchmark(df, bench).collect()}
    assert got == {1: ([], [(1, 4)]), 2: ([4], [(0, 2)]), 3: ([], []), 4: ([], [])}
    assert sorted(r.doc_id for r in D.without_benchmark(df, bench).collect()) == [3, 4]
