import random
import zlib

import numpy as np
import pytest

from retentio.llm import periodic_runs as R


def slow(words, min_length=6, min_exponent=4):
    """Runs by their definition: for each period the maximal stretches, less those with a smaller period."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        s = 0
        while s < n - p:
            e = s
            while e < n - p and words[e] == words[e + p]:
                e += 1
            length = e - s + p
            if e > s and length >= max(min_length, min_exponent * p) and not any(a <= s and s + length <= a + m for a, m, q in found if q < p):
                found.append((s, length, p))
            s = max(e, s) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def fast(texts, *limits):
    names = {}
    ids = [names.setdefault(w, len(names)) for t in texts for w in t]
    return R.runs_of(np.array([len(t) for t in texts], np.int64), np.array(ids, np.int64), *limits)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts_of(rng, count=400):
    for _ in range(count):
        letters = "abcdefghijklmnop"[: rng.choice([1, 2, 3, 16])]
        words = [rng.choice(letters) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * rng.randrange(2, 9))[: rng.randrange(1, 40)]
        yield words


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (1, 2), (12, 3), (4, 5)])
def test_runs_equal_their_definition(limits):
    rng = random.Random(5)
    texts = [*texts_of(rng), [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, ["a", "b"] * 4, list("abcabcabcabcx") * 6, fibonacci(300), list("aab") * 70 + ["a"]]
    texts += [texts[1]] * 3  # copies of a text are found each on their own
    assert fast(texts, *limits) == [slow(t, *limits) for t in texts]


def test_texts_one_by_one_and_together_are_the_same():
    texts = list(texts_of(random.Random(6), 60))
    assert fast(texts) == [fast([t])[0] for t in texts]


def test_long_text_with_every_word_alike_takes_one_pass():
    assert fast([["a"] * 200_000])[0] == [(0, 200_000, 1)]
    unit = [str(i) for i in range(3000)]
    assert fast([unit * 30 + ["end"]])[0] == [(0, 90_000, 3000)]


def test_least_lcp_is_that_of_the_shortest_run():
    assert R.least_lcp(6, 4) == 5
    for length in range(1, 14):
        for exponent in range(2, 6):
            assert R.least_lcp(length, exponent) == min(max(length, exponent * p) - p for p in range(1, 30))


def test_collapsed_keeps_the_first_period_of_each_run():
    words = [w.encode() for w in "x a b a b a b a b y y y y y y z".split()]
    assert R.collapsed(words, [(1, 8, 2), (9, 6, 1)]) == b"x a b y z"
    assert R.collapsed(words, []) == b" ".join(words)


def test_operator_over_odd_documents(spark, docs):
    rows = [(1, "no no no\tno\nno no  yes"), (1, "no no no\tno\nno no  yes"), (None, "la la la la la la"), (2, None), (3, ""), (4, " \t "), (5, "é　é " * 6), (6, "w " * 30000)]
    df = docs(rows).withColumnRenamed("source", "runs").withColumnRenamed("lang", "collapsed")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in R.find_runs(df).collect()), key=str)
    want = [(1, 7, [(0, 6, 1)], "no yes")] * 2 + [(None, 6, [(0, 6, 1)], "la"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 6, [(0, 6, 1)], "é　é"), (6, 30000, [(0, 30000, 1)], "w")]
    assert got == sorted(want, key=str)
    assert R.find_runs(docs([])).count() == 0


def test_periodic_tails_follow_their_rule(spark, docs):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 23))) for i in range(-40, 200)] + [(None, "a b c"), (40, None)]
    got = sorted(map(tuple, R.with_periodic_tails(docs(rows)).collect()), key=str)
    want, changed = [], 0
    for i, t in rows:
        h = None if i is None else zlib.crc32(str(i).encode())
        ws = (t or "").split()
        if h is not None and h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t, changed = " ".join(ws[k if k < a else a + (k - a) % p] for k in range(n)), changed + 1
        want.append((i, t))
    assert got == sorted(want, key=str) and changed > 5
