import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from retentio.llm import backoff_lm as B

SF = "/root/testdata/sf0.01"


def slow(rows, mu=128.0):
    """(doc_id, held, n, known, N, base, score) with plain dictionaries and a loop over the states."""
    def tokens(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["</s>"]

    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    c, c2 = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = tokens(t)
            c.update(w)
            c2.update(zip(["<s>", *w], w))
    N, V, docs = sum(c.values()), len(c), c["</s>"]
    out = []
    for (i, t), h in zip(rows, held):
        state, base, score, w = "<s>", 0.0, 0.0, tokens(t)
        for x in w:
            p = (c[x] + 1) / (N + V + 1)
            n = docs if state == "<s>" else c[state]
            base += math.log10(p)
            if c2[state, x]:
                score += math.log10((c2[state, x] + mu * p) / (n + mu))
            else:
                score += math.log10(mu / (n + mu)) + math.log10(p)
            state = x
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), N, base, score))
    return out


def same(df, rows):
    got = sorted(map(tuple, df.collect()), key=str)
    want = sorted(slow(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_matches_brute_force_on_the_documents(spark):
    from retentio.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(QUERIES["op9_backoff_lm"](spark, SF), rows)


def test_many_blocks_and_odd_rows(spark, docs):
    rng = random.Random(1)
    vocabulary = ["the", "The", "a", "é", "É", "x y"] + ["".join(rng.choices("abc", k=4)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "the a"), (None, None), (3, rows[3][1]), (3, "the other"), (103, "the " * 20_000)]
    df = docs(rows).selectExpr("doc_id", "text", "1 as block", "2 as held_out", "3 as score")
    for size in (1 << 20, 2000):
        same(B.score_documents(df, block_bytes=size), rows)


def test_empty_and_only_held_out(spark, docs):
    assert B.score_documents(docs([])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    same(B.score_documents(docs([(held, "a b")])), [(held, "a b")])


def test_probabilities_after_a_state_sum_to_one():
    """Over the known words, the end token and one unknown word, from every state."""
    k = B.Tokens(pa.table({"text": ["a b c a b a a", "b b c", "zz"]}))
    wn = np.bincount(k.tokens[:12], minlength=len(k.digests))
    bn = np.bincount(k.pair[:12], minlength=len(k.pairs))
    last = np.empty(len(k.pairs), np.int64)
    last[k.pair] = np.arange(len(k.pair))
    history = wn.copy()
    history[k.start], history[k.end] = wn[k.end], 0
    m = B.BackoffAutomaton(wn, bn, k.history[last], k.tokens[last], history, 12, int((wn > 0).sum()), 8.0)
    words = [i for i in range(len(wn)) if i != k.start]  # holds one unknown word, zz
    arcs = {(int(k.history[i]), int(k.tokens[i])): p for p, i in enumerate(last.tolist()) if bn[p]}
    for state in {s for s, _ in arcs}:
        total = sum(10 ** (m.arc[arcs[state, w]] if (state, w) in arcs else m.failure[state] + m.root[w]) for w in words)
        assert total == pytest.approx(1.0)


def test_beats_the_base_on_held_out_texts(spark):
    from retentio.llm.queries import QUERIES

    rows = [r for r in QUERIES["op9_backoff_lm"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
