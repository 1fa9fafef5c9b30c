import math
import random
import zlib

import numpy as np
import pytest

from retentio.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def slow_bag(text):
    out = set()
    data = (text or "").lower().encode()
    for word in "".join(chr(b) if b >= 128 or chr(b).isalnum() else " " for b in data).split(" "):
        if word:
            w = b" " + word.encode("latin-1") + b" "
            for n in T.SIZES:
                for i in range(len(w) - n + 1):
                    code = int.from_bytes(w[i:i + n], "big")
                    out.add(((code + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - T.BUCKET_BITS))
    return out


def test_bags_match_the_definition(monkeypatch):
    texts = ["Hello, wörld!", "", None, "a", "x-y  z", "ÄÖ ß 漢字", "?!", "word " * 500, "z" * 900]
    want = [slow_bag(t) for t in texts]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(T, "PIECE", piece)
        doc, bag = T.buckets(texts)
        assert [set(bag[doc == i].tolist()) for i in range(len(texts))] == want


def test_score_is_the_softmax_of_the_averaged_embeddings():
    rng = np.random.default_rng(0)
    number, bias = rng.normal(0, 50, 1 << T.BUCKET_BITS), -0.3
    for text, s in zip(["some words here", "", "one"], T.scores(["some words here", "", "one"], number, bias)):
        bag = sorted(slow_bag(text))
        z = bias + (np.mean(number[bag]) if bag else 0)
        assert s == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_learns_words_and_their_misspellings():
    rng = random.Random(0)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(800)]
    bad = ["horridfool", "nastyperson"]
    texts, labels = [], []
    for i in range(1000):
        t = rng.choices(words, k=60)
        if i % 2:
            t[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(t))
        labels.append(i % 2)
    model = T.train(texts, np.array(labels))
    fresh = [" ".join(rng.choices(words, k=60)) for _ in range(100)]
    assert np.mean(T.scores(fresh, *model) < 0.5) > 0.9
    assert np.mean(T.scores([f + " horidfool" for f in fresh], *model) >= 0.5) > 0.7  # not among the training words


def auc(pairs):
    s = sorted(pairs)
    pos = [i for i, (_, y) in enumerate(s) if y]
    return (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(s) - len(pos)))


def test_held_out_quality_on_the_documents(spark):
    from retentio.llm.queries import QUERIES

    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert auc(held) > 0.85  # about two fifths of the toxic texts of this table hold no insult
    assert sum(s < 0.5 for s, y in held if not y) > 0.95 * sum(not y for _, y in held)


def test_odd_rows(spark, docs):
    rows = [(i, f"fine words number {i}") for i in range(1, 30)] + [(i, f"you awful creature {i}") for i in range(30, 60)]
    rows += [(100, None), (101, ""), (102, "?!"), (None, "awful"), (3, rows[2][1]), (103, "awful " * 60_000)]
    df = docs(rows).selectExpr("doc_id", "text", "1 as score", "2 as label", "3 as id", "4 as toxic")
    labels = spark.createDataFrame([(i, int(i >= 30), "x") for i in range(1, 60)] + [(3, 0, "x"), (None, 1, "x"), (5, None, "x"), (999, 1, "x")], "doc_id long, toxic int, text string")
    got = T.score_held_out(df, labels).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[100].score == by[101].score == by[102].score
    assert by[None].held_out is True and by[103].score > by[7].score


def test_nothing_to_learn_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in T.score_held_out(docs([(1, "text")]), none).collect()] == [(0.5, 1)]
    assert T.score_held_out(docs([]), none).collect() == []
