import random
import zlib

import numpy as np
import pytest

from retentio.llm import langid as L

SF = "/root/testdata/sf0.01"


def slow_bundle(letters, text):
    """Rotate, multiply and add one n-gram at a time."""
    total = np.zeros(letters.dim)
    word = []
    for ch in [*text.lower(), " "]:
        if ch.isalpha():
            word.append(ord(ch))
            continue
        if word:
            seq = [0, *word, 0]
            for a, b, c in zip(seq, seq[1:], seq[2:]):
                va, vb, vc = (letters.vectors(np.array([p]))[0].astype(int) for p in (a, b, c))
                total += np.roll(va, 2) * np.roll(vb, 1) * vc
        word = []
    return total


def test_bundles_match_the_definition():
    letters = L.Letters(64)
    texts = ["Hello, wörld! a-b", "", None, "12 34", "Ünïcode ЖЖ 漢字 straße", "x", "aaaa aaaa"]
    got = letters.bundle(texts)
    for g, t in zip(got, texts):
        assert g.tolist() == slow_bundle(letters, t or "").tolist()


def test_held_out_accuracy_and_rows(spark):
    from retentio.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_prediction_is_the_nearest_prototype_of_the_training_texts(spark, docs):
    rng = random.Random(1)
    make = {"aa": "abcd", "bb": "cdef", "cc": "ghij"}
    rows = [(i, " ".join("".join(rng.choices(make[k], k=4)) for _ in range(rng.randint(1, 30))), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    df = docs(rows)
    letters = L.Letters(256)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    protos = {}
    for k in make:
        v = [slow_bundle(letters, t) for _, t, x in train if x == k]
        p = sum(x / np.linalg.norm(x) for x in v)
        protos[k] = p / np.linalg.norm(p)
    fitted = L.fit_prototypes(df, dim=256)
    for k in make:
        assert fitted[k] == pytest.approx(protos[k], abs=1e-5)
    for r in L.identify(df, fitted, dim=256).collect():
        v = slow_bundle(letters, r.text)
        cos = {k: v @ p / np.linalg.norm(v) for k, p in protos.items()}
        assert r.lang_pred == max(cos, key=cos.get) and r.score == pytest.approx(max(cos.values()), abs=1e-5)


def test_odd_rows_and_clashing_columns(spark, docs):
    rows = [(1, "der die das und"), (2, None), (3, ""), (4, "123 ?!"), (None, "the of and"), (None, None), (5, "the of and", None), (5, "the of and", None),
            (6, "the of " * 50_000), (7, "der die das", "de"), (8, "漢字")]
    df = docs(rows).selectExpr("*", "'x' as row", "'y' as score", "0 as lang_pred", "1 as `a.b`")
    got = L.identify(df, L.fit_prototypes(df)).collect()
    assert len(got) == len(rows) and got[0].row == "x" and got[0]["a.b"] == 1
    by = {(r.doc_id, r.text): r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in [(2, None), (3, ""), (4, "123 ?!"), (None, None)])
    assert all(r.lang_pred in ("en", "de") for r in got if r.text and any(c.isalpha() for c in r.text))


def test_nothing_learned_and_empty(spark, docs):
    df = docs([(1, "some text", None)])
    assert [(r.lang_pred, r.score) for r in L.identify_held_out(df).collect()] == [("und", 0.0)]
    assert L.identify_held_out(docs([])).collect() == []


def test_training_sample_is_bounded(spark, docs):
    df = docs([(i, f"word{chr(97 + i % 26)}", "en") for i in range(400)])
    assert set(L.fit_prototypes(df, rows=10)) == {"en"}
