import random

import numpy as np
import pytest
import sentencepiece

from retentio.llm import piece_fst as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def fst():
    with open(P.MODEL, "rb") as f:
        return P.compile_model(f.read())


def odd_texts():
    rng = random.Random(0)
    parts = [*"abcdeth  ▁\n\r\t.,;)éñ日語😀ingonr=-*/", "the", "in", " th", "ing", ");\r"]
    return ["", " ", "  a  b ", "\n\t x", "日本語 テスト", "aaaaaaaaaaaaaaaaaaaaa", "x" * 500, " ▁ a▁b", "\x00\x01a", "<0x0A> <s> </s> <unk>", "é ﬁ ½",
            *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500))]


def test_same_ids_and_texts_as_the_library(fst, library):
    for t in odd_texts():
        ids = fst.encode(t)
        assert ids.tolist() == library.encode(t)
        assert fst.decode(ids) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(fst, library):
    rng = random.Random(1)
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.7 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert fst.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_whole_inputs_and_cut_inputs_have_the_same_path(fst):
    for t in odd_texts()[:300]:
        assert fst._ids(fst.shortest_path(fst.normalise(t))) == fst.encode(t).tolist()


def test_unigram_paths_are_the_cheapest_of_all_segmentations():
    rng = random.Random(2)
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("▁", -2.0, 1)] + [(p, -rng.uniform(1, 6), 1) for p in ["a", "b", "ab", "ba", "aba", "▁a", "bb", "abb"]]
    fst = P.PieceTransducer(pieces, P.UNIGRAM)
    cost = {p: -s for p, s, t in pieces if t == 1}

    def best(text):
        if not text:
            return 0.0, []
        return min((cost[text[:n]] + best(text[n:])[0], [text[:n], *best(text[n:])[1]]) for n in range(1, 4) if text[:n] in cost)
    for _ in range(200):
        t = "▁" + "".join(rng.choices("ab", k=rng.randint(1, 9)))
        path = fst.shortest_path(t)
        assert "".join(path) == t and sum(cost[p] for p in path) == pytest.approx(best(t)[0])
    assert fst.encode("azzb").tolist()[1:] == [0, fst.ids["b"]]  # unknown neighbours count once


def test_query_and_round_trip_over_the_documents(spark, library):
    from retentio.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_sentencepiece"](spark, SF)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(list(r.ids) == library.encode(docs[r.doc_id]) and r.restored and r.n_ids == len(r.ids) for r in rows)
    assert {r.doc_id: r.text for r in P.decode(got).collect()} == docs


def test_odd_rows(spark, docs, library):
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "same"), (4, "same"), (5, "word " * 50_000), (6, "z" * 100_000), (7, "😀")]
    df = docs(rows).selectExpr("doc_id", "text", "1 as ids", "2 as restored")
    got = sorted(P.encode(df).collect(), key=str)
    want = sorted(((i, None if t is None else library.encode(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert all((r.n_ids is None) == (r.ids is None) and (r.restored or r.ids is None) for r in got)
    back = sorted(((r.doc_id, r.text) for r in P.decode(P.encode(df)).collect()), key=str)
    assert back == sorted(rows, key=str)
    assert P.encode(df.limit(0)).collect() == []
