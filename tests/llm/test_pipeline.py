import random
import zlib

import sentencepiece
from test_decontam import slow as slow_decontam
from test_simhash import slow_classes
from test_substring_dedup import slow_dedup

import corpus_pipeline as P
from retentio.llm import langid
from retentio.llm.piece_fst import MODEL

SF = "/root/testdata/sf0.01"


def slow_run(rows, items):
    """(doc_id, text) of the documents left before the last stage, by brute force; ids are distinct."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    first = {d for d, _, c in slow_classes(rows) if d == c}
    rows = [(i, t) for i, t in rows if i in first]
    cut = slow_dedup(rows)
    rows = [(i, cut[i, t]) for i, t in rows if cut[i, t] == t or cut[i, t].split()]
    return {i: t for i, t in rows if not slow_decontam(t, items)[2]}


def test_run_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = slow_run(rows, items)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: list(r.ids) for r in P.run(spark, SF).collect()}
    assert got == {i: library.encode(t) for i, t in want.items()}


def odd(docs, tmp_path, spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    item, body = make(30), make(300)
    rows = [(1, body), (2, body), (3, None), (4, ""), (5, "12 34"), (6, make(100) + " " + item + " " + make(50)), (7, make(60)), (None, make(40)), (7, make(60)), (8, make(30_000))]
    rows += [(9, rows[6][1]), (10, make(80), None)]
    spark.createDataFrame([(1, item), (None, make(5)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs(rows).selectExpr("*", "1 as block", "2 as fp", "3 as lang_pred", "4 as `row`"), rows


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark, docs, tmp_path):
    df, rows = odd(docs, tmp_path, spark)
    for name, stage in P.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == list(P.COLUMNS), name
    kept = sorted((str(r.doc_id) for r in df.collect()))
    assert kept == sorted(["1", "7", "7", "None", "8", "10"])


def test_every_stage_takes_an_empty_table(spark, docs, tmp_path):
    df, _ = odd(docs, tmp_path, spark)
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in P.language_id(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert langid.UNKNOWN == "und"


def test_language_stage_keeps_documents_where_no_language_was_learned(spark, docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    texts = ["some clean text", "漢字", "12 34", "", None, "x 1"]
    for lang in (None, "en"):  # no label, or one that is held out
        df = docs([(1000 + i, t, None) for i, t in enumerate(texts)] + [(held, "a held-out text", lang)])
        assert langid.fit_prototypes(df) == {}
        assert sorted(r.doc_id for r in P.language_id(spark, df, SF).collect()) == sorted([held, 1000, 1001, 1005])
        found = {r.doc_id: r.lang_pred for r in langid.identify(df, {}, unlearned=langid.UNLEARNED).collect()}
        assert (found[1000], found[1002], found[1004]) == ("mis", "und", "und")
