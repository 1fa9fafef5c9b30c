import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retentio.llm import token_files as T
from retentio.llm.queries import op11_token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "a ", "a  b", "x\n y", "x \ny", "x\ny z", "　 a b", "it's me's 's", "a b c 's", "ñ é 中文 字 字  ", "<|endoftext|> b <|endoftext|>",
       "\x85 a \x85", "Ġ Ġa Ġ", None, "tab\t x", "​ a ​ b", "a \x1c b \x1cc d", "\x00 \x00", "word " * 3000, "中" * 5000, "x" * 200 + " " + "x" * 200]


def slow_tokens(name=BYTES):
    t = Tokenizer.from_file(name)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTES, public_tokenizers.path("word_bpe_49k.json")])
def test_ids_equal_the_library(name):
    rng = random.Random(1)
    parts = ["a", "b ", " ", "'s", "\n", "é", "1", "!", "中", "　", " q", "  ", " word"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(30)) for _ in range(500)]
    ids, counts = T.Encoder(name, 2).encode(pa.array(texts, pa.string()))
    stop, tokens = np.cumsum(counts), slow_tokens(name)
    assert [ids[e - n : e].tolist() for e, n in zip(stop, counts)] == [[*tokens(t), 2] for t in texts]


def test_units_are_forgotten_without_a_change(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 7)
    encoder, tokens, rng = T.Encoder(BYTES, None), slow_tokens(), random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice(["red", "green", "y" * 90, "blue", "tree", "w%d" % rng.randrange(40)]) for _ in range(rng.randrange(1, 9))) for _ in range(4)]
        ids, counts = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in tokens(t)] and counts.sum() == len(ids)


def test_generations_hold_no_more_than_they_may(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 40)
    encoder, tokens = T.Encoder(BYTES, None), slow_tokens()
    for k in range(6):  # one batch has more distinct units than a generation holds, the others fill it
        texts = [" ".join(f"w{k}x{i}" for i in range(300 if k == 2 else 9)), "red green"]
        assert encoder.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in tokens(t)]
        assert len(encoder.known) <= 20 and len(encoder.older) <= 20


def test_words_go_to_the_model_whatever_stands_before_them(monkeypatch):
    encoder, tokens, asked = T.Encoder(BYTES, 2), slow_tokens(), []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda units: asked.extend(units) or whole(units))
    texts = ["Thesen anen, heon.\nOuher Straße\nété 12", "", None, "one\x01 two", "Ouher"]
    ids, counts = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in (*tokens(t), 2)] and counts.tolist() == [len(tokens(t)) + 1 for t in texts]
    assert sorted(asked) == ["\n", " 12", ",", ".", "one\x01"]  # neither words nor, with U+0001 among them, whole texts
    asked.clear()
    assert encoder.encode(pa.array(texts))[0].tolist() == ids.tolist() and not asked


def test_empty_texts_alone():
    ids, counts = T.Encoder(BYTES, 2).encode(pa.array(["", None], pa.string()))
    assert ids.tolist() == [2, 2] and counts.tolist() == [1, 1]


def test_texts_are_cut_beside_single_blanks_only():
    rng, tokens = random.Random(5), slow_tokens()
    blanks = [" ", "\n", "\t", "\r", "\x0b", *T.WIDE_BLANKS]
    others = ["a", "É", "中", "😀", "\x01", "\x1c", "\u2010", "\u3001", "Ā", ".", "'s", "7", "\u0301"]
    assert all(b.isspace() for b in blanks) and T.KIND[0x1C] == 0
    texts = ["".join(rng.choice(blanks if rng.random() < 0.4 else others) for _ in range(rng.randrange(12))) for _ in range(3000)]
    data = "".join(texts).encode()
    places = np.flatnonzero(T.cut_places(np.frombuffer(data, "u1")))
    white = "".join(blanks) + "\x0c"
    for a in places.tolist():
        left, right = data[:a].decode(), data[a:].decode()
        assert ((left[-1] not in white and right[0] in " \n") or (left[-1] == "\n" and left[-2] not in white and right[0] not in white)
                or (left[-1] in "as" and right[0] == "."))
    spaces = [len("".join(x).encode()) for x in ("".join(texts)[:i] for i in range(1, 3000)) if x[-1] not in white and "".join(texts)[len(x)] in " \n"]
    assert set(spaces) <= set(places.tolist())
    ids, counts = T.Encoder(BYTES, None).encode(pa.array(texts).slice(7))
    stop = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(stop, counts)] == [tokens(t) for t in texts[7:]]


def test_freed_memory_goes_back_with_each_section(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    given = []
    monkeypatch.setattr(T, "TaskContext", Task)
    monkeypatch.setattr(T, "release_freed", lambda: given.append(1), raising=False)
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "text": pa.array(["one two three"] * 6)})
    assert len(list(T._sections(BYTES, 2, 8, iter([b])))) == len(given) == 3


@pytest.mark.parametrize("top", [1, 200, 300, 70_000, 1 << 25, (1 << 32) - 1])
def test_numbers_round_trip(top):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = np.minimum(rng.integers(0, top, n, endpoint=True) >> rng.integers(0, 30, n), top).astype(np.uint32)
        control, data = T.pack(values)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
        assert T.unpack(np.frombuffer(control, "u1"), np.frombuffer(data, "u1"), n).tolist() == values.tolist()


def test_ranks_follow_frequency():
    ids = np.array([9, 9, 9, 4, 4, 7, 7, 1 << 30, 5], np.uint32)
    for some in (ids, ids[ids < 100]):
        ranks, coded = T.rank_ids(some)
        assert ranks.tolist()[:4] == [9, 4, 7, 5] and ranks[coded].tolist() == some.tolist()


def test_files_round_trip_in_ascending_order(spark, docs, tmp):
    rows = [(i % 40 - 5, t) for i, t in enumerate(ODD * 4)] + [(7, "same text")] * 30 + [(None, "no id"), (None, None)]
    random.Random(4).shuffle(rows)
    df = docs(rows).withColumnRenamed("source", "section").withColumnRenamed("n_chars", "shard").repartition(5)
    path = os.path.join(tmp, "files")
    T.write_token_files(df, path, BYTES, end_id=2, section_tokens=500, shard_bytes=4000)
    got = sorted(T.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    tokens = slow_tokens()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(((i, [*tokens(t), 2]) for i, t in rows), key=str)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    order = [-100 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"]) for r in got)
    bare = T.read_token_files(spark, path, with_ids=False).collect()
    assert sorted((r["start"], r["ids_crc32"]) for r in bare) == sorted((r["start"], r["ids_crc32"]) for r in got) and not any(r["ids"] for r in bare)


def test_one_hot_id_is_spread_over_shards(spark, docs, tmp):
    path = os.path.join(tmp, "files")
    T.write_token_files(docs([(3, "the same text again and again")] * 400), path, BYTES, shard_bytes=1000)
    shards = [h["shard"] for f in os.listdir(path) if f.endswith(".txt") for h in T.heads_of(open(os.path.join(path, f), "rb").read())]
    assert len(set(shards)) > 4


def test_empty_table_and_bad_file(spark, docs, tmp):
    path = os.path.join(tmp, "files")
    T.write_token_files(docs([]), path, BYTES, end_id=2)
    assert T.read_token_files(spark, path).count() == 0
    whole = T.section_bytes(0, 0, 0, [1], np.array([3]), np.array([1, 2, 2], "<u4")) + T.MARKER.encode()
    assert [s[1] for s in T.sections_of(whole)] == [[1]]
    for bad in (whole[:-1], b"x" + whole):
        with pytest.raises(ValueError):
            list(T.sections_of(bad))


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    tokens, at, want = slow_tokens(), 0, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tokens(r["text"]), 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = op11_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
