import numpy as np
import pyarrow as pa

from retentio.llm import piece_fst
from retentio.llm.common import slices


def test_full_generations_keep_only_words_asked_for_again(monkeypatch):
    with open(piece_fst.MODEL, "rb") as f:
        data = f.read()
    whole, small = piece_fst.compile_model(data), piece_fst.compile_model(data)
    texts = [f"the cat sat on mat{i} and word{i * 7919} the dog" for i in range(60)]
    expected = [whole.encode(t).tolist() for t in texts]
    monkeypatch.setattr(piece_fst, "WORDS", 40)
    held = []
    for text, ids in zip(texts, expected, strict=True):
        assert small.encode(text).tolist() == ids
        held.append(len(small.paths))
    # a generation ends with the text that fills it, and no other one is kept beside it
    assert max(held) <= 40 + 2 * 9 and not hasattr(small.paths, "former")
    assert "▁the" in small.paths and sum(b < a for a, b in zip(held, held[1:])) > 1


def test_slices_keep_rows_in_batches_of_bounded_text():
    texts = ["a" * 6, None, "b" * 3, "", "c" * 40, "d", None, "ee"]
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(8), pa.int64()), "text": pa.array(texts)})
    got = list(slices(iter([b, b.slice(0, 0)]), "text", 10))
    assert [x for g in got for x in g.column("text").to_pylist()] == texts
    sizes = [sum(len(x or "") for x in g.column("text").to_pylist()) for g in got]
    assert all(s <= 10 or g.num_rows == 1 for s, g in zip(sizes, got)) and len(got) == 4
    assert np.all([g.schema == b.schema for g in got])
