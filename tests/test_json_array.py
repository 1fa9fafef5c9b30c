import json
import os
import random

import numpy as np
import pytest

from retentio.sources import json_array as J
from retentio.sources import tables as tb
from retentio.sources.history import HISTORY_SCHEMA, MetricsHistory


@pytest.fixture()
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(["", "plain", 'quote " here', "brace } and { here", "back\\slash", 'end\\"}', "é]Ж[", "line\nbreak", "\\\\", ","])
    if kind == 1:
        return rng.randrange(10**9)
    if kind == 2:
        return rng.random()
    if kind == 3:
        return rng.choice([True, False, None])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_marks_are_those_of_a_scan_byte_by_byte():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice('{}[]"\\a') for _ in range(rng.randrange(15)))
        quotes, slashes, want = 0, 0, []
        for i, c in enumerate(text):
            if c == '"' and slashes % 2 == 0:
                quotes += 1
            elif c in "{}[]":
                want.append((i, 1 if c in "{[" else -1, quotes % 2 == 1))
            slashes = slashes + 1 if c == "\\" else 0
        at, step, odd, turned = J.marks(np.frombuffer(text.encode(), "u1"))
        assert list(zip(at.tolist(), step.tolist(), odd.tolist())) == want and turned == (quotes % 2 == 1)


@pytest.mark.parametrize("size", [40, 1000, 100_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_at_every_split_size(spark, tmp, splits, size, indent):
    rng = random.Random(size)
    rows = [{"id": i} | {k: value(rng) for k in ("a", "b", "c")} for i in range(60)]
    path = _write(os.path.join(tmp, "a b", "x.json"), json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5))
    splits(size)
    got = [json.loads(r["record"]) for r in J.array_records(spark, path).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows
    if size == 40:
        assert J.split_starts(spark, path).count() > 50


def test_array_equals_the_one_task_reader(spark, tmp, splits):
    rng = random.Random(5)
    rows = [{"student_id": f"S{i}", "gpa": rng.choice([1, 2.5, None]), "year": i, "mixed": rng.choice([1, "x"]), "ok": i % 2 == 0,
             "tags": ["a}", "{b"][: i % 3], "more": {"x": i, "y": None if i % 2 else "z"}, "none": None} for i in range(200)]
    path = _write(os.path.join(tmp, "s.json"), json.dumps(rows))
    splits(500)
    df = tb.read_table(spark, path)
    want = spark.read.option("multiLine", True).json(path)
    assert df.schema == want.schema
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    assert df.rdd.getNumPartitions() > 5
    schema = "student_id string, year int, more struct<x: bigint>"
    assert sorted(map(str, tb.read_table(spark, path, schema).collect())) == sorted(map(str, spark.read.schema(schema).option("multiLine", True).json(path).collect()))


def test_record_longer_than_many_splits(spark, tmp, splits):
    note = "word } { [ ] , \\ \" " * 20_000
    path = _write(os.path.join(tmp, "big.json"), json.dumps([{"id": 1}, {"id": 2, "note": note}, {"id": 3, "note": "x"}, {"id": 4, "note": note}]))
    splits(1 << 15)
    got = {r["id"]: r["note"] for r in tb.read_table(spark, path).collect()}
    assert got == {1: None, 2: note, 3: "x", 4: note}


def test_empty_and_broken_arrays(spark, tmp):
    assert J.array_records(spark, _write(os.path.join(tmp, "e.json"), " [ ]\n")).count() == 0
    assert tb.read_table(spark, _write(os.path.join(tmp, "f.json"), "[]"), "a int").count() == 0
    for n, text in enumerate(['[{"a": 1}, {"a": 2', '[{"a": 1}', '[{"a": "x}]', '[{"a": 1}]]']):
        with pytest.raises(ValueError, match="no whole arrays"):
            J.array_records(spark, _write(os.path.join(tmp, f"b{n}.json"), text))


def test_directory_of_arrays_lines_and_a_document(spark, tmp):
    d = os.path.join(tmp, "all.json")
    _write(os.path.join(d, "a.json"), '\n [{"id": 1, "a": "x"},\n{"id": 2}]')
    _write(os.path.join(d, "b.json"), '[{"id": 3}]')
    _write(os.path.join(d, "c.json"), '{"id": 4}\n{"id": 5, "a": "y"}\n')
    _write(os.path.join(d, "d.json"), '{\n "id": 6,\n "a": "z"\n}\n')
    assert sorted((r["id"], r["a"]) for r in tb.read_table(spark, d).collect()) == [(1, "x"), (2, None), (3, None), (4, None), (5, "y"), (6, "z")]
    assert sorted(tb.json_kinds(spark, d).values()) == ["array", "array", "document", "lines"]


def test_metric_documents(spark, tmp, splits):
    docs = [{"timestamp": f"2024-01-01T00:00:{i:02d}.000001", "model_version": "m", "metrics": {"accuracy": i / 60, "matrix": [[1, 2], [3, 4]]},
             "dataset_info": {"size": i}} for i in range(60)]
    path = _write(os.path.join(tmp, "h.json"), "[" + ",\n".join(json.dumps(d, separators=(",", ":")) for d in docs) + "]")
    splits(300)
    got = MetricsHistory.read_documents(spark, path)
    want = spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).json(path)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
