import csv
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentio.sources import quoted_csv as Q
from retentio.sources import tables as tb


@pytest.fixture()
def splits(spark):
    """Reads in splits of a given size, however small the file."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def _cells(df):
    return sorted(tuple("" if x is None else x for x in r) for r in df.collect())


def _pandas(path, **args):
    return sorted(map(tuple, pd.read_csv(path, dtype=str, keep_default_na=False, **args).values.tolist()))


def test_state_after_a_line_is_that_of_a_reader():
    def slow(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state in ("start", "field", "closed") and c == ",":
                state = "start"
            elif state == "start":
                state = "quoted" if c == '"' else "field"
            elif state == "quoted":
                state = "closed" if c == '"' else state
            elif state == "closed":
                state = "quoted" if c == '"' else "field"
        return state == "quoted"

    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('"",a ') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert Q.inside_after(line.encode(), inside, b",") == slow(line, inside), (line, inside)


@pytest.mark.parametrize("size", [60, 500, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_pandas_at_every_split_size(spark, tmp, splits, size, end):
    rng = random.Random(size)
    text = lambda: "".join(rng.choice(["a", "é", '"', ",", "\n", ";", " ", "5\" pipe", "Ж"]) for _ in range(rng.randrange(9)))
    path = os.path.join(tmp, "a b", "q.csv")
    os.makedirs(os.path.dirname(path))
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL if size == 500 else csv.QUOTE_ALL)
        w.writerow(["student_id", "note, long", "more\nlines"])
        w.writerows([f"S{i}", text(), text()] for i in range(90))
    splits(size)
    df = tb.read_csv_auto(spark, path, infer_schema=False)
    assert df.columns == ["student_id", "note, long", "more\nlines"]
    assert _cells(df) == _pandas(path)
    if size == 60:
        assert Q.quote_states(spark, [path], ",").count() > 20
        assert Q.quote_states(spark, [path], ",").filter("starts").count() > 5


def test_one_field_over_many_splits_and_splits_without_quotes(spark, tmp, splits):
    note = ("a line, of a long note\n" * 50_000)[: 1 << 20]
    path = _write(os.path.join(tmp, "big.csv"), f'id,note\n1,"{note}"\n2,"x ""y"" z"\n3,plain\n4,"{note} end"\n')
    splits(1 << 16)
    df = tb.read_csv_auto(spark, path)
    assert df.rdd.getNumPartitions() > 10
    got = {r["id"]: r["note"] for r in df.collect()}
    assert got == {1: note, 2: 'x "y" z', 3: "plain", 4: note + " end"}


def test_long_quoted_field_on_one_line(spark, tmp):
    note = "word, " * 200_000
    path = _write(os.path.join(tmp, "one.csv"), f'id;note\n1;"{note}"\n2;"a;b"\n')
    assert {r["id"]: r["note"] for r in tb.read_table(spark, path).collect()} == {1: note, 2: "a;b"}


def test_doubled_quotes_and_stray_quotes(spark, tmp):
    path = _write(os.path.join(tmp, "d.csv"), 'id,note\n1,"He said ""hi"", ok"\n2,5" pipe\n3,"" \n4,a "b" c\n')
    assert _cells(tb.read_table(spark, path, "id string, note string"))[:2] == [("1", 'He said "hi", ok'), ("2", '5" pipe')]


def test_valid_rows_with_line_breaks_are_not_rejected(spark, tmp):
    path = _write(os.path.join(tmp, "st.csv"), 'student_id,note,dropout\nS1,"two\nlines",1\nS2,"a ""quote"", ok",0\n\nS3,,7\n')
    ok, bad = tb.read_students(spark, path)
    assert _cells(ok.select("student_id", "note", F.col("dropout").cast("string"))) == [("S1", "two\nlines", "1"), ("S2", 'a "quote", ok', "0")]
    assert _cells(bad.select("student_id", "reason")) == [("S3", "bad target")]


def test_types_are_inferred_over_all_records(spark, tmp):
    rows = "".join(f'{i},"a\nb",{i}.5,true,{i if i < 30 else 1 << 40},{"x" if i == 39 else i},\n' for i in range(40))
    df = tb.read_table(spark, _write(os.path.join(tmp, "t.csv"), "i,s,d,b,l,m,none\n" + rows))
    assert [t for _, t in df.dtypes] == ["int", "string", "double", "boolean", "bigint", "string", "string"]


def test_directory_of_spanning_and_plain_files_and_of_dialects(spark, tmp):
    d = os.path.join(tmp, "mixed.csv")
    _write(os.path.join(d, "a.csv"), 'id;note\n1;"да\nнет"\n2;"a;""b"""\n', "cp1251")
    _write(os.path.join(d, "b.csv"), 'id;note\n3;"Ж"\n', "cp1251")
    _write(os.path.join(d, "c.csv"), 'note,id\n"x\ny",4\nplain,5\n')
    _write(os.path.join(d, "d.csv"), 'id,note,more\n6,"x\n,\ny",z\n')
    got = _cells(tb.read_csv_auto(spark, d, infer_schema=False).select("id", "note", "more"))
    assert got == [("1", "да\nнет", ""), ("2", 'a;"b"', ""), ("3", "Ж", ""), ("4", "x\ny", ""), ("5", "plain", ""), ("6", "x\n,\ny", "z")]
    again = tb.read_csv_auto(spark, os.path.join(d, "d.csv"), "id int, note string, more string", encoding="utf-8", sep=",")
    assert [tuple(r) for r in again.collect()] == [(6, "x\n,\ny", "z")]


def test_file_that_ends_inside_quotes_is_an_error(spark, tmp):
    with pytest.raises(ValueError, match="end inside quotes"):
        tb.read_table(spark, _write(os.path.join(tmp, "cut.csv"), 'id,note\n1,"a\nb\n2,c\n'))


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_written_text_comes_back_here_and_in_pandas(spark, tmp, sep):
    texts = ['He said "hi"', "two\nlines", "a,b;c\td", " spaces ", '"', '""', "\n", "back\\slash", 'end\\"', "é\r\nЖ", "x\n\n\ny"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, note string")
    path = os.path.join(tmp, "out.csv")
    tb.write_table(df.coalesce(1), path, sep=sep)
    want = sorted((str(i), t) for i, t in enumerate(texts))
    assert _cells(tb.read_table(spark, path, "id string, note string")) == want
    part = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv"))
    assert _pandas(part, sep=sep) == want


def test_a_given_schema_needs_no_pass_for_headers(spark, tmp, monkeypatch):
    path = os.path.join(tmp, "t.csv")
    with open(path, "w", newline="") as f:
        f.write('a,b\n1,"x\ny"\n2,"q ""r"", s\n\nt"\n3,plain\n')
    monkeypatch.setattr(type(spark.range(1)), "limit", lambda *_: pytest.fail("a pass over all records for their headers"))
    got = Q.read_spanning(spark, [path], ",", "utf-8", "a int, b string", True)
    assert sorted(map(tuple, got.collect())) == [(1, "x\ny"), (2, 'q "r", s\n\nt'), (3, "plain")]
