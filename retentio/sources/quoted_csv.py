"""CSV whose quoted fields hold line breaks, read in parallel by splits of a file.

A line break ends a record only outside quotes, and whether a line starts inside quotes depends on all lines
before it. That dependence is tiny: for each split of a file, the state after it as a function of the state before
it. One pass computes the functions of all splits, a running composition over a file's splits gives each
split's real starting state, and a second pass cuts every split into records on its own. Only the pieces of
records that cross a split are shuffled.

Quotes mean what they mean to common readers: a quote opens a quoted part only as the first character of a field, two quotes
in a row inside it are one quote, and elsewhere a quote is an ordinary character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = b'"'


def path_of(file: str) -> str:
    """Path to read a file by, from its name in ``_metadata.file_path``: that name is encoded, and a path may be a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def inside_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether the end of ``line`` is inside quotes, if its start is (``inside``) or is not."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(QUOTE, at):
                at = line.find(sep + QUOTE, at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        end = line.find(QUOTE, at)
        while end >= 0 and line.startswith(QUOTE, end + 1):
            end = line.find(QUOTE, end + 2)
        if end < 0:
            return True
        # behind the closing quote the field goes on as it is up to the next separator
        at = line.find(sep, end + 1)
        if at < 0:
            return False
        at, inside = at + len(sep), False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of files by path: lines with their file and split; ``\\r`` before a line's end stays."""
    meta = F.col("_metadata")
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_block_length"].alias("length"),
                    meta["file_size"].alias("size"), F.col("value").cast("binary").alias("line")))


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes] | None]]:
    """(file, block, length, size) and lines of each split in each batch; None for lines at a batch's end.

    What is the same for all lines of a split becomes a Python value once, not once a line.
    """
    for b in batches:
        if b.num_rows:
            block, file = b.column("block").to_numpy(), b.column("file").dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), b.num_rows]
            lines = b.column("line").to_pylist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield tuple(b.column(n)[s].as_py() for n in ("file", "block", "length", "size")), lines[s:e]
        yield (), None


SPLITS = "file string, block long, length long, after_out boolean, after_in boolean, opens_out boolean, opens_in boolean"


def _splits(sep: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: the state after it for either state before it, and whether a line then ends inside quotes."""
    last, state, opens = None, [False, True], [False, False]
    rows: list[tuple] = []
    for split, lines in _runs(batches):
        if lines is None:
            yield _batch(SPLITS, rows)
            rows = []
            continue
        if split[:3] != last:
            if last:
                rows.append((*last, *state, *opens))
            last, state, opens = split[:3], [False, True], [False, False]
        for line in lines:
            if QUOTE in line:
                out, inside = state
                out = inside_after(line, out, sep)
                # two starts that once agree agree from there on
                state = [out, out if state[0] == inside else inside_after(line, inside, sep)]
            if state[0]:
                opens[0] = True
            if state[1]:
                opens[1] = True
    if last:
        yield _batch(SPLITS, [(*last, *state, *opens)])


def quote_states(spark: SparkSession, paths: list[str], sep: str, quoted_only: bool = False) -> DataFrame:
    """file, block, length, starts (inside quotes), ends, opens (a line ends inside quotes): one row per split.

    With ``quoted_only``, lines without quotes are not looked at, nor are splits that have no others: cheaper, and enough to
    learn which files have a record over several lines.
    """
    lines = _lines(spark, paths)
    f = (lines.filter(F.expr("contains(line, X'22')")) if quoted_only else lines).mapInArrow(partial(_splits, sep.encode()), SPLITS)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a split fixes the state whatever it was, keeps it, or turns it round: the state is what the last one that fixed
    # it left, turned round by those that came later
    turns = F.sum((F.col("after_out") & ~F.col("after_in")).cast("int")).over(before)
    f = f.withColumn("turns", turns).withColumn("fixed", F.when(F.col("after_out") == F.col("after_in"), F.col("after_out").cast("int") + F.col("turns")))
    f = f.withColumn("ends", (F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0)) + F.col("turns")) % 2 == 1)
    f = f.withColumn("starts", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    return f.select("file", "block", "length", "starts", "ends", F.when(F.col("starts"), F.col("opens_in")).otherwise(F.col("opens_out")).alias("opens"))


def spanning_files(spark: SparkSession, paths: list[str], sep: str) -> list[str]:
    """Paths of the files in which a record goes over several lines."""
    return sorted(path_of(r["file"]) for r in quote_states(spark, paths, sep, quoted_only=True).filter("opens").select("file").distinct().collect())


# ---- records ------------------------------------------------------------------------------
RECORDS = "file string, block long, part int, first boolean, record string"
#: A record as a whole; the end of one, a split inside one, the start of one.
WHOLE, CLOSE, THROUGH, OPEN = range(4)
#: How a record's text is read.
CSV = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}


def _records(sep: bytes, encoding: str, inside: frozenset[tuple[str, int]], split: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, and the pieces of those that cross its ends."""
    last, state, piece, held, first = None, False, WHOLE, [], False
    out: list[tuple] = []

    def put(kind: int) -> None:
        nonlocal held, first
        text = b"\n".join(held)
        if kind == WHOLE and text.endswith(b"\r"):
            text = text[:-1]
        if kind != WHOLE or text.strip():
            out.append((*last, kind, first, text.decode(encoding, "replace")))
            first = False
        held = []

    for place, lines in _runs(batches):
        if lines is None:
            yield _batch(RECORDS, out)
            out = []
            continue
        file, block, length, size = place
        if (file, block) != last:
            if held:
                put(THROUGH if piece == CLOSE else OPEN)
            if block % split or (length != split and block + length != size):
                raise RuntimeError(f"{file}: splits are not those of the first pass, read it again")
            last, state, first = (file, block), (file, block) in inside, block == 0
            piece = CLOSE if state else WHOLE
        for line in lines:
            held.append(line)
            if QUOTE in line:
                state = inside_after(line, state, sep)
            if not state:
                put(piece)
                piece = WHOLE
    if held:
        put(THROUGH if piece == CLOSE else OPEN)
    yield _batch(RECORDS, out)


def records(spark: SparkSession, paths: list[str], sep: str, encoding: str = "utf-8") -> DataFrame:
    """file, first (the file's first record), record: one row per record that is not blank.

    A file that ends inside quotes is an error. If no record crosses a split, nothing is shuffled.
    """
    states = quote_states(spark, paths, sep).orderBy("file", "block").collect()  # of splits, not of rows
    split = max((r["length"] for r in states), default=1)
    ends = {r["file"]: r["ends"] for r in states}
    if any(ends.values()):
        raise ValueError(f"files end inside quotes: {[f for f, e in ends.items() if e][:5]}")
    inside = frozenset((r["file"], r["block"]) for r in states if r["starts"])
    found = _lines(spark, paths).mapInArrow(partial(_records, sep.encode(), encoding, inside, split), RECORDS)
    whole = found.filter(F.col("part") == WHOLE).select("file", "first", "record")
    if not inside:
        return whole
    pieces = found.filter(F.col("part") != WHOLE)
    # a split's end of a record comes before its start of another
    number = F.count(F.when(F.col("part") == OPEN, 1)).over(Window.partitionBy("file").orderBy("block", "part"))
    joined = (pieces.withColumn("number", number).groupBy("file", "number")
              .agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("parts")))
    text = F.regexp_replace(F.array_join(F.col("parts")["record"], "\n"), "\r$", "")
    return whole.unionByName(joined.select("file", "first", text.alias("record")))


def parse(rows: DataFrame, names: list[str], sep: str, schema: T.StructType | None) -> DataFrame:
    """The fields of each record, by position; without a schema all are text."""
    types = [f.dataType.simpleString() for f in schema.fields] if schema is not None else ["string"] * len(names)
    ddl = ", ".join(f"c{i} {t}" for i, t in enumerate(types))
    return rows.select(F.from_csv("record", ddl, CSV | {"sep": sep}).alias("r")).select("r.*").toDF(*(names if schema is None else schema.fieldNames()))


#: Types that a column of text is tried for, in this order.
TRIED = ("int", "bigint", "double", "boolean", "timestamp")


def with_inferred_types(df: DataFrame) -> DataFrame:
    """Text columns as the first of ``TRIED`` that all their values have, by one aggregate; columns without values stay text."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    fits = [F.bool_and(F.col(c).try_cast(t).isNotNull() | F.col(c).isNull()).alias(f"{c}_{t}") for c in plain.columns for t in TRIED]
    row = plain.agg(*fits, *[F.count(c).alias(f"{c}_n") for c in plain.columns]).first()
    typed = []
    for c, name in zip(plain.columns, names, strict=True):
        kind = next((t for t in TRIED if row[f"{c}_n"] and row[f"{c}_{t}"]), "string")
        typed.append(F.col(c).cast(kind).alias(name))
    return plain.select(*typed)


def header_names(spark: SparkSession, record: str, sep: str) -> tuple[str, ...]:
    """Names in a header; a column without one is called by its place."""
    n = record.count(sep) + 1
    row = parse(spark.createDataFrame([(record,)], "record string"), [f"c{i}" for i in range(n)], sep, None).first()
    names = list(row)
    while len(names) > 1 and names[-1] is None:  # separators between quotes
        names.pop()
    return tuple(f"_c{i}" if x is None else x for i, x in enumerate(names))


def read_spanning(spark: SparkSession, files: list[str], sep: str, encoding: str, schema: T.StructType | str | None, infer_schema: bool) -> DataFrame:
    """Files with records over several lines, each with a header; united by name if their headers differ."""
    rows = records(spark, files, sep, encoding)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    headers: dict[tuple[str, ...], list[str]] = {} if schema is None else {(): files}  # names are given: no pass for them
    for r in rows.filter("first").select("file", "record").limit(len(files)).collect() if schema is None else ():  # a record per file
        headers.setdefault(header_names(spark, r["record"], sep), []).append(r["file"])
    body = rows.filter(~F.col("first"))
    parts = [parse(body if len(headers) == 1 else body.filter(F.col("file").isin(own)), list(names), sep, schema) for names, own in sorted(headers.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return with_inferred_types(out) if schema is None and infer_schema else out
