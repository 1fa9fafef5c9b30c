"""JSON arrays of records, read in parallel by splits of a file.

An array has no line that ends a record, and may be one line of any length. So a file is cut at
closing braces instead, which splits it anywhere: a record can only end there. Whether a brace ends a record
depends on all bytes before it, by little: whether they end inside a string, and how many braces and brackets
are open. One pass computes for each split how it changes both, running sums over a file's splits give
each split's start, and a second pass cuts every split into records on its own. Only the pieces of records that
cross a split are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.sources.quoted_csv import CLOSE, OPEN, THROUGH, WHOLE, _batch

#: How many braces and brackets a byte opens.
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1
#: Depth between the records of an array.
BETWEEN = 1
BETWEEN_BYTES = b" \t\r\n,["


def segments(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, block, length, value: files cut behind each closing brace, which is left out."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "}").text(paths if isinstance(paths, str) else list(paths))
    return text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_block_length"].alias("length"),
                       F.col("value").cast("binary").alias("value"))


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of braces and brackets, what each opens, whether it follows an odd number of quotes; whether the data has an odd number."""
    quotes = np.flatnonzero(data == ord('"'))
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):  # a quote behind an odd number of backslashes is escaped
        first = np.ones(len(slashes), bool)
        first[1:] = np.diff(slashes) > 1
        start = slashes[first]
        size = np.diff(np.append(np.flatnonzero(first), len(slashes)))
        quotes = np.setdiff1d(quotes, (start + size)[size % 2 == 1], assume_unique=True)
    at = np.flatnonzero(STEP[data])
    return at, STEP[data[at]], np.searchsorted(quotes, at) % 2 == 1, len(quotes) % 2 == 1


SPLITS = "file string, block long, length long, turns int, plain long, turned long"


def _per_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, pa.RecordBatch]]:
    """For each batch and split: the split, its bytes with braces put back, and the batch's first row of it."""
    for b in batches:
        files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
        cuts = [0, *(i for i in range(1, b.num_rows) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), b.num_rows]
        values = b.column("value").to_pylist()
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield (files[s], blocks[s]), np.frombuffer(b"}".join(values[s:e]) + b"}", "u1"), b.slice(s, 1)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether it turns inside to outside, and the depth it adds for either start."""
    last, length, turns, add = None, 0, False, [0, 0]
    for split, data, head in _per_split(batches):
        if split != last:
            if last:
                yield _batch(SPLITS, [(*last, length, int(turns), *add)])
            last, length, turns, add = split, head.column("length")[0].as_py(), False, [0, 0]
        _, step, odd, turned = marks(data)
        for start in (0, 1):
            add[start] += int(step[odd == (turns != bool(start))].sum())
        turns ^= turned
    if last:
        yield _batch(SPLITS, [(*last, length, int(turns), *add)])


def split_starts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, block, length, inside (a string), depth at the start of each split, and inside_end, depth_end at its end."""
    f = segments(spark, paths).mapInArrow(_splits, SPLITS)
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = f.withColumn("inside_end", F.sum("turns").over(upto) % 2 == 1)
    f = f.withColumn("inside", F.coalesce(F.lag("inside_end").over(order), F.lit(False)))
    f = f.withColumn("add", F.when(F.col("inside"), F.col("turned")).otherwise(F.col("plain")))
    f = f.withColumn("depth_end", F.sum("add").over(upto))
    return f.select("file", "block", "length", "inside", (F.col("depth_end") - F.col("add")).alias("depth"), "inside_end", "depth_end")


RECORDS = "file string, block long, part int, record binary"
_RECORD = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("record", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, inside, depth, piece, held = None, False, 0, WHOLE, b""

    def rest() -> pa.RecordBatch:
        if piece == CLOSE:
            return _rows([(*last, THROUGH, held)])
        return _rows([(*last, OPEN, held.lstrip(BETWEEN_BYTES))] if inside or depth > BETWEEN else [])

    for split, data, head in _per_split(batches):
        if split != last:
            if last:
                yield rest()
            if not head.column("known")[0].as_py():
                raise RuntimeError(f"{split[0]}: splits are not those of the first pass, read it again")
            last, inside, depth, held = split, head.column("inside")[0].as_py(), head.column("depth")[0].as_py(), b""
            piece = CLOSE if inside or depth > BETWEEN else WHOLE
        at, step, odd, turned = marks(data)
        real = odd == inside
        at, step = at[real], step[real]
        depths = depth + np.cumsum(step)
        ends = at[(step < 0) & (data[at] == ord("}")) & (depths == BETWEEN)] + 1
        raw, s, rows = data.tobytes(), 0, []
        for e in ends.tolist():
            rows.append((*last, piece, held + raw[s:e] if piece == CLOSE else (held + raw[s:e]).lstrip(BETWEEN_BYTES)))
            s, held, piece = e, b"", WHOLE
        held += raw[s:]
        depth = int(depths[-1]) if len(depths) else depth
        inside ^= turned
        yield _rows(rows)
    if last:
        yield rest()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RECORD)], schema=_RECORD)


def array_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """record: the text of every object in the arrays that the files are, one row each.

    An array that does not end is an error; elements that are no objects give no row.
    """
    starts = split_starts(spark, paths).orderBy("file", "block").collect()  # of splits, not of records
    # behind a whole array comes the brace that each last segment is given
    ends = {r["file"]: (r["inside_end"], r["depth_end"]) for r in starts}
    broken = [f for f, e in ends.items() if e != (False, -1)]
    if broken:
        raise ValueError(f"files that are no whole arrays: {broken[:5]}")
    known = spark.createDataFrame([(r["file"], r["block"], r["length"], r["inside"], r["depth"], True) for r in starts],
                                  "file string, block long, length long, inside boolean, depth long, known boolean")
    # the order of a split's segments must stay, which a broadcast keeps
    lines = segments(spark, paths).join(F.broadcast(known), ["file", "block", "length"], "left")
    found = lines.mapInArrow(_records, RECORDS)
    whole = found.filter(F.col("part") == WHOLE).select(F.col("record").cast("string").alias("record"))
    if not any(r["block"] and (r["inside"] or r["depth"] > BETWEEN) for r in starts):
        return whole
    pieces = found.filter(F.col("part") != WHOLE)
    # a split's end of a record comes before its start of another
    number = F.count(F.when(F.col("part") == OPEN, 1)).over(Window.partitionBy("file").orderBy("block", "part"))
    joined = (pieces.withColumn("number", number).groupBy("file", "number")
              .agg(F.sort_array(F.collect_list(F.struct("block", "part", F.col("record").cast("string").alias("record")))).alias("parts")))
    return whole.unionByName(joined.select(F.array_join(F.col("parts")["record"], "").alias("record")))


#: A type in the schema of a variant stands behind a name or opens an array.
_TYPE = r"(?:(?<=: )|(?<=ARRAY<)|^)"


def inferred_schema(records: DataFrame) -> T.StructType:
    """The schema that all records share, by one aggregate: whole numbers as bigint, others as double, mixed types as text."""
    found = records.agg(F.schema_of_variant_agg(F.try_parse_json("record")).alias("s")).first()["s"]
    ddl = re.sub(_TYPE + r"(?:OBJECT<>|VOID|VARIANT)", "STRING", found)
    ddl = re.sub(_TYPE + r"(?:DECIMAL\(\d+, ?\d+\)|FLOAT)", "DOUBLE", ddl)
    ddl = re.sub(_TYPE + "OBJECT<", "STRUCT<", ddl)
    whole = T._parse_datatype_string(ddl) if ddl.startswith("STRUCT<") else T.StructType()
    return whole


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """The records of files that each are a JSON array, one row each; a record that does not fit the schema has nulls."""
    records = array_records(spark, paths)
    if schema is None:
        schema = inferred_schema(records)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def _array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of an array around the records of one task."""
    comma = ""
    yield pa.RecordBatch.from_pydict({"value": pa.array(["["])})
    for b in batches:
        lines = b.column("value").to_pylist()
        if lines:
            yield pa.RecordBatch.from_pydict({"value": pa.array([comma + lines[0], *("," + x for x in lines[1:])], pa.string())})
            comma = ","
    yield pa.RecordBatch.from_pydict({"value": pa.array(["]"])})


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Rows as files that each are a JSON array, one file per task; nulls are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_array, "value string").write.mode("overwrite").text(path)
