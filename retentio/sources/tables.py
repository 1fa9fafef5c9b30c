"""Table sources and sinks: format by extension, CSV dialect detection, exports.

Every reader returns a lazy DataFrame; paths may be local, HDFS or object-store URIs
(``s3a://bucket/key``) — credentials come from the Hadoop configuration, never from
arguments, and nothing is copied to the driver's disk.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.sources import json_array, quoted_csv

# --- fixed values ----------------------------------------------------------------------------
CSV_SEPARATORS = (",", ";", "\t")
CP1251_UNDEFINED = "\x98"
FACULTIES = ("Economics", "Law", "Computer Science", "Management", "Psychology")
REQUIRED_STUDENT_COLUMNS = ("student_id",)
# -------------------------------------------------------------------------------------------------

_FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc"}


def s3_path(bucket: str, key: str, scheme: str = "s3a") -> str:
    """Object-store URI of a bucket/key pair (read with :func:`read_table`)."""
    return f"{scheme}://{bucket.strip('/')}/{key.lstrip('/')}"


def table_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in _FORMATS:
        raise ValueError(f"unsupported file format: {ext or '(none)'}")
    return _FORMATS[ext]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table; the format comes from the lower-cased extension (unknown -> ValueError)."""
    fmt = table_format(path)
    if fmt == "csv":
        return read_csv_auto(spark, path, schema)
    if fmt == "json":
        return read_json_auto(spark, path, schema)
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.format(fmt).load(path)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


LINES, DOCUMENT, ARRAY = "lines", "document", "array"


def json_kinds(spark: SparkSession, path: str) -> dict[str, str]:
    """File -> ``ARRAY`` (an array of records), ``DOCUMENT`` (one record spread over lines) or ``LINES`` (one
    complete record per line, Spark's own output).

    A file that begins with a bracket is an array, whatever the length of its lines; others are judged by their
    first non-blank line.
    """
    place = F.struct("block", F.monotonically_increasing_id().alias("line"))
    first = F.ltrim(F.regexp_replace(F.col("value").cast("string"), "^[\\s\ufeff]+", ""))
    heads = (json_array.segments(spark, path).select("file", place.alias("place"), F.substring(first, 1, 1).alias("value")).filter("value <> ''")
             .groupBy("file").agg(F.min_by("value", "place").alias("head")).collect())
    kinds = {quoted_csv.path_of(r["file"]): ARRAY for r in heads if r["head"] == "["}
    rest = [p for r in heads if (p := quoted_csv.path_of(r["file"])) not in kinds]
    if rest:
        meta = F.col("_metadata")
        lines = spark.read.text(rest).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.trim("value").alias("value"))
        found = lines.select("file", "value", place.alias("place")).filter("value <> ''").groupBy("file").agg(F.min_by("value", "place").alias("head"))
        for r in found.collect():
            kinds[quoted_csv.path_of(r["file"])] = LINES if r["head"].startswith("{") and r["head"].endswith("}") else DOCUMENT
    return kinds


def json_layouts(spark: SparkSession, path: str) -> dict[str, bool]:
    """File -> True for a JSON document (an array of records, or one record spread over lines), False for JSON lines."""
    return {file: kind != LINES for file, kind in json_kinds(spark, path).items()}


def read_json_auto(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   document: bool | None = None) -> DataFrame:
    """JSON lines, arrays and documents, told apart file by file; ``document`` skips that.

    Arrays are cut into records by :mod:`retentio.sources.json_array`, all splits of a file at once; a
    single record spread over lines is parsed by one task.
    """
    r = spark.read if schema is None else spark.read.schema(schema)
    if document is not None:
        return r.option("multiLine", document).json(path)
    kinds = json_kinds(spark, path)
    parts = []
    for kind in (LINES, DOCUMENT, ARRAY):
        files = [f for f, k in kinds.items() if k == kind]
        if kind == ARRAY and files:
            parts.append(json_array.read_json_array(spark, files, schema))
        elif files:
            parts.append(r.option("multiLine", kind == DOCUMENT).json(path if len(files) == len(kinds) else files))
    return _union(parts) if parts else r.json(path)


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files under ``path``, by a listing alone."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    return sorted(quoted_csv.path_of(r["file"]) for r in listed.collect())


def _csv_files(spark: SparkSession, path: str) -> dict[str, tuple[str, str, bool]]:
    """File -> (encoding, separator, whether it holds quotes), from one aggregate over all lines of all files."""
    raw = F.col("value").cast("binary")
    undefined = F.decode(raw, "ISO-8859-1").contains(CP1251_UNDEFINED)
    # a doubled quote is two quoted parts side by side; "[^"]*" keeps no state per character, however long the field
    plain = F.regexp_replace(F.decode(raw, "ISO-8859-1"), '"[^"]*"', "")
    seps = [f"n{i}" for i in range(len(CSV_SEPARATORS))]
    meta = F.col("_metadata")
    lines = (spark.read.text(path).filter(F.length("value") > 0)
             .select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"),
                     F.is_valid_utf8("value").alias("utf8"), undefined.alias("odd"), F.expr("contains(cast(value as binary), X'22')").alias("quoted"),
                     *[(F.length(plain) - F.length(F.translate(plain, s, ""))).alias(n) for n, s in zip(seps, CSV_SEPARATORS)]))
    # numbers of lines first, places later: an aggregate that keeps structs sorts all lines
    counts = lines.groupBy("file", "block", *seps).agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("id"), F.min("utf8").alias("utf8"),
                                                       F.max("odd").alias("odd"), F.max("quoted").alias("quoted"))
    # the header is the file's first line; lines within a quoted text seldom have as many separators
    of_file = Window.partitionBy("file")
    shapes = counts.withColumn("head", F.min_by(F.struct(*seps), F.struct("block", "id")).over(of_file))
    votes = [F.sum(F.when((F.col(n) > 0) & (F.col(n) == F.col(f"head.{n}")), F.col("lines"))) for n in seps]
    found = (shapes.groupBy("file").agg(F.min("utf8").alias("utf8"), F.max("odd").alias("odd"), F.max("quoted").alias("quoted"),
                                        F.max("head").alias("head"), F.array(*votes).alias("votes")).collect())
    out = {}
    for r in found:
        best = max((v, r["head"][n], -i) for i, (v, n) in enumerate(zip([v or 0 for v in r["votes"]], seps)))
        out[quoted_csv.path_of(r["file"])] = ("utf-8" if r["utf8"] else "latin1" if r["odd"] else "cp1251", CSV_SEPARATORS[-best[2]] if best[0] else ",", r["quoted"])
    return out


def csv_dialects(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """File -> (encoding, separator), from one aggregate over all lines of all files.

    Encoding: UTF-8 if every line is valid UTF-8; else cp1251, or latin1 if a byte is not
    defined in cp1251. Separator: the candidate that cuts the most lines into as many fields (> 1) as
    the header, more fields first, ',' if none does; separators between quotes do not count.
    """
    return {file: (encoding, sep) for file, (encoding, sep, _) in _csv_files(spark, path).items()}


def _from_cp1251(text: Column) -> Column:
    """Text read byte for byte (latin1) to the characters its bytes have in cp1251."""
    upper = bytes(b for b in range(128, 256) if chr(b) != CP1251_UNDEFINED)
    return F.translate(text, upper.decode("latin1"), upper.decode("cp1251"))


def read_csv_auto(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer_schema: bool = True,
                  encoding: str | None = None, sep: str | None = None) -> DataFrame:
    """CSV with a header, encoding and separator detected file by file unless both are given.

    Files of different dialects are read apart and united by column name. Quoted fields may hold separators, doubled
    quotes and line breaks, as common readers take them; files in which a record goes over several lines are
    cut into records by :mod:`retentio.sources.quoted_csv`, all splits of a file at once.
    """
    if encoding is None or sep is None:
        found = _csv_files(spark, path)
    else:
        found = dict.fromkeys(_files(spark, path), (encoding, sep, True))
    groups: dict[tuple[str, str], list[str]] = {}
    for file, (e, s, _) in found.items():
        groups.setdefault((encoding or e, sep or s), []).append(file)
    parts = []
    for (e, s), files in sorted(groups.items()) or [((encoding or "utf-8", sep or ","), [])]:
        quoted = [f for f in files if found[f][2]]
        spanning = set(quoted_csv.spanning_files(spark, quoted, s)) if quoted else set()
        if spanning:
            parts.append(quoted_csv.read_spanning(spark, sorted(spanning), s, e, schema, infer_schema))
            if len(spanning) == len(files):
                continue
        files = [f for f in files if f not in spanning] if spanning or len(groups) > 1 else [path]
        r = spark.read.option("header", True).option("sep", s).option("escape", '"').option("encoding", "UTF-8" if e == "utf-8" else "ISO-8859-1")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", infer_schema)
        df = r.csv(files)
        if e == "cp1251":  # by a translation: the JVM's own decoder needs a session-wide setting
            names = [n.encode("latin1").decode("cp1251") if schema is None else n for n in df.columns]
            df = df.toDF(*names)
            df = df.select(*[_from_cp1251(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                             for f in df.schema.fields])
        parts.append(df)
    return _union(parts)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", sep: str = ",") -> None:
    """CSV (header, UTF-8), JSON lines or Parquet directory; format from the extension if not given."""
    fmt = fmt or table_format(path)
    w = df.write.mode(mode)
    if fmt == "csv":
        # quotes are doubled, and white space at the ends of a value stays
        (w.option("header", True).option("encoding", "UTF-8").option("sep", sep).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def bundle_name(name: str) -> str:
    """Directory-safe table name: letters (of any script), digits, ``_``, ``.`` and ``-`` stay."""
    return re.sub(r"[^\w.-]+", "_", name)


def write_bundle(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite",
                 parallel: int = 8) -> list[str]:
    """Export several named result tables, one directory each; returns the paths.

    The writes are independent jobs and are submitted concurrently (up to ``parallel``
    at a time) so small report tables do not leave the cluster idle one after another;
    the first failure is raised. Names that would share a directory are an error, raised
    before anything is written.
    """
    from concurrent.futures import ThreadPoolExecutor

    taken: dict[str, str] = {}
    for name in tables:
        # directories may be case-insensitive; a name without any safe character has no directory
        key = bundle_name(name).casefold()
        if not key.strip("._") or key in taken:
            raise ValueError(f"table name {name!r} has no directory of its own" + (f" beside {taken[key]!r}" if key in taken else ""))
        taken[key] = name
    paths = [os.path.join(root, bundle_name(name)) for name in tables]
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(paths)))) as ex:
        futs = [ex.submit(write_table, df, p, fmt, mode) for df, p in zip(tables.values(), paths)]
        for f in futs:
            f.result()
    return paths


def read_students(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                  target: str = "dropout") -> tuple[DataFrame, DataFrame]:
    """Student table split into (valid rows, rejected rows with a ``reason``).

    A row is rejected when its ``student_id`` is null, or the target is there but is not 0 or 1
    (a null, a fraction or a text among them).
    """
    df = read_table(spark, path, schema)
    missing = [c for c in REQUIRED_STUDENT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    reason = F.when(F.col("student_id").isNull(), F.lit("null student_id"))
    if target in df.columns:
        good = F.col(target).try_cast("double").isin(0.0, 1.0)
        reason = reason.when(~F.coalesce(good, F.lit(False)), F.lit("bad target"))
    tagged = df.withColumn("_reason", reason)
    ok = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return ok, bad


def synthetic_students(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Synthetic student rows from ``spark.range``: the result depends only on (n, seed).

    Columns follow the reference generator's domains: ``feature_0..9`` (five informative,
    two redundant combinations, three noise), ``student_id`` ``S00000..``, age 17-29,
    gender M/F, gpa 2-5, credits 0-239, absences 0-29, scholarship (20 % ones),
    employment (30 %), year 1-4, five faculties, and ``dropout`` from a logistic rule on
    the informative features. Every value is a hash of (id, column, seed), so it does
    not change with the partitioning (``rand(seed)`` would).
    """
    ids = spark.range(n).withColumnRenamed("id", "_i")

    def u(tag: str):  # uniform [0, 1)
        h = F.xxhash64(F.col("_i"), F.lit(tag), F.lit(seed))
        return (F.pmod(h, F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)

    def normal(tag: str):  # Box-Muller
        return F.sqrt(-2.0 * F.log(u(tag + "a"))) * F.cos(2.0 * 3.141592653589793 * u(tag + "b"))

    cols = {f"feature_{i}": normal(f"f{i}") for i in range(5)}
    df = ids.withColumns(cols)
    df = df.withColumns({"feature_5": F.col("feature_0") * 0.6 - F.col("feature_1") * 0.4,
                         "feature_6": F.col("feature_2") * 0.5 + F.col("feature_3") * 0.5})
    df = df.withColumns({f"feature_{i}": normal(f"f{i}") for i in range(7, 10)})
    logit = (1.2 * F.col("feature_0") - 0.8 * F.col("feature_1") + 0.9 * F.col("feature_2")
             - 0.7 * F.col("feature_3") + 0.5 * F.col("feature_4"))
    faculty = F.element_at(F.array(*[F.lit(f) for f in FACULTIES]), (F.floor(u("fac") * 5) + 1).cast("int"))
    return df.select(
        *[F.col(f"feature_{i}") for i in range(10)],
        F.format_string("S%05d", F.col("_i")).alias("student_id"),
        (F.lit(17) + F.floor(u("age") * 13)).cast("int").alias("age"),
        F.when(u("gender") < 0.5, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        (F.lit(2.0) + u("gpa") * 3.0).alias("gpa"),
        F.floor(u("credits") * 240).cast("int").alias("credits"),
        F.floor(u("absences") * 30).cast("int").alias("absences"),
        (u("scholarship") < 0.2).cast("int").alias("scholarship"),
        (u("employment") < 0.3).cast("int").alias("employment"),
        (F.lit(1) + F.floor(u("year") * 4)).cast("int").alias("year_of_study"),
        faculty.alias("faculty"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) > u("y")).cast("int").alias("dropout"),
    )


def write_evaluation(frames: Mapping[str, DataFrame], root: str, fmt: str = "json") -> list[str]:
    """Save an evaluation result (see :func:`retentio.plans.reports.evaluation_frames`).

    Each table is its own JSON-lines directory; curves can have one row per distinct
    score, so they are never folded into a single document row.
    """
    return write_bundle(frames, root, fmt)

