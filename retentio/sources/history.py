"""Stored histories: dated risk assessments and model-metric documents.

* :class:`RiskHistory` — Parquet table partitioned by ``assessment_date``. An upsert
  rewrites only that date's partition (dynamic partition overwrite), so the same date
  written twice keeps the last write and other dates are untouched; reads of one date
  prune every other partition.
* :class:`MetricsHistory` — JSON-lines documents ``(timestamp, model_version, metrics,
  dataset_info)`` with both maps read as ``map<string,string>`` (mixed scalar and nested
  values; nested ones arrive as JSON text and are skipped by the numeric reader).
  Appends add files; nothing is rewritten.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.bins import RISK_LEVELS, clean_double
from retentio.operators import history as hs
from retentio.operators import risk as rk
from retentio.session import checkpoint_dir
from retentio.sources.json_array import read_json_array

RISK_SCHEMA = T.StructType([
    T.StructField("student_id", T.StringType()),
    T.StructField("dropout_probability", T.DoubleType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("assessment_date", T.DateType()),
])

# ISO timestamps with microseconds, as the stored history writes them
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

HISTORY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    T.StructField("dataset_info", T.MapType(T.StringType(), T.StringType())),
])


def stored(spark: SparkSession, schema: T.StructType | None, load: Callable[[DataFrameReader], DataFrame]) -> DataFrame:
    """A stored table, empty where nothing has been stored yet; any other failure to open it is raised."""
    try:
        return load(spark.read if schema is None else spark.read.schema(schema))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema or T.StructType())


class RiskHistory:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def upsert(self, risks: DataFrame, date, model_version: str, notes: str | None = None) -> None:
        """Store one assessment; an existing assessment of the same date is replaced, also by an empty one."""
        rows = hs.as_assessment(risks, date, model_version, notes)
        cols = [f.name for f in RISK_SCHEMA.fields]
        if rows.isEmpty():
            self._drop(date)
            return
        (rows.select(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("assessment_date").parquet(self.root))

    def merge(self, risks: DataFrame, date, model_version: str, notes: str | None = None) -> None:
        """Add students to an assessment: rows of the same student are replaced, others of that date stay.

        A row without an id replaces one stored row without an id that equals it in all columns,
        ``model_version`` and ``notes`` included, so a batch sent again adds nothing; batches of
        different unknown students are told apart by ``notes``.
        """
        cols = [f.name for f in RISK_SCHEMA.fields]
        new = hs.as_assessment(risks, date, model_version, notes).select(*cols)
        stored_rows, unknown = self.get(date).select(*cols), "student_id is null"
        old = stored_rows.filter(f"not ({unknown})").join(new.select("student_id"), "student_id", "left_anti").select(*cols)
        both = old.unionByName(stored_rows.filter(unknown).exceptAll(new.filter(unknown))).unionByName(new)
        checkpoint_dir(self.spark)
        (both.checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("assessment_date").parquet(self.root))

    def _drop(self, date) -> None:
        """Remove one assessment's directory, if it is there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/assessment_date={str(date)[:10]}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write_all(self, history: DataFrame) -> None:
        """Store a whole history at once; only the dates present in ``history`` are replaced.

        Of several rows of one student and date the one with the largest probability stays
        (the comparisons need one); rows without an id all stay. Rows are rebalanced on the date before the partitioned write: AQE
        clusters each date into files of the advisory partition size and splits a hot date
        over several tasks, instead of one small file per (input task, date).
        """
        typed = history.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RISK_SCHEMA.fields])
        rest = [f.name for f in RISK_SCHEMA.fields if f.name not in ("student_id", "assessment_date")]
        best = F.max(F.struct(clean_double(hs.P).alias("_p"), *rest)).alias("r")
        one = typed.filter("student_id is not null").groupBy("assessment_date", "student_id").agg(best)
        one = one.select("student_id", *[F.col(f"r.{c}").alias(c) for c in rest], "assessment_date")
        (one.unionByName(typed.filter("student_id is null"))
         .hint("rebalance", "assessment_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("assessment_date").parquet(self.root))

    def read(self) -> DataFrame:
        return stored(self.spark, RISK_SCHEMA, lambda r: r.parquet(self.root))

    def get(self, date=None) -> DataFrame:
        """One assessment, the latest without a date; empty when the date is missing. Opens one partition."""
        rows, day = self.read(), date or self.latest()
        return rk.assessment(rows, day) if day is not None else rows.limit(0)

    def dates(self) -> DataFrame:
        """Sorted dates that have rows, from the names of their directories: no data file is opened."""
        files = stored(self.spark, None, lambda r: r.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.root))
        if hs.DATE not in files.columns:
            return self.spark.createDataFrame([], f"{hs.DATE} date")
        return files.select(F.col(hs.DATE).cast("date").alias(hs.DATE)).distinct().orderBy(hs.DATE)

    def latest(self) -> dt.date | None:
        """The latest date that has rows, by the same listing."""
        return self.dates().agg(F.max(hs.DATE)).first()[0]

    def summary(self, date=None) -> DataFrame:
        """Summary of one assessment, the latest without a date; opens one partition."""
        return rk.risk_summary(self.read(), date or self.latest())

    def changes(self, date_before, date_after, labels: Sequence[str] = RISK_LEVELS) -> DataFrame:
        return rk.risk_changes(self.read(), date_before, date_after, labels)

    def change_summary(self, date_before, date_after) -> DataFrame:
        return rk.risk_change_summary(self.read(), date_before, date_after)

    def follow(self, students, start=None, end=None) -> DataFrame:
        return hs.student_risk_history(self.read(), students, start, end)


def _text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, (dict, list, tuple)):
        return json.dumps(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


class MetricsHistory:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, metrics: Mapping, model_version: str, dataset_info: Mapping | None = None,
               timestamp: dt.datetime | None = None) -> None:
        """Append one entry (one small file; earlier entries are not rewritten)."""
        ts = timestamp or dt.datetime.now()
        row = (ts, model_version, {k: _text(v) for k, v in metrics.items()},
               {k: _text(v) for k, v in (dataset_info or {}).items()})
        (self.spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1).write.mode("append")
         .option("timestampNTZFormat", TS_FORMAT).json(self.root))

    def append_frame(self, metrics_row: DataFrame, model_version: str | None = None,
                     dataset_info: Mapping | None = None) -> None:
        """Append the metric rows of :func:`retentio.ml.train.train` (numeric columns -> map)."""
        num = [f.name for f in metrics_row.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        m = F.map_from_arrays(F.array(*[F.lit(c) for c in num]), F.array(*[F.col(c).cast("string") for c in num]))
        info = F.create_map(*[x for k, v in (dataset_info or {}).items() for x in (F.lit(k), F.lit(_text(v)))]) \
            if dataset_info else F.create_map().cast("map<string,string>")
        mv = F.lit(model_version) if model_version else F.col("model_name")
        out = metrics_row.select(F.localtimestamp().cast("timestamp_ntz").alias("timestamp"), mv.alias("model_version"),
                                 m.alias("metrics"), info.alias("dataset_info"))
        out.coalesce(1).write.mode("append").option("timestampNTZFormat", TS_FORMAT).json(self.root)

    def append_entries(self, entries: DataFrame) -> None:
        """Append many entries (timestamp, model_version, metrics, dataset_info) in one job."""
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY_SCHEMA.fields]
        entries.select(*cols).write.mode("append").option("timestampNTZFormat", TS_FORMAT).json(self.root)

    def read(self) -> DataFrame:
        return stored(self.spark, HISTORY_SCHEMA, lambda r: r.json(self.root))

    def long(self) -> DataFrame:
        return hs.explode_metrics(self.read())

    @staticmethod
    def read_documents(spark: SparkSession, path: str) -> DataFrame:
        """Entries of files that each are a JSON array, with the history schema; a file is read by several tasks."""
        return read_json_array(spark, path, HISTORY_SCHEMA)
