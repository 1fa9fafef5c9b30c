"""Derived student features, column roles, feature statistics and the feature pipeline.

Derived features are added only when their input columns exist (decided once on the
driver from ``df.columns``; no job). The feature pipeline is a ``pyspark.ml`` Pipeline:
mode impute -> string index (alphabetical, unseen -> extra index) -> one-hot (the extra
index is the dropped last slot, so unseen categories become all zeros) -> exact median
impute + population-std scale -> assemble numeric block then categorical block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.bins import absence_rate, age_group, faculty_year, low_performance
from retentio.ml.preprocessing import MedianStandardScaler, ModeImputer
from retentio.operators.running import exact_modes, exact_quantiles

# --- fixed values --------------------------------------------------------------------------
ID_NAMES = ("id", "student_id", "identifier")
DEFAULT_TARGET = "dropout"
# ---------------------------------------------------------------------------------------------


def infer_column_roles(df: DataFrame, target: str | None = DEFAULT_TARGET,
                       ids: Sequence[str] = ID_NAMES) -> tuple[list[str], list[str]]:
    """(categorical, numeric) input columns from the schema; ids and the target are skipped.

    Strings are categorical, numbers and booleans numeric; other types (dates, arrays) are
    in neither list and never reach the pipeline.
    """
    cat, num = [], []
    idset = {i.lower() for i in ids}
    for f in df.schema.fields:
        if f.name.lower() in idset or f.name == target:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
    return cat, num


def add_absence_rate(df: DataFrame) -> DataFrame:
    if {"absences", "total_classes"} <= set(df.columns):
        return df.withColumn("absence_rate", absence_rate("absences", "total_classes"))
    return df


def add_low_performance(df: DataFrame) -> DataFrame:
    if "gpa" in df.columns:
        return df.withColumn("low_performance", low_performance("gpa"))
    return df


def add_age_group(df: DataFrame) -> DataFrame:
    if "age" in df.columns:
        return df.withColumn("age_group", age_group("age"))
    return df


def add_faculty_year(df: DataFrame) -> DataFrame:
    if {"faculty", "year_of_study"} <= set(df.columns):
        return df.withColumn("faculty_year", faculty_year("faculty", "year_of_study"))
    return df


def add_features(df: DataFrame) -> DataFrame:
    """All derived features whose inputs are present, in one projection."""
    cols = set(df.columns)
    new = {}
    if {"absences", "total_classes"} <= cols:
        new["absence_rate"] = absence_rate("absences", "total_classes")
    if "gpa" in cols:
        new["low_performance"] = low_performance("gpa")
    if "age" in cols:
        new["age_group"] = age_group("age")
    if {"faculty", "year_of_study"} <= cols:
        new["faculty_year"] = faculty_year("faculty", "year_of_study")
    return df.withColumns(new) if new else df


def feature_stats(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Per column: exact median, mean, population std (numeric) or mode (categorical).

    Means and stds come from one aggregate over all columns; medians and modes from the
    distributed exact operators (value counts + running counts), so no task holds all
    distinct values of a column.
    """
    spark = df.sparkSession
    parts = []
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            aggs += [F.avg(x).alias(f"mu{i}"), F.stddev_pop(x).alias(f"sd{i}")]
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"mu{i}").alias("mean"),
                                   F.col(f"sd{i}").alias("std")) for i, c in enumerate(numeric)])
        moments = df.agg(*aggs).select(F.inline(cells))
        meds = exact_quantiles(df, numeric, 0.5).withColumnRenamed("quantile", "median")
        parts.append(meds.join(moments, "column_name").select(
            "column_name", F.lit("numeric").alias("role"), "median", "mean", "std",
            F.lit(None).cast("string").alias("mode")))
    if categorical:
        none_d = F.lit(None).cast("double")
        parts.append(exact_modes(df, categorical).select(
            "column_name", F.lit("categorical").alias("role"), none_d.alias("median"), none_d.alias("mean"),
            none_d.alias("std"), "mode"))
    if not parts:
        return spark.createDataFrame([], "column_name string, role string, median double, mean double, std double, mode string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute_scale(df: DataFrame, numeric: Sequence[str], keep: Sequence[str] = ("student_id",)) -> DataFrame:
    """Fit the exact median-impute + standardise step and apply it (columns replaced in place)."""
    m = MedianStandardScaler(inputCols=list(numeric), outputCols=list(numeric)).fit(df)
    return m.transform(df).select(*keep, *numeric)


def encode_label(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Index a string label in alphabetical order (0..k-1); null / unseen -> k."""
    out = out or f"{col}_index"
    si = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    return si.fit(df).transform(df)


def build_feature_pipeline(df: DataFrame, target: str | None = DEFAULT_TARGET, ids: Sequence[str] = ID_NAMES,
                           output: str = "features", relative_error: float = 0.0) -> Pipeline:
    """The unfitted feature Pipeline for the columns of ``df`` (roles from the schema)."""
    cat, num = infer_column_roles(df, target, ids)
    stages = []
    if cat:
        imp = [f"{c}__imp" for c in cat]
        idx = [f"{c}__idx" for c in cat]
        ohe = [f"{c}__ohe" for c in cat]
        stages += [ModeImputer(inputCols=cat, outputCols=imp),
                   StringIndexer(inputCols=imp, outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]
    else:
        ohe = []
    scaled = [f"{c}__num" for c in num]
    if num:
        stages.append(MedianStandardScaler(inputCols=num, outputCols=scaled, relativeError=relative_error))
    stages.append(VectorAssembler(inputCols=scaled + ohe, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def fit_features(df: DataFrame, target: str | None = DEFAULT_TARGET, ids: Sequence[str] = ID_NAMES,
                 output: str = "features") -> PipelineModel:
    """Fit the feature pipeline on ``df`` (drop the target first if present)."""
    return build_feature_pipeline(df, target, ids, output).fit(df)


def fit_transform_features(df: DataFrame, target: str | None = DEFAULT_TARGET, ids: Sequence[str] = ID_NAMES,
                           output: str = "features") -> tuple[PipelineModel, DataFrame]:
    """Fit the feature pipeline on ``df`` and apply it to the same rows."""
    m = fit_features(df, target, ids, output)
    return m, m.transform(df)


def transform_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply a fitted feature pipeline (``model.transform``)."""
    return model.transform(df)


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the slots of an assembled vector column, from its ML attribute metadata.

    Numeric slots are the source column names; one-hot slots are ``<column>_<category>``.
    """
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    slots = []
    for kind in ("numeric", "binary", "nominal"):
        for a in attrs.get(kind, []):
            slots.append((a["idx"], a["name"]))
    known = _slot_names(df)
    return [known.get(n, n.removesuffix("__num")) for _, n in sorted(slots)]


def _slot_names(df: DataFrame) -> dict[str, str]:
    """Assembled slot name -> shown name, from the columns of the stages and their own metadata."""
    known = {}
    for f in df.schema.fields:
        if f.name.endswith("__num"):
            known[f.name] = f.name.removesuffix("__num")
        elif f.name.endswith("__ohe"):
            for attrs in f.metadata.get("ml_attr", {}).get("attrs", {}).values():
                known |= {f"{f.name}_{a['name']}": f"{f.name.removesuffix('__ohe')}_{a['name']}" for a in attrs}
    return known


def feature_kinds(df: DataFrame, col: str = "features") -> list[str]:
    """'numeric' or 'onehot' per slot of the vector column (used by key-factor analysis)."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    slots = []
    for kind in ("numeric", "binary", "nominal"):
        for a in attrs.get(kind, []):
            slots.append((a["idx"], "numeric" if kind == "numeric" else "onehot"))
    return [k for _, k in sorted(slots)]
