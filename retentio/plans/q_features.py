"""Registered feature, split and link queries over the students / scored-labels / pages views."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions import links as lk
from retentio.operators import features as fe
from retentio.operators import risk as rk
from retentio.operators import split as sp
from retentio.plans.oracle import age_group_sql, q, with_ctes
from retentio.plans.queries import register, rounded
from retentio.sources import fixtures as fx

NUMERIC = ("age", "gpa", "credits", "absences", "total_classes", "year_of_study")
CATEGORICAL = ("gender", "faculty")
SCALED = ("age", "gpa", "credits", "absences", "total_classes")
N_STUDENT_COLUMNS = 12


@register("profile_shape", with_ctes(
    f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({N_STUDENT_COLUMNS} AS INTEGER) AS n_columns FROM students",
    "students"))
def q_profile_shape(spark, sf):
    from retentio.operators.profile import profile_shape

    return profile_shape(fx.students(spark, sf))


@register("preview", with_ctes("SELECT least(count(*), 100) AS n_rows, CAST(count(DISTINCT student_id) >= least(count(*), 100) AS INTEGER) AS from_table FROM students",
                               "students"))
def q_preview(spark, sf):
    """The preview has a hundred rows, or all, and each is a row of the table."""
    from retentio.operators.profile import preview

    s = fx.students(spark, sf)
    rows = preview(s).join(s.select("student_id"), "student_id", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), (F.countDistinct("student_id") == F.count(F.lit(1))).cast("int").alias("from_table"))


@register("encode_label", with_ctes("""
SELECT student_id, CAST(CASE WHEN faculty IS NULL THEN (SELECT count(DISTINCT faculty) FROM students)
                             ELSE (SELECT count(DISTINCT o.faculty) FROM students o WHERE o.faculty < s.faculty) END AS DOUBLE) AS faculty_index
FROM students s""", "students"))
def q_encode_label(spark, sf):
    """Faculties as numbers in alphabetical order; a missing one comes last."""
    return fe.encode_label(fx.students(spark, sf), "faculty").select("student_id", "faculty_index")


@register("target_distribution", with_ctes("""
SELECT dropout, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct,
       round(sum(count_if(dropout = 1)) OVER () * 1.0 / sum(count(*)) OVER (), 6) AS dropout_rate
FROM students GROUP BY dropout""", "students"))
def q_target_distribution(spark, sf):
    from retentio.operators.profile import target_distribution

    return rounded(target_distribution(fx.students(spark, sf), "dropout"))


@register("add_absence_rate", with_ctes("""
SELECT student_id, absences, total_classes,
       round(CASE WHEN total_classes = 0 THEN NULL ELSE CAST(absences AS DOUBLE) / total_classes END, 6) AS absence_rate
FROM students""", "students"))
def q_add_absence_rate(spark, sf):
    s = fx.students(spark, sf).select("student_id", "absences", "total_classes")
    return rounded(fe.add_absence_rate(s))


@register("add_low_performance", with_ctes("""
SELECT student_id, round(gpa, 6) AS gpa, coalesce(CAST(gpa < 3.0 AS INTEGER), 0) AS low_performance FROM students""",
    "students"))
def q_add_low_performance(spark, sf):
    return rounded(fe.add_low_performance(fx.students(spark, sf).select("student_id", "gpa")))


@register("add_age_group", with_ctes(f"SELECT student_id, age, {age_group_sql('age')} AS age_group FROM students",
                                     "students"))
def q_add_age_group(spark, sf):
    return fe.add_age_group(fx.students(spark, sf).select("student_id", "age"))


@register("add_faculty_year", with_ctes("""
SELECT student_id, faculty, year_of_study, faculty || '_' || CAST(year_of_study AS VARCHAR) AS faculty_year
FROM students""", "students"))
def q_add_faculty_year(spark, sf):
    return fe.add_faculty_year(fx.students(spark, sf).select("student_id", "faculty", "year_of_study"))


@register("add_features", with_ctes(f"""
SELECT student_id, age, gender, round(gpa, 6) AS gpa, credits, absences, total_classes, scholarship, employment,
       year_of_study, faculty, dropout,
       round(CASE WHEN total_classes = 0 THEN NULL ELSE CAST(absences AS DOUBLE) / total_classes END, 6) AS absence_rate,
       coalesce(CAST(gpa < 3.0 AS INTEGER), 0) AS low_performance,
       {age_group_sql('age')} AS age_group,
       faculty || '_' || CAST(year_of_study AS VARCHAR) AS faculty_year
FROM students""", "students"))
def q_add_features(spark, sf):
    return rounded(fe.add_features(fx.students(spark, sf)))


@register("ensure_student_id", with_ctes("""
SELECT doc_id, 'Student_' || CAST(doc_id AS VARCHAR) AS student_id FROM scored_labels""", "scored_labels"))
def q_ensure_student_id(spark, sf):
    return rk.ensure_student_id(fx.scored_labels(spark, sf).select("doc_id"), "doc_id")


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM students WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


@register("feature_stats", with_ctes(" UNION ALL ".join(
    [f"SELECT {q(c)} AS column_name, 'numeric' AS role, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, "
     f"round(stddev_pop({c}), 6) AS std, CAST(NULL AS VARCHAR) AS mode FROM students" for c in NUMERIC]
    + [f"SELECT {q(c)}, 'categorical', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {_mode_sql(c)}"
       for c in CATEGORICAL]), "students"))
def q_feature_stats(spark, sf):
    return rounded(fe.feature_stats(fx.students(spark, sf), NUMERIC, CATEGORICAL))


_MED = "(SELECT " + ", ".join(f"median({c}) AS {c}" for c in SCALED) + " FROM students) md"
_ST = ("(SELECT " + ", ".join(f"avg(coalesce(s.{c}, md.{c})) AS mu_{c}, stddev_pop(coalesce(s.{c}, md.{c})) AS sd_{c}"
                               for c in SCALED) + f" FROM students s, {_MED}) st")


@register("impute_scale", with_ctes("SELECT s.student_id, " + ", ".join(
    f"round((coalesce(s.{c}, md.{c}) - mu_{c}) / CASE WHEN sd_{c} > 0 THEN sd_{c} ELSE 1.0 END, 6) AS {c}"
    for c in SCALED) + f" FROM students s, {_MED}, {_ST}", "students"))
def q_impute_scale(spark, sf):
    return rounded(fe.impute_scale(fx.students(spark, sf), SCALED))


@register("encode_label", with_ctes("""
SELECT student_id, faculty,
       CAST(CASE WHEN faculty IS NULL THEN (SELECT count(DISTINCT faculty) FROM students)
                 ELSE dense_rank() OVER (PARTITION BY faculty IS NULL ORDER BY faculty) - 1 END AS DOUBLE) AS faculty_index
FROM students""", "students"))
def q_encode_label(spark, sf):
    s = fx.students(spark, sf).select("student_id", "faculty")
    return fe.encode_label(s, "faculty", "faculty_index")


def _u(key: str) -> str:
    return sp.hash_unit_sql(key, 42)


@register("stratified_split", with_ctes(f"""
SELECT student_id, dropout, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT student_id, dropout, row_number() OVER (PARTITION BY dropout ORDER BY {_u('student_id')}, student_id) AS rn,
         count(*) OVER (PARTITION BY dropout) AS n FROM students) t""", "students"))
def q_stratified_split(spark, sf):
    s = fx.students(spark, sf).select("student_id", "dropout")
    return sp.stratified_split(s, "dropout", "student_id", 0.2, 42, exact=True)


@register("stratified_split_hash", with_ctes(f"""
SELECT student_id, dropout, CASE WHEN {_u('student_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM students""",
    "students"))
def q_stratified_split_hash(spark, sf):
    s = fx.students(spark, sf).select("student_id", "dropout")
    return sp.stratified_split(s, "dropout", "student_id", 0.2, 42, exact=False)


@register("assign_folds", with_ctes(f"""
SELECT student_id, dropout, CAST((row_number() OVER (PARTITION BY dropout ORDER BY {_u('student_id')}, student_id) - 1) % 5
       AS INTEGER) AS fold FROM students""", "students"))
def q_assign_folds(spark, sf):
    s = fx.students(spark, sf).select("student_id", "dropout")
    return sp.assign_folds(s, "dropout", "student_id", 5, 42, exact=True)


@register("assign_folds_hash", with_ctes(f"""
SELECT student_id, dropout, CAST(least(floor({_u('student_id')} * 5), 4) AS INTEGER) AS fold FROM students""",
    "students"))
def q_assign_folds_hash(spark, sf):
    s = fx.students(spark, sf).select("student_id", "dropout")
    return sp.assign_folds(s, "dropout", "student_id", 5, 42, exact=False)


SHARE_LINKS = (
    (-1, "https://drive.google.com/file/d/1AbC_dEf-123/view?usp=sharing"),
    (-2, "https://www.dropbox.com/s/abc123/students.csv?dl=0"),
    (-3, "https://onedrive.live.com/view.aspx?resid=XYZ&authkey=k"),
)


@register("normalize_links", """
WITH links AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, {q(u)})" for i, u in SHARE_LINKS) + """) t(page_id, url))
SELECT page_id, url, nullif(regexp_extract(url, '/d/([^/]+)', 1), '') AS drive_file_id,
       replace(url, 'www.dropbox.com', 'dl.dropboxusercontent.com') AS dropbox_url,
       string_split(split_part(url, '?', 1), '/')[-1] AS file_name,
       replace(url, 'view.aspx', 'download.aspx') AS onedrive_url
FROM links""")
def q_normalize_links(spark, sf):
    u = F.col("url")
    extra = spark.createDataFrame(list(SHARE_LINKS), "page_id bigint, url string")
    return fx.links(spark, sf).unionByName(extra).select("page_id", "url", lk.drive_file_id(u).alias("drive_file_id"),
                                      lk.dropbox_direct(u).alias("dropbox_url"), lk.url_file_name(u).alias("file_name"),
                                      lk.onedrive_download(u).alias("onedrive_url"))
