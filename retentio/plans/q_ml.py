"""Registered ML queries: key factors and kNN (with oracles), training/scoring (rows only)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.functions.bins import risk_level
from retentio.ml import train as tr
from retentio.ml.stumps import best_splits
from retentio.operators import features as fe
from retentio.operators import knn_lsh
from retentio.operators.knn import knn_join
from retentio.operators.split import hash_unit_sql, stratified_split
from retentio.plans.oracle import age_group_sql, q, risk_level_sql, with_ctes
from retentio.plans.queries import register, rounded
from retentio.sources import fixtures as fx

KEY_FACTOR_THRESHOLD = 0.5
KNN_K = 5
TUNED_MODEL = "knn"
TRAINED_MODELS = ("logistic_regression", "random_forest", "gradient_boosting", "adaboost", "svm", "knn",
                  "decision_tree", "neural_network")


def _students_scored(spark, sf):
    """Students with a data-derived probability: the absence rate (0 when undefined)."""
    s = fe.add_features(fx.students(spark, sf))
    return s.withColumn("dropout_probability", F.coalesce(F.col("absence_rate"), F.lit(0.0)))


def _factor_sql(name: str) -> str:
    return (f"CASE WHEN {name} > (SELECT median({name}) FROM students) THEN "
            f"{q(name + ' (')} || printf('%.2f', CAST({name} AS DOUBLE)) || ')' END")


@register("key_factors", with_ctes(f"""
SELECT student_id, round(p, 6) AS dropout_probability, {risk_level_sql('p')} AS risk_level,
       CASE WHEN p >= {KEY_FACTOR_THRESHOLD} THEN array_to_string(list_slice(list_filter([
            {', '.join(_factor_sql(f) for f, _ in sorted(fx.IMPORTANCE, key=lambda t: (-t[1], t[0])))}
       ], lambda x: x IS NOT NULL), 1, 3), ', ') END AS key_factors
FROM (SELECT *, coalesce(CASE WHEN total_classes = 0 THEN NULL ELSE CAST(absences AS DOUBLE) / total_classes END, 0.0) AS p
      FROM students) s""", "students"))
def q_key_factors(spark, sf):
    s = _students_scored(spark, sf)
    return rounded(tr.key_factors(s, fx.importance(spark), KEY_FACTOR_THRESHOLD))


# slot names as the one-hot encoder gives them, and a negative coefficient of large size
ONE_HOT_IMPORTANCE = (("faculty_year_BUILDING_2", 0.3), ("gpa", -5.0), ("age", 0.1), ("credits", 0.2))


@register("key_factors_onehot", with_ctes(f"""
SELECT student_id, round(p, 6) AS dropout_probability, {risk_level_sql('p')} AS risk_level,
       CASE WHEN p >= {KEY_FACTOR_THRESHOLD} THEN array_to_string(list_filter([{_factor_sql('gpa')},
            CASE WHEN faculty = 'BUILDING' AND year_of_study = 2 THEN 'faculty_year_BUILDING_2' END, {_factor_sql('credits')}
       ], lambda x: x IS NOT NULL), ', ') END AS key_factors
FROM (SELECT *, coalesce(CASE WHEN total_classes = 0 THEN NULL ELSE CAST(absences AS DOUBLE) / total_classes END, 0.0) AS p
      FROM students) s""", "students"))
def q_key_factors_onehot(spark, sf):
    """Factors from signed coefficients and from a slot of ``faculty_year``, whose name also starts with ``faculty_``."""
    imp = spark.createDataFrame(list(ONE_HOT_IMPORTANCE), "feature string, importance double")
    return rounded(tr.key_factors(_students_scored(spark, sf), imp, KEY_FACTOR_THRESHOLD, top_features=3))


@register("knn_join", with_ctes(f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM (
  SELECT query_id, neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.embedding, b.embedding) AS distance
        FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id) d) r
WHERE rank <= {KNN_K}""", "vectors"))
def q_knn_join(spark, sf):
    v = fx.vectors(spark, sf)
    return rounded(knn_join(v, v, k=KNN_K, query_id="vec_id", point_id="vec_id", features="embedding",
                            exclude_self=True))


# --- the fitted feature matrix ---------------------------------------------------------------
FEATURE_NUMERIC = ("age", "gpa", "credits", "absences", "total_classes", "scholarship", "employment", "year_of_study",
                   "absence_rate", "low_performance")
FEATURE_CATEGORICAL = ("gender", "faculty", "age_group", "faculty_year")


def _feature_ctes(fit: str) -> str:
    """CTEs: f (derived columns and split), st (medians, means, deviations of the rows that ``fit`` holds for), m and c (modes, categories)."""
    med = ", ".join(f"median({n}) AS {n}" for n in FEATURE_NUMERIC)
    stats = ", ".join(f"any_value(md.{n}) AS med_{n}, avg(coalesce(f.{n}, md.{n})) AS mu_{n}, stddev_pop(coalesce(f.{n}, md.{n})) AS sd_{n}"
                      for n in FEATURE_NUMERIC)
    modes = ", ".join(f"(SELECT {c} FROM f WHERE {fit} AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
                      for c in FEATURE_CATEGORICAL)
    cats = ", ".join(f"list_sort(list(DISTINCT coalesce(f.{c}, m.{c}))) AS {c}" for c in FEATURE_CATEGORICAL)
    u = hash_unit_sql("student_id", 42)
    return f""",
f AS (SELECT s.*, CASE WHEN total_classes = 0 THEN NULL ELSE CAST(absences AS DOUBLE) / total_classes END AS absence_rate,
             coalesce(CAST(gpa < 3.0 AS INTEGER), 0) AS low_performance, {age_group_sql('age')} AS age_group,
             faculty || '_' || CAST(year_of_study AS VARCHAR) AS faculty_year,
             CASE WHEN row_number() OVER (PARTITION BY dropout ORDER BY {u}, student_id) <= floor(count(*) OVER (PARTITION BY dropout) * 0.2 + 0.5)
                  THEN 'test' ELSE 'train' END AS split FROM students s),
md AS (SELECT {med} FROM f WHERE {fit}),
st AS (SELECT {stats} FROM f, md WHERE {fit}),
m AS (SELECT {modes}),
c AS (SELECT {cats} FROM f, m WHERE {fit})
"""


def _features_sql(fit: str, rows: str) -> str:
    num = ", ".join(f"round((coalesce(f.{n}, med_{n}) - mu_{n}) / CASE WHEN sd_{n} > 0 THEN sd_{n} ELSE 1.0 END, 6)" for n in FEATURE_NUMERIC)
    hot = ", ".join(f"list_transform(c.{k}, lambda v: CAST(v = coalesce(f.{k}, m.{k}) AS DOUBLE))" for k in FEATURE_CATEGORICAL)
    return with_ctes("", "students").rstrip() + _feature_ctes(fit) + (
        f"SELECT student_id, flatten([[{num}], {hot}]) AS features FROM f, st, m, c WHERE {rows}")


def _names_sql() -> str:
    numeric = " UNION ALL ".join(f"SELECT {i} AS slot, {q(n)} AS feature, 'numeric' AS kind" for i, n in enumerate(FEATURE_NUMERIC))
    hot = " UNION ALL ".join(f"SELECT {i} AS col, {q(k + '_')} || v AS feature, v FROM (SELECT unnest({k}) AS v FROM c) t"
                             for i, k in enumerate(FEATURE_CATEGORICAL))
    return with_ctes("", "students").rstrip() + _feature_ctes("true") + (
        f"{numeric} UNION ALL SELECT CAST(row_number() OVER (ORDER BY col, v) + {len(FEATURE_NUMERIC) - 1} AS INTEGER), feature, 'onehot' FROM ({hot}) h")


def _rounded_vector(col: str = "features"):
    return F.transform(vector_to_array(col), lambda x: F.round(x, 6)).alias(col)


def _split(spark, sf):
    d = tr.prepare(fx.students(spark, sf))
    return stratified_split(d, "label", "student_id", 0.2, 42, exact=True)


@register("fit_features", _features_sql("true", "true"))
def q_fit_features(spark, sf):
    d = tr.prepare(fx.students(spark, sf))
    m = fe.fit_features(d, ids=(*fe.ID_NAMES, *tr.HELPER_COLS))
    return m.transform(d).select("student_id", _rounded_vector())


@register("transform_features", _features_sql("split = 'train'", "split = 'test'"))
def q_transform_features(spark, sf):
    d = _split(spark, sf)
    m = fe.fit_features(d.filter(F.col("split") == "train"), ids=(*fe.ID_NAMES, *tr.HELPER_COLS))
    test = d.filter(F.col("split") == "test")
    return fe.transform_features(m, test).select("student_id", _rounded_vector())


@register("feature_names", _names_sql())
def q_feature_names(spark, sf):
    d = tr.prepare(fx.students(spark, sf))
    x = fe.fit_features(d, ids=(*fe.ID_NAMES, *tr.HELPER_COLS)).transform(d)
    names = fe.feature_names(x)
    kinds = fe.feature_kinds(x)
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(zip(names, kinds))],
                                 "slot int, feature string, kind string")


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    """Five near neighbours of every vector by hash tables fitted to find 95 in 100 of a sample's nearest."""
    v = fx.vectors(spark, sf)
    args = {"point_id": "vec_id", "features": "embedding"}
    lsh, _ = knn_lsh.fit_lsh(v, k=KNN_K, **args)
    return rounded(knn_lsh.knn_lsh_join(v, v, lsh, k=KNN_K, query_id="vec_id", exclude_self=True, **args))


# --- rows-only ML queries ------------------------------------------------------------------
@register("score_students")
def q_score_students(spark, sf):
    d = _split(spark, sf)
    model = tr.fit_pipeline(d.filter(F.col("split") == "train"), "decision_tree")
    return tr.score_students(model, fx.students(spark, sf))


@register("feature_importance")
def q_feature_importance(spark, sf):
    d = _split(spark, sf)
    train_df = d.filter(F.col("split") == "train")
    model = tr.fit_pipeline(train_df, "random_forest")
    return tr.feature_importance(model, model.transform(train_df))


@register("cross_validate")
def q_cross_validate(spark, sf):
    return tr.cross_validate(tr.prepare(fx.students(spark, sf)), "decision_tree", 5)


@register("tune")
def q_tune(spark, sf):
    d = _split(spark, sf)
    _, res = tr.tune(d.filter(F.col("split") == "train").drop("split"), TUNED_MODEL, 3)
    return res


def _train_query(name):
    def run(spark, sf):
        # cross-validation is its own query (cross_validate); here: split, fit, test metrics
        _, metrics = tr.train(fx.students(spark, sf), name, cv_folds=0)
        return metrics.drop("training_time")

    run.__name__ = f"q_train_{name}"
    return run


for _m in TRAINED_MODELS:
    register(f"train_{_m}")(_train_query(_m))


# --- exact facts of fits, whatever the model learned ----------------------------------------------
@register("score_facts", with_ctes("SELECT student_id, true AS level_fits, true AS prediction_fits, true AS in_range FROM students", "students"))
def q_score_facts(spark, sf):
    """Every student is scored once, with the level of its probability and the likelier class."""
    d = _split(spark, sf)
    model = tr.fit_pipeline(d.filter(F.col("split") == "train"), "decision_tree")
    s = tr.score_students(model, fx.students(spark, sf))
    p = F.col("dropout_probability")
    return s.select("student_id", F.col("risk_level").eqNullSafe(risk_level(p)).alias("level_fits"),
                    (F.col("prediction") == (p > 0.5).cast("int")).alias("prediction_fits"), p.between(0.0, 1.0).alias("in_range"))


@register("train_facts", with_ctes("""
SELECT sum(n - test) AS train_rows, sum(test) AS test_rows, true AS metrics_in_range
FROM (SELECT count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test FROM students GROUP BY dropout) t""", "students"))
def q_train_facts(spark, sf):
    """Row counts of the stratified split behind a fitted model, and metrics within 0 and 1."""
    _, m = tr.train(fx.students(spark, sf), "decision_tree", cv_folds=0)
    ok = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1", "roc_auc"):
        ok = ok & F.col(c).between(0.0, 1.0)
    return m.select("train_rows", "test_rows", ok.alias("metrics_in_range"))


@register("split_scored", with_ctes(f"""
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN row_number() OVER (PARTITION BY dropout ORDER BY {hash_unit_sql('student_id', 42)}, student_id)
                   <= floor(count(*) OVER (PARTITION BY dropout) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM students) t
GROUP BY 1""", "students"))
def q_split_scored(spark, sf):
    """Scored students keep the part of the split they belong to."""
    d = _split(spark, sf)
    model = tr.fit_pipeline(d.filter(F.col("split") == "train"), "decision_tree")
    raw = fx.students(spark, sf).join(d.select("student_id", "split"), "student_id")
    return tr.score_students(model, raw).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- exact splits ----------------------------------------------------------------------------------
SPLIT_COLUMNS = ("age", "gpa", "credits", "absences", "total_classes")
_CELLS = " UNION ALL ".join(f"SELECT {q(c)} AS feature, CAST({c} AS DOUBLE) AS value, CAST(dropout AS DOUBLE) AS y FROM students WHERE {c} IS NOT NULL" for c in SPLIT_COLUMNS)


@register("best_splits", with_ctes("", "students").rstrip() + f""", cells AS ({_CELLS}),
counts AS (SELECT feature, value, count(*) AS w, sum(y) AS y1 FROM cells GROUP BY 1, 2),
sides AS (SELECT feature, value, lead(value) OVER v AS next, sum(w) OVER v AS lw, sum(y1) OVER v AS l1,
                 sum(w) OVER (PARTITION BY feature) AS tw, sum(y1) OVER (PARTITION BY feature) AS t1
          FROM counts WINDOW v AS (PARTITION BY feature ORDER BY value)),
scored AS (SELECT *, round((2 * l1 * (lw - l1) / lw + 2 * (t1 - l1) * ((tw - lw) - (t1 - l1)) / (tw - lw)) / tw, 12) AS gini,
                  (least(l1, lw - l1) + least(t1 - l1, (tw - lw) - (t1 - l1))) / tw AS error FROM sides WHERE next IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gini, value) AS n FROM scored)
SELECT feature, round((value + next) / 2, 6) AS threshold, round(gini, 6) AS gini, round(error, 6) AS error,
       CAST(lw AS DOUBLE) AS left_weight, l1 AS left_ones, CAST(tw - lw AS DOUBLE) AS right_weight, t1 - l1 AS right_ones FROM best WHERE n = 1""")
def q_best_splits(spark, sf):
    """The exact best split of each numeric column of the students."""
    return rounded(best_splits(fx.students(spark, sf), SPLIT_COLUMNS, "dropout"))
