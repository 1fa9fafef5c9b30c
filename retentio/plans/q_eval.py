"""Registered evaluation queries over the scored labels and the risk history."""

from __future__ import annotations

from retentio.operators import evaluation as ev
from retentio.plans.oracle import with_ctes
from retentio.plans.queries import register, rounded
from retentio.sources import fixtures as fx

_C = """(SELECT count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
        count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn FROM scored_labels) c"""


def z(num: str, den: str) -> str:
    """num / den with 0 for a zero denominator (SQL)."""
    return f"CASE WHEN ({den}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / ({den}) END"


@register("confusion_matrix", with_ctes(f"""
SELECT y_true, y_pred, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / nullif(r, 0), 6) AS row_share FROM (
  SELECT 0 AS y_true, 0 AS y_pred, tn AS n, tn + fp AS r FROM {_C} UNION ALL
  SELECT 0, 1, fp, tn + fp FROM {_C} UNION ALL
  SELECT 1, 0, fn, fn + tp FROM {_C} UNION ALL
  SELECT 1, 1, tp, fn + tp FROM {_C}) m""", "scored_labels"))
def q_confusion_matrix(spark, sf):
    return rounded(ev.confusion_matrix(fx.scored_labels(spark, sf)))


@register("binary_metrics", with_ctes(f"""
SELECT round({z('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({z('tp', 'tp + fp')}, 6) AS precision,
       round({z('tp', 'tp + fn')}, 6) AS recall, round({z('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
       CAST(tp + tn + fp + fn AS BIGINT) AS n
FROM {_C}""", "scored_labels"))
def q_binary_metrics(spark, sf):
    return rounded(ev.binary_metrics(fx.scored_labels(spark, sf)))


_P0, _R0, _F0 = z("tn", "tn + fn"), z("tn", "tn + fp"), z("2 * tn", "2 * tn + fn + fp")
_P1, _R1, _F1 = z("tp", "tp + fp"), z("tp", "tp + fn"), z("2 * tp", "2 * tp + fp + fn")


def _w(a: str, b: str) -> str:
    return z(f"({a}) * (tn + fp) + ({b}) * (tp + fn)", "tn + fp + tp + fn")


@register("classification_report", with_ctes(f"""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS label, {_P0} AS precision, {_R0} AS recall, {_F0} AS f1_score, tn + fp AS support FROM {_C} UNION ALL
  SELECT '1', {_P1}, {_R1}, {_F1}, tp + fn FROM {_C} UNION ALL
  SELECT 'accuracy', NULL, NULL, {z('tp + tn', 'tp + tn + fp + fn')}, tp + tn + fp + fn FROM {_C} UNION ALL
  SELECT 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2, tp + tn + fp + fn FROM {_C} UNION ALL
  SELECT 'weighted avg', {_w(_P0, _P1)}, {_w(_R0, _R1)}, {_w(_F0, _F1)}, tp + tn + fp + fn FROM {_C}) r""",
    "scored_labels"))
def q_classification_report(spark, sf):
    return rounded(ev.classification_report(fx.scored_labels(spark, sf)))


_CUM = """(SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg
  FROM (SELECT score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM scored_labels GROUP BY score) a) t"""
_PN = "(SELECT count_if(y_true = 1) AS P, count_if(y_true = 0) AS N FROM scored_labels) pn"


@register("roc_curve", with_ctes(f"""
SELECT round(score, 6) AS threshold, CAST(cum_pos AS BIGINT) AS tps, CAST(cum_neg AS BIGINT) AS fps,
       round(CAST(cum_neg AS DOUBLE) / N, 6) AS fpr, round(CAST(cum_pos AS DOUBLE) / P, 6) AS tpr
FROM {_CUM}, {_PN}
UNION ALL SELECT CAST(NULL AS DOUBLE), 0, 0, 0.0, 0.0""", "scored_labels"))
def q_roc_curve(spark, sf):
    return rounded(ev.roc_curve(fx.scored_labels(spark, sf)))


@register("roc_curve_dropped", with_ctes(f"""
SELECT round(score, 6) AS threshold, CAST(cum_pos AS BIGINT) AS tps, CAST(cum_neg AS BIGINT) AS fps,
       round(CAST(cum_neg AS DOUBLE) / N, 6) AS fpr, round(CAST(cum_pos AS DOUBLE) / P, 6) AS tpr
FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS cnt,
             lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg
      FROM {_CUM.replace(') t', ') t0')}) t, {_PN}
WHERE rn = 1 OR rn = cnt OR npos <> pos OR nneg <> neg
UNION ALL SELECT CAST(NULL AS DOUBLE), 0, 0, 0.0, 0.0""", "scored_labels"))
def q_roc_curve_dropped(spark, sf):
    return rounded(ev.roc_curve(fx.scored_labels(spark, sf), drop_intermediate=True))


@register("roc_auc", with_ctes(f"""
SELECT round((CAST(sum(pos) * sum(neg) AS DOUBLE) - sum(pos * cum_neg) + sum(pos * neg) * 0.5)
             / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS roc_auc FROM {_CUM}""", "scored_labels"))
def q_roc_auc(spark, sf):
    return rounded(ev.roc_auc(fx.scored_labels(spark, sf)))


@register("pr_curve", with_ctes(f"""
SELECT round(score, 6) AS threshold, round({z('cum_pos', 'cum_pos + cum_neg')}, 6) AS precision,
       round(CASE WHEN P = 0 THEN 1.0 ELSE CAST(cum_pos AS DOUBLE) / P END, 6) AS recall
FROM {_CUM}, {_PN}
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0""", "scored_labels"))
def q_pr_curve(spark, sf):
    return rounded(ev.pr_curve(fx.scored_labels(spark, sf)))


@register("average_precision", with_ctes(f"""
SELECT round(sum(pos * {z('cum_pos', 'cum_pos + cum_neg')}) / sum(pos), 6) AS average_precision FROM {_CUM}""",
    "scored_labels"))
def q_average_precision(spark, sf):
    return rounded(ev.average_precision(fx.scored_labels(spark, sf)))


_B = "(SELECT dropout_probability AS x FROM risk_history WHERE dropout_probability IS NOT NULL)"
_S = f"(SELECT min(x) AS mn, max(x) AS mx, count(*) AS n, stddev_samp(x) AS sd FROM {_B} b0) s"


@register("probability_histogram", with_ctes(f"""
SELECT CAST(g.bin AS INTEGER) AS bin, round(mn + (mx - mn) * g.bin / 20.0, 6) AS bin_start,
       round(mn + (mx - mn) * (g.bin + 1) / 20.0, 6) AS bin_end, CAST(count(h.b) AS BIGINT) AS n
FROM (SELECT range AS bin FROM range(20)) g CROSS JOIN {_S}
LEFT JOIN (SELECT least(19, CASE WHEN mx = mn THEN 0 ELSE floor((x - mn) * 20.0 / (mx - mn)) END) AS b
           FROM {_B} b1, {_S.replace(' s', ' s2').replace('s2', 's')}) h ON h.b = g.bin
GROUP BY g.bin, mn, mx""", "risk_history"))
def q_probability_histogram(spark, sf):
    return rounded(ev.probability_histogram(fx.risk_history(spark, sf), "dropout_probability", 20))


_SQRT_2PI = repr((2 * 3.141592653589793) ** 0.5)


@register("probability_density", with_ctes(f"""
SELECT CAST(i AS INTEGER) AS grid_index, round(mn + ((mx - mn) / 199.0) * i, 6) AS x,
       round(sum(c * exp(-0.5 * zz * zz)) / (n * h * {_SQRT_2PI}), 6) AS density
FROM (SELECT g.range AS i, v.c, s.mn, s.mx, s.n, s.sd * pow(CAST(s.n AS DOUBLE), -0.2) AS h,
             ((s.mn + ((s.mx - s.mn) / 199.0) * g.range) - v.x) / (s.sd * pow(CAST(s.n AS DOUBLE), -0.2)) AS zz
      FROM range(200) g, (SELECT x, count(*) AS c FROM {_B} b2 GROUP BY x) v, {_S}) k
GROUP BY i, mn, mx, n, h""", "risk_history"))
def q_probability_density(spark, sf):
    return rounded(ev.probability_density(fx.risk_history(spark, sf), "dropout_probability", 200))
