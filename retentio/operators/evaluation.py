"""Evaluation of scored predictions: confusion matrix, class report, curves, AUC, AP.

Inputs are a DataFrame with a 0/1 truth column, a 0/1 predicted class and (for curves)
a score. Every operator is a global aggregate (partial aggregation in each task, a
one-row or per-score final) — no operator collects rows to the driver. Curves aggregate
per distinct score first, then take running sums with :func:`running_sums`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.bins import clean_double
from retentio.operators.running import running_sums


def _counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def _div0(a: Column, b: Column) -> Column:
    """a / b with a zero (or null) denominator giving 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """2x2 matrix as rows (y_true, y_pred, n) with the row-normalised share; empty cells are 0."""
    c = _counts(df, label, pred)
    cells = F.array(
        F.struct(F.lit(0).alias("y_true"), F.lit(0).alias("y_pred"), F.col("tn").alias("n"), (F.col("tn") + F.col("fp")).alias("_row")),
        F.struct(F.lit(0).alias("y_true"), F.lit(1).alias("y_pred"), F.col("fp").alias("n"), (F.col("tn") + F.col("fp")).alias("_row")),
        F.struct(F.lit(1).alias("y_true"), F.lit(0).alias("y_pred"), F.col("fn").alias("n"), (F.col("fn") + F.col("tp")).alias("_row")),
        F.struct(F.lit(1).alias("y_true"), F.lit(1).alias("y_pred"), F.col("tp").alias("n"), (F.col("fn") + F.col("tp")).alias("_row")),
    )
    return c.select(F.inline(cells)).select("y_true", "y_pred", "n", F.try_divide(F.col("n").cast("double"), F.col("_row")).alias("row_share"))


def binary_metrics(df: DataFrame, label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row: accuracy, precision, recall, f1 of the positive class (0 on a zero denominator)."""
    c = _counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    return c.select(
        _div0(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + tn + fp + fn).alias("n"))


def classification_report(df: DataFrame, label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Per-class precision / recall / f1 / support, accuracy, macro and weighted averages."""
    c = _counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    s0, s1 = (tn + fp), (tp + fn)
    tot = s0 + s1
    acc = _div0(tp + tn, tot)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        s.cast("bigint").alias("support"))

    def wavg(a, b):
        return _div0(a * s0 + b * s1, tot)

    none = F.lit(None).cast("double")
    cells = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", none, none, acc, tot),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), tot),
    )
    return c.select(F.inline(cells))


def score_counts(df: DataFrame, label: str = "y_true", score: str = "score") -> DataFrame:
    """(score, pos, neg): positives and negatives per distinct non-null score.

    Every curve and area below is computed from this table, which has at most one row per
    distinct score (partial aggregation in each task before the shuffle). Pass it to the
    ``*_from_counts`` forms to derive several results from one scan of the scored rows.
    """
    y = F.col(label).cast("int")
    return (df.select(clean_double(score).alias("score"), y.alias("_y")).filter(F.col("score").isNotNull())
            .groupBy("score").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")))


def _running(counts: DataFrame) -> DataFrame:
    """Running positives / negatives / points in descending score order (``cum_pos``, ``cum_neg``, ``cum__one``)."""
    return running_sums(counts.withColumn("_one", F.lit(1)), "score", ["pos", "neg", "_one"], descending=True)


def score_table(df: DataFrame, label: str = "y_true", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score, with running totals in descending score order."""
    return _running(score_counts(df, label, score))


def _totals(counts: DataFrame) -> tuple[Column, Column]:
    # one scalar subquery over the per-score table (not another scan of the scored rows)
    tot = counts.agg(F.struct(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"),
                              F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))).scalar()
    return tot.getField("P"), tot.getField("N")


def roc_curve_from_counts(counts: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    """:func:`roc_curve` from a :func:`score_counts` table."""
    t = _running(counts)
    P, N = _totals(counts)
    if drop_intermediate:
        nxt = t.select((F.col("cum__one") - 1).alias("cum__one"), F.col("pos").alias("_npos"), F.col("neg").alias("_nneg"))
        last = counts.agg(F.count(F.lit(1))).scalar()
        t = t.join(nxt, "cum__one", "left").filter(
            (F.col("cum__one") == 1) | (F.col("cum__one") == last)
            | (F.col("_npos") != F.col("pos")) | (F.col("_nneg") != F.col("neg")))
    pts = t.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))
    origin = counts.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                                 F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"))
    allp = pts.unionByName(origin)
    return allp.select("threshold", "tps", "fps",
                       F.try_divide(F.col("fps").cast("double"), N.cast("double")).alias("fpr"),
                       F.try_divide(F.col("tps").cast("double"), P.cast("double")).alias("tpr"))


def roc_curve(df: DataFrame, label: str = "y_true", score: str = "score", drop_intermediate: bool = False) -> DataFrame:
    """ROC points at the distinct scores (descending), plus the origin with a null threshold.

    ``drop_intermediate`` drops a point whose next point adds the same numbers of positives
    and negatives (it lies on a straight segment): the library's default curve. The next
    point is found by an equi-join on the point's rank (ranks from :func:`running_sums`),
    not by an ordered window.
    """
    return roc_curve_from_counts(score_counts(df, label, score), drop_intermediate)


def roc_auc_from_counts(counts: DataFrame) -> DataFrame:
    """:func:`roc_auc` from a :func:`score_counts` table."""
    t = _running(counts)
    # products of counts leave the range of a long at a few billion rows: exact decimals
    big = lambda c: F.col(c).cast("decimal(19,0)")
    a = t.agg(F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"),
              F.sum((big("pos") * big("cum_neg")).cast("decimal(38,0)")).alias("pc"),
              F.sum((big("pos") * big("neg")).cast("decimal(38,0)")).alias("pn"))
    pn = F.col("P") * F.col("N")
    return a.select(F.try_divide(pn - F.col("pc").cast("double") + F.col("pn").cast("double") * 0.5, pn).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve as one row ``roc_auc`` (ties count one half).

    AUC = sum over scores of pos * (#neg with a lower score + neg / 2) / (P * N), and
    #neg lower = N - running negatives, so one aggregate over the score table suffices.
    """
    return roc_auc_from_counts(score_counts(df, label, score))


def pr_curve_from_counts(counts: DataFrame) -> DataFrame:
    """:func:`pr_curve` from a :func:`score_counts` table."""
    t = _running(counts)
    P, _ = _totals(counts)
    pts = t.select(
        F.col("score").alias("threshold"),
        _div0(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.coalesce(F.try_divide(F.col("cum_pos").cast("double"), P.cast("double")), F.lit(1.0)).alias("recall"))
    end = counts.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def pr_curve(df: DataFrame, label: str = "y_true", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score, plus the end point (precision 1, recall 0)."""
    return pr_curve_from_counts(score_counts(df, label, score))


def average_precision_from_counts(counts: DataFrame) -> DataFrame:
    """:func:`average_precision` from a :func:`score_counts` table."""
    t = _running(counts)
    prec = _div0(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    a = t.agg(F.sum(F.col("pos") * prec).alias("_num"), F.sum("pos").alias("_P"))
    return a.select(F.try_divide(F.col("_num"), F.col("_P").cast("double")).alias("average_precision"))


def average_precision(df: DataFrame, label: str = "y_true", score: str = "score") -> DataFrame:
    """Average precision = sum over thresholds of (recall step) x precision, as one row."""
    return average_precision_from_counts(score_counts(df, label, score))


def _scalar_stats(base: DataFrame, **aggs: Column) -> dict[str, Column]:
    """Several one-row statistics as fields of ONE struct-valued scalar subquery.

    Each ``.scalar()`` is its own subquery (its own scan of ``base``); packing the
    statistics into one struct and reading its fields keeps it to one scan however often
    the values are used in the outer plan.
    """
    st = base.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("_st")).scalar()
    return {k: st.getField(k) for k in aggs}


def probability_histogram(df: DataFrame, col: str = "dropout_probability", bins: int = 20) -> DataFrame:
    """Equal-width histogram between the column's min and max; every bin present (0 if empty)."""
    x = clean_double(col)
    base = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    st = _scalar_stats(base, mn=F.min("_x"), mx=F.max("_x"))
    mn, mx = st["mn"], st["mx"]
    width = mx - mn
    idx = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide((F.col("_x") - mn) * F.lit(float(bins)), width)), F.lit(0)))
    b = base.select(idx.cast("int").alias("_b"))
    # the bounds travel with the counts row, so the output needs no second look at them
    row = b.agg(*[F.count_if(F.col("_b") == i).alias(f"_n{i}") for i in range(bins)])
    cells = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"_n{i}").alias("n")) for i in range(bins)])
    out = row.select(F.inline(cells), mn.alias("_mn"), width.alias("_w"))
    return out.select("bin", (F.col("_mn") + F.col("_w") * F.col("bin") / F.lit(float(bins))).alias("bin_start"),
                      (F.col("_mn") + F.col("_w") * (F.col("bin") + 1) / F.lit(float(bins))).alias("bin_end"), "n")


def probability_density(df: DataFrame, col: str = "dropout_probability", grid: int = 200) -> DataFrame:
    """Gaussian kernel density on ``grid`` evenly spaced points from min to max.

    Bandwidth is Scott's rule on the sample std (h = std * n^(-1/5)). Rows are first
    reduced to (distinct value, count); each distinct value then adds its kernel to every
    grid point and the per-point sums are partially aggregated in each task, so only
    ``grid`` rows per task are shuffled. min, max, n and std come from one scalar subquery.
    """
    x = clean_double(col)
    base = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    vals = base.groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
    st = _scalar_stats(base, mn=F.min("_x"), mx=F.max("_x"), n=F.count(F.lit(1)), sd=F.stddev_samp("_x"))
    # the statistics enter the plan once, as columns, and are reused from there
    s = vals.select("_x", "_c", st["mn"].alias("_mn"), st["mx"].alias("_mx"), st["n"].alias("_n"), st["sd"].alias("_sd"))
    s = s.select("_x", "_c", "_mn", "_n",
                 F.coalesce(F.try_divide(F.col("_mx") - F.col("_mn"), F.lit(float(grid - 1))), F.lit(0.0)).alias("_step"),
                 (F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"))
    pts = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid_index"))
    gx = F.col("_mn") + F.col("_step") * F.col("grid_index")
    z = (gx - F.col("_x")) / F.col("_h")
    k = F.col("_c") * F.exp(F.lit(-0.5) * z * z)
    dens = pts.groupBy("grid_index").agg(F.sum(k).alias("_s"), F.first(gx).alias("x"),
                                         F.first(F.col("_n").cast("double") * F.col("_h")).alias("_nh"))
    norm = F.col("_nh") * F.lit((2 * 3.141592653589793) ** 0.5)
    return dens.select("grid_index", "x", (F.col("_s") / norm).alias("density"))
