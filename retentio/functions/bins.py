"""Right-closed binning and small feature formulas as Column expressions.

All bins follow the interval convention ``(lo, hi]``: the lowest edge is excluded unless
``include_lowest`` is set, so a probability of exactly 0 has no level and a change of
exactly -1 has no category. Values outside every bin, nulls and NaN give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (labels must equal the reference's output text) --------------------
# risk levels, in order low, medium, high
RISK_LEVELS = ("Низкий", "Средний", "Высокий")
RISK_EDGES = (0.0, 0.3, 0.6, 1.0)
# five-way change categories for the edges below
CHANGE_CATEGORIES = (
    "Значительное улучшение",
    "Улучшение",
    "Без изменений",
    "Ухудшение",
    "Значительное ухудшение",
)
CHANGE_EDGES = (-1.0, -0.2, -0.05, 0.05, 0.2, 1.0)
# three-way change classes of the comparative report: improved, unchanged, worsened
CHANGE_CLASSES = ("Улучшение", "Без изменений", "Ухудшение")
CHANGE_CLASS_BAND = 0.05
# age groups
AGE_GROUPS = ("under_18", "18-21", "22-25", "26-30", "over_30")
AGE_EDGES = (0.0, 18.0, 21.0, 25.0, 30.0, 100.0)
LOW_PERFORMANCE_GPA = 3.0
EXTREME_RISK = 0.8
# --------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c) -> Column:
    """NaN -> null, so averages skip it and comparisons cannot place it in the top bin."""
    c = _col(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def right_closed_bins(c, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the ``(edges[i], edges[i+1]]`` interval containing ``c``; null elsewhere."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    x = clean_double(c)
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def bin_rank(c, labels: Sequence[str]) -> Column:
    """1-based position of a label in ``labels`` (null for null / unknown)."""
    c = _col(c)
    expr = None
    for i, lab in enumerate(labels):
        cond = c == F.lit(lab)
        expr = F.when(cond, F.lit(i + 1)) if expr is None else expr.when(cond, F.lit(i + 1))
    return expr


def risk_level(prob, labels: Sequence[str] = RISK_LEVELS, include_lowest: bool = False) -> Column:
    """Risk level of a dropout probability: (0,0.3] low, (0.3,0.6] medium, (0.6,1] high."""
    return right_closed_bins(prob, RISK_EDGES, labels, include_lowest)


def risk_rank(level, labels: Sequence[str] = RISK_LEVELS) -> Column:
    return bin_rank(level, labels)


def change_category(change, labels: Sequence[str] = CHANGE_CATEGORIES, include_lowest: bool = False) -> Column:
    """Five-way category of a probability change, edges -1,-0.2,-0.05,0.05,0.2,1."""
    return right_closed_bins(change, CHANGE_EDGES, labels, include_lowest)


def change_class3(change, labels: Sequence[str] = CHANGE_CLASSES, band: float = CHANGE_CLASS_BAND) -> Column:
    """Three-way class: change < -band improved, > band worsened, anything else unchanged.

    Differs from :func:`change_category` at exactly -0.05 (unchanged here, improved there).
    """
    x = clean_double(change)
    return (F.when(x < F.lit(-band), F.lit(labels[0]))
            .when(x > F.lit(band), F.lit(labels[2]))
            .otherwise(F.lit(labels[1])))


def age_group(age, labels: Sequence[str] = AGE_GROUPS) -> Column:
    return right_closed_bins(age, AGE_EDGES, labels)


def low_performance(gpa, cutoff: float = LOW_PERFORMANCE_GPA) -> Column:
    """1 when gpa < cutoff, else 0; a missing gpa counts as 0."""
    return F.coalesce((_col(gpa).cast("double") < F.lit(cutoff)).cast("int"), F.lit(0))


def absence_rate(absences, total_classes) -> Column:
    """absences / total_classes; a zero or null divisor gives null (never an ANSI error)."""
    return F.try_divide(_col(absences).cast("double"), _col(total_classes).cast("double"))


def faculty_year(faculty, year) -> Column:
    """faculty + '_' + year; null when either side is null."""
    return F.concat(_col(faculty), F.lit("_"), _col(year).cast("string"))
