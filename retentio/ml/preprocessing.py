"""Feature-pipeline Estimators: exact median impute + population-std scaling, mode impute.

Medians and modes are computed with the distributed exact operators of
:mod:`retentio.operators.running` (the built-in ``median``/``mode`` aggregates merge every
distinct value of a column into one task).

Spark's ``Imputer(strategy='median')`` is approximate and ``StandardScaler`` divides by the
sample std; the reference semantics are the exact median and the population std, with
the scaler fitted on the *imputed* column. Fitting runs two aggregate jobs (medians, then
mean/std of the imputed values) and brings back one row of statistics; transform is a
pure column expression. ``relativeError > 0`` switches the median to ``percentile_approx``
for very high-cardinality columns at scale.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.running import exact_modes, exact_quantiles


class _StatsParams(HasInputCols, HasOutputCols):
    relativeError = Param(Params._dummy(), "relativeError", "0 = exact median, > 0 = approximate",
                          typeConverter=TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(relativeError=0.0)


class MedianStandardScaler(Estimator, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Impute nulls with the exact median, then standardise with mean / population std."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, relativeError=0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCols=None, outputCols=None, relativeError=0.0):
        return self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MedianStandardScalerModel":
        cols = self.getInputCols()
        rel = self.getOrDefault(self.relativeError)
        x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
        if rel > 0:
            acc = int(max(1, round(1.0 / rel)))
            mrow = df.agg(*[F.percentile_approx(x[c], 0.5, acc).alias(c) for c in cols]).first().asDict()
        else:
            # exact and distributed: no task holds all distinct values of a column
            mrow = {r["column_name"]: r["quantile"] for r in exact_quantiles(df, cols, 0.5).collect()}
        med = [float(mrow[c]) if mrow.get(c) is not None else 0.0 for c in cols]
        imp = {c: F.coalesce(x[c], F.lit(m)) for c, m in zip(cols, med)}
        srow = df.agg(*[F.avg(imp[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                      *[F.stddev_pop(imp[c]).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(srow[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(srow[f"s{i}"] or 0.0) for i in range(len(cols))]
        model = MedianStandardScalerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                          medians=med, means=means, stds=stds)
        return self._copyValues(model)


class MedianStandardScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", typeConverter=TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "fitted means of the imputed columns", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds of the imputed columns",
                 typeConverter=TypeConverters.toListFloat)
    relativeError = _StatsParams.relativeError

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, medians=None, means=None, stds=None, relativeError=0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        outs = self.getOutputCols()
        med, mean, std = (self.getOrDefault(p) for p in (self.medians, self.means, self.stds))
        exprs = {}
        for c, o, m, mu, sd in zip(cols, outs, med, mean, std):
            x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m))
            # zero variance: scale 1, as the library does, so the column becomes 0
            exprs[o] = (x - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0)
        return df.withColumns(exprs)


class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replace nulls of string columns with the most frequent value (ties -> smallest)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        cols = self.getInputCols()
        row = {r["column_name"]: r["mode"] for r in exact_modes(df, cols).collect()}
        modes = [row.get(c) if row.get(c) is not None else "" for c in cols]
        return self._copyValues(ModeImputerModel(inputCols=cols, outputCols=self.getOutputCols(), modes=modes))


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    modes = Param(Params._dummy(), "modes", "fitted modes", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        modes = self.getOrDefault(self.modes)
        return df.withColumns({o: F.coalesce(F.col(c).cast("string"), F.lit(m))
                               for c, o, m in zip(self.getInputCols(), self.getOutputCols(), modes)})
