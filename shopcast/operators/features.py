"""Feature preparation FE1-FE7 as Spark ML stages.

Statistics are fitted on the training rows only and kept as model state:

* median (FE2) is exact and distributed: the two middle order statistics out
  of a counted bracket (Spark's exact ``median`` gathers a whole column in one
  buffer, ``percentile_approx`` is the cheaper option at scale);
* most frequent value (FE3): group counts, ties -> smallest value;
* standard scaling (FE4): mean and *population* std, zero std -> 1;
* one-hot (FE5): ``StringIndexer(handleInvalid="keep")`` + ``OneHotEncoder``
  with the last (unknown) slot dropped, so unknown and null are all zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.operators.ordering import running_totals

MAX_CATEGORIES = 10_000


def number(c: Column) -> Column:
    """A numeric or boolean column as double, NaN as null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def split_by_type(schema: T.StructType, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """FE1: numeric (numbers and booleans) vs categorical (strings); others rejected."""
    num, cat = [], []
    for f in schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        else:
            raise TypeError(f"column {f.name} has unsupported type {f.dataType.simpleString()}")
    return num, cat


def exact_medians(df: DataFrame, cols: Sequence[str], slack: float = 3e-3) -> list[float | None]:
    """Exact medians (two middle values, interpolated) of several columns; nulls and NaN ignored.

    ``df`` should be materialised: one aggregation finds columns of one value, one brackets the middle of every other,
    one counts the values below and up to the brackets (a bracket of one value is the median), and the last
    counts the values inside.  A bracket that misses is widened, so the result is exact.
    """
    if not cols:
        return []
    own = df.select([number(F.col(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    every = range(len(cols))
    row = own.agg(*[a for i in every for a in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"z{i}"))]).first()
    n = [row[f"n{i}"] for i in every]
    out: dict[int, float | None] = {i: row[f"a{i}"] for i in every if row[f"a{i}"] == row[f"z{i}"]}
    while len(out) < len(cols):
        left = [i for i in every if i not in out]
        whole = [i for i in left if n[i] * slack < 3 or slack >= 0.5]      # a bracket of a few ranks would miss by rounding
        part = [i for i in left if i not in whole]
        ends, reach = {i: (row[f"a{i}"], row[f"z{i}"]) for i in whole}, {i: (0, n[i]) for i in whole}
        if part:
            sides = F.array(F.lit(0.5 - slack), F.lit(0.5 + slack))
            found = own.agg(*[F.percentile_approx(f"v{i}", sides, 1000).alias(f"q{i}") for i in part]).first()
            ends |= {i: tuple(found[f"q{i}"]) for i in part}
            sums = own.agg(*[a for i in part for a in (F.count_if(F.col(f"v{i}") < ends[i][0]).alias(f"b{i}"),
                                                       F.count_if(F.col(f"v{i}") <= ends[i][1]).alias(f"u{i}"))]).first()
            reach |= {i: (sums[f"b{i}"], sums[f"u{i}"]) for i in part}
        middles = {i: ((n[i] - 1) // 2, n[i] // 2) for i in left}
        hit = [i for i in left if reach[i][0] <= middles[i][0] and middles[i][1] < reach[i][1]]
        out |= {i: ends[i][0] for i in hit if ends[i][0] == ends[i][1]}
        out |= _inside(own, {i: (*ends[i], *(m - reach[i][0] for m in middles[i])) for i in hit if i not in out})
        slack *= 16
    return [out[i] for i in every]


def _inside(own: DataFrame, brackets: dict[int, tuple[float, float, int, int]]) -> dict[int, float]:
    """Mean of the values at two positions of each column's bracket (least, greatest, positions from 0 inside it)."""
    if not brackets:
        return {}
    held = F.array(*[F.when(F.col(f"v{i}").between(lo, hi), F.struct(F.lit(i).alias("f"), F.col(f"v{i}").alias("v")))
                     for i, (lo, hi, _, _) in brackets.items()])
    counts = (own.select(F.explode(F.array_compact(held)).alias("x")).groupBy("x.f", "x.v").agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counts, "v", ["n"], classes=["f"])

    def at(which: int) -> Column:
        place = reduce(lambda c, i: c.when(F.col("f") == i, brackets[i][which]), list(brackets)[1:],
                       F.when(F.col("f") == next(iter(brackets)), brackets[next(iter(brackets))][which]))
        return F.min(F.when(F.col("cum_n") > place, F.col("v")))
    return {r["f"]: (r["a"] + r["b"]) / 2.0 for r in ranked.groupBy("f").agg(at(2).alias("a"), at(3).alias("b")).collect()}  # a row per column


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median of one column, see ``exact_medians``."""
    return exact_medians(df, [col])[0]


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value; ties -> the smallest value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).first()
    return row["m"]


def mode_values(df: DataFrame, cols: Sequence[str]) -> list:
    """``mode_value`` of each column; all text columns together in one pass over (column number, value) counts."""
    texts = [i for i, c in enumerate(cols) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return [mode_value(df, c) for c in cols]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(cols[i]).alias("v")) for i in texts]))
    counts = df.select(pairs.alias("x")).filter("x.v is not null").groupBy("x.f", "x.v").agg(F.count(F.lit(1)).alias("n"))
    found = {r["f"]: r["m"] for r in counts.groupBy("f").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).collect()}  # a row per column
    return [found.get(i) if i in texts else mode_value(df, c) for i, c in enumerate(cols)]


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of each column in one aggregation pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (m if m is not None else 0.0, s if s else 1.0)
    return out


class _ValuesParams(HasInputCols):
    values = Param(Params._dummy(), "values", "fitted value per input column", TypeConverters.toList)


class ImputerModel(Model, _ValuesParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Text columns keep their type; all others come out as double, with NaN imputed like null."""
        cols, vals = self.getInputCols(), self.getOrDefault(self.values)
        own = {c: F.col(c) if isinstance(df.schema[c].dataType, T.StringType) else number(F.col(c)) for c in cols}
        return df.withColumns({c: own[c] if v is None else F.coalesce(own[c], F.lit(v)) for c, v in zip(cols, vals)})


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """FE2 as an Estimator.

    ``approxAccuracy`` = 0 (default) fits exact medians; a positive value uses
    ``percentile_approx`` with that accuracy, one aggregation for all columns.
    """

    approxAccuracy = Param(Params._dummy(), "approxAccuracy",
                           "0 = exact median; > 0 = percentile_approx accuracy", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, approxAccuracy=0):
        super().__init__()
        self._setDefault(approxAccuracy=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ImputerModel:
        cols = self.getInputCols()
        acc = self.getOrDefault(self.approxAccuracy)
        if acc > 0:
            row = df.agg(*[F.percentile_approx(number(F.col(c)), 0.5, acc).alias(c) for c in cols]).first()
            return ImputerModel(inputCols=cols, values=[row[c] for c in cols])
        return ImputerModel(inputCols=cols, values=exact_medians(df, cols))


class ModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """FE3 as an Estimator."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ImputerModel:
        cols = self.getInputCols()
        return ImputerModel(inputCols=cols, values=mode_values(df, cols))


class _ScalerParams(HasInputCols):
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", TypeConverters.toListFloat)


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        ms, ss = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, ms, ss)})


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """FE4 as an Estimator (``ml.StandardScaler`` divides by the sample std)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        mom = moments(df, cols)
        return PopulationScalerModel(inputCols=cols, means=[mom[c][0] for c in cols],
                                     stds=[mom[c][1] for c in cols])


def one_hot_columns(df: DataFrame, col: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """FE5 as plain 0/1 columns for known categories; unknown and null -> all zeros."""
    p = prefix or col
    return df.withColumns({f"{p}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
                           for v in categories})


def fitted_categories(train: DataFrame, col: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """Sorted distinct categories of the training rows; refuses more than ``limit`` (columns, not rows)."""
    d = train.select(F.col(col).cast("string").alias(col)).filter(F.col(col).isNotNull()).distinct()
    n = d.count()
    if n > limit:
        raise ValueError(f"{col} has {n} categories (> {limit}); use hashing instead of one-hot columns")
    return sorted(r[0] for r in d.collect())


def wide_categories(train: DataFrame, cat_cols: Sequence[str], limit: int = MAX_CATEGORIES) -> list[str]:
    """Columns with about more than ``limit`` categories: an index of them would live on the driver, so they must be hashed."""
    if not cat_cols:
        return []
    row = train.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cat_cols]).first()
    return [c for c in cat_cols if row[c] > 0.9 * limit]


def column_transformer(num_cols: Sequence[str], cat_cols: Sequence[str], out: str = "features",
                       hashed: Sequence[str] = (), hash_size: int = 1 << 18) -> Pipeline:
    """FE6: numeric (median -> scale) + categorical (mode -> one-hot) -> one vector; rest dropped.

    ``hashed`` names text columns (see ``wide_categories``) that are hashed
    into ``hash_size`` slots instead of indexed.
    """
    cat_cols = [c for c in cat_cols if c not in set(hashed)]
    stages = []
    if num_cols:
        stages += [MedianImputer(inputCols=list(num_cols)), PopulationScaler(inputCols=list(num_cols))]
    ohe_cols = []
    if cat_cols:
        stages.append(ModeImputer(inputCols=list(cat_cols)))
        idx = [f"{c}__idx" for c in cat_cols]
        ohe_cols = [f"{c}__ohe" for c in cat_cols]
        stages.append(StringIndexer(inputCols=list(cat_cols), outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe_cols, dropLast=True))
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol=f"{out}__hashed", numFeatures=hash_size))
        ohe_cols.append(f"{out}__hashed")
    stages.append(VectorAssembler(inputCols=[*num_cols, *ohe_cols], outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)
