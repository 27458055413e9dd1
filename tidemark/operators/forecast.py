"""Detector 1: a forecaster on lagged values, fitted per series.

Least squares from additive sums: every task reduces its rows to sums of
products, the sums meet per series, and only those few numbers are solved. One
huge series costs no more memory than a small one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import HotSeries, attach_stats, join_on, with_position, with_window
from tidemark.spec import SeriesSpec

ZERO_ACTUAL = 1000000.0


@dataclass(frozen=True)
class ForecastParams:
    lag: int = 2
    lahead: int = 2
    tsteps: int = 2
    batch_size: int = 16
    split_ratio: float = 0.8
    horizon: int = 0

    @property
    def shift(self) -> int:
        return int(self.lahead / self.lag) if self.lahead > 1 else 0

    @property
    def warmup(self) -> int:
        return max(self.tsteps, self.lahead) - 1

    @property
    def reach(self) -> int:
        return max(self.tsteps - 1, (self.lag - 1) * max(self.shift, 1) + self.horizon)


def is_normalized(df: DataFrame, feature: str) -> DataFrame:
    """One row: whether the feature already lies in 0..1."""
    low, high = F.min(feature), F.max(feature)
    inside = (low >= 0) & (low < 1) & (high > 0) & (high <= 1)
    return df.agg(F.coalesce(inside, F.lit(False)).alias("normalized"))


def scale_bounds(df: DataFrame, spec: SeriesSpec, normalized: bool = False) -> DataFrame:
    """Per series the bounds of min-max scaling; 0 and 1 for a normalised feature."""
    low = F.lit(0.0) if normalized else F.min(spec.feature)
    high = F.lit(1.0) if normalized else F.max(spec.feature)
    return df.groupBy(*spec.groups).agg(low.alias("scale_min"), high.alias("scale_max"))


def scale(df: DataFrame, bounds: DataFrame, spec: SeriesSpec, name: str) -> DataFrame:
    """Min-max scale by the given bounds; a constant series becomes 0."""
    return join_on(df, bounds, spec.groups).withColumn(name, scaled(F.col(spec.feature)))


def scaled(value: Column) -> Column:
    width = F.col("scale_max") - F.col("scale_min")
    return F.when(width == 0, F.lit(0.0)).otherwise((value - F.col("scale_min")) / width)


def unscaled(value: Column) -> Column:
    return value * (F.col("scale_max") - F.col("scale_min")) + F.col("scale_min")


def minmax_scale(df: DataFrame, spec: SeriesSpec, name: str | None = None,
                 normalized: bool = False) -> DataFrame:
    return scale(df, scale_bounds(df, spec, normalized), spec, name or spec.feature + "_norm")


def _moving_average(w, value: str, tsteps: int) -> Column:
    frame = w.rowsBetween(-(tsteps - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) >= tsteps, F.avg(value).over(frame))


def _lags(w, value: str, p: ForecastParams) -> Column:
    if p.horizon:
        offsets = [p.horizon + i * max(p.shift, 1) for i in range(p.lag)]
    else:
        offsets = [i * p.shift for i in range(p.lag)]
    return F.array(*[F.lag(value, o).over(w) if o else F.col(value) for o in offsets])


def moving_average(df: DataFrame, spec: SeriesSpec, tsteps: int = 2, name: str = "moving_average",
                   hot: HotSeries | None = None) -> DataFrame:
    """Mean of the last ``tsteps`` rows; NULL until there are that many."""
    return with_window(df, spec, tsteps - 1,
                       lambda w: {name: _moving_average(w, spec.feature, tsteps)}, hot)


def lag_matrix(df: DataFrame, spec: SeriesSpec, p: ForecastParams = ForecastParams(),
               name: str = "lags", hot: HotSeries | None = None) -> DataFrame:
    """Array of ``lag`` copies of the feature, copy i taken i * shift rows earlier."""
    return with_window(df, spec, p.reach, lambda w: {name: _lags(w, spec.feature, p)}, hot)


def lag_frame(df: DataFrame, spec: SeriesSpec, value: str, p: ForecastParams,
              hot: HotSeries | None = None) -> DataFrame:
    """Columns ``lags`` and ``target``; the target is the moving average, or the
    value itself when it is forecast from strictly earlier rows (``horizon``)."""
    def build(w):
        target = F.col(value) if p.horizon else _moving_average(w, value, p.tsteps)
        return {"lags": _lags(w, value, p), "target": target}

    return with_window(df, spec, p.reach, build, hot)


def trim_warmup(df: DataFrame, spec: SeriesSpec, p: ForecastParams = ForecastParams(),
                is_prediction: bool = False, hot: HotSeries | None = None) -> DataFrame:
    """Drop the rows before all lags exist and, in training, the rows after the
    last whole batch. Keeps the columns ``pos`` and ``n``."""
    placed = with_position(df, spec, hot)
    kept = placed.where(F.col("pos") > p.warmup)
    if not is_prediction:
        left = F.greatest(F.col("n") - p.warmup, F.lit(0))
        kept = kept.where(F.col("pos") <= F.col("n") - left % p.batch_size)
    return kept


def batch_plan(n: Column, p: ForecastParams = ForecastParams()) -> dict[str, Column]:
    """Columns ``batches``, ``batch_size`` and ``holdout_rows`` for ``n`` usable rows.

    The last 1, 2 or 3 batches validate up to 10, 20 or 30 batches; beyond, the
    share ``1 - split_ratio``. Less than one batch gives one batch of half the rows.
    """
    whole = F.floor(n / p.batch_size).cast("long")
    size = F.when(whole == 0, F.floor(n / 2)).otherwise(F.lit(p.batch_size)).cast("long")
    held = (F.when(whole <= 10, F.lit(1)).when(whole <= 20, F.lit(2)).when(whole <= 30, F.lit(3))
            .otherwise(whole - F.floor(whole * p.split_ratio))).cast("long")
    return {"batches": F.greatest(whole, F.lit(1)), "batch_size": size,
            "holdout_rows": held * size}


def holdout_split(df: DataFrame, spec: SeriesSpec, p: ForecastParams = ForecastParams(),
                  hot: HotSeries | None = None) -> DataFrame:
    """Usable training rows with the flag ``is_holdout`` on the trailing batches."""
    usable = F.col("n") - p.warmup
    kept = trim_warmup(df, spec, p, is_prediction=False, hot=hot)
    plan = batch_plan(usable, p)
    last = F.col("n") - usable % p.batch_size
    flag = (last - F.col("pos") < plan["holdout_rows"]).cast("int")
    return kept.withColumn("is_holdout", flag)


def min_rows_gate(df: DataFrame, spec: SeriesSpec, batch_size: int = 16, params: DataFrame | None = None) -> DataFrame:
    """Series with more than two batches of rows; others are not trained. ``params`` may have per series its own ``batch_size``."""
    batch = F.lit(batch_size)
    counted = attach_stats(df, spec.groups, F.count(F.lit(1)).alias("_rows"))
    if params is not None:
        counted = join_on(counted, params.select(*spec.groups, F.col("batch_size").alias("_batch")), spec.groups, "left")
        batch = F.coalesce(F.col("_batch"), batch)
    return counted.where(F.col("_rows") > 2 * batch).drop("_rows", "_batch")


def product_terms(x: list[Column], y: Column) -> dict[str, Column]:
    """The terms whose sums :func:`solve_sums` needs, by name."""
    lag = len(x)
    out = {"rows": F.lit(1), "sum_y": y}
    out |= {f"sum_{i}": x[i] for i in range(lag)} | {f"sum_{i}_y": x[i] * y for i in range(lag)}
    return out | {f"sum_{i}_{j}": x[i] * x[j] for i in range(lag) for j in range(i, lag)}


def normal_sums(frame: DataFrame, groups, lag: int) -> DataFrame:
    """Per series the sums least squares needs: ``rows``, ``sum_i``, ``sum_i_j``,
    ``sum_y``, ``sum_i_y``, over the rows whose lags and target are known."""
    x = [F.col("lags")[i] for i in range(lag)]
    known = F.col("target").isNotNull()
    for c in x:
        known = known & c.isNotNull()
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum("target").alias("sum_y")]
    aggs += [F.sum(x[i]).alias(f"sum_{i}") for i in range(lag)]
    aggs += [F.sum(x[i] * F.col("target")).alias(f"sum_{i}_y") for i in range(lag)]
    aggs += [F.sum(x[i] * x[j]).alias(f"sum_{i}_{j}") for i in range(lag) for j in range(i, lag)]
    return frame.where(known).groupBy(*groups).agg(*aggs)


def solve_sums(sums: DataFrame, groups, lag: int) -> DataFrame:
    """Coefficients per series from :func:`normal_sums`: pseudo-inverse of the
    centred normal equations, so constant series predict their mean."""
    keep = [sums.schema[g] for g in groups]
    schema = T.StructType(keep + [
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for part in batches:
            n = part["rows"].to_numpy(float)
            mx = np.stack([part[f"sum_{i}"].to_numpy(float) / n for i in range(lag)], axis=1)
            my = part["sum_y"].to_numpy(float) / n
            gram = np.empty((len(part), lag, lag))
            for i in range(lag):
                for j in range(i, lag):
                    value = part[f"sum_{i}_{j}"].to_numpy(float) / n - mx[:, i] * mx[:, j]
                    gram[:, i, j] = gram[:, j, i] = value
            cross = np.stack([part[f"sum_{i}_y"].to_numpy(float) / n for i in range(lag)], axis=1)
            cross -= mx * my[:, None]
            beta = np.einsum("kij,kj->ki", np.linalg.pinv(gram, rcond=1e-10, hermitian=True), cross)
            out = part[list(groups)].copy()
            out["intercept"] = my - (beta * mx).sum(axis=1)
            out["coefficients"] = list(beta)
            yield out

    return sums.mapInPandas(solve, schema)


def fit_forecaster(df: DataFrame, spec: SeriesSpec, p: ForecastParams = ForecastParams(),
                   normalized: bool | None = None, hot: HotSeries | None = None, params: DataFrame | None = None) -> DataFrame:
    """Model rows: groups, ``intercept``, ``coefficients``, ``scale_min``, ``scale_max``."""
    if normalized is None:
        normalized = is_normalized(df, spec.feature).first()["normalized"]
    df = min_rows_gate(df, spec, p.batch_size, params)
    bounds = scale_bounds(df, spec, normalized)
    value = spec.feature + "_norm"
    frame = lag_frame(scale(df, bounds, spec, value), spec, value, p, hot)
    solved = solve_sums(normal_sums(frame, spec.groups, p.lag), spec.groups, p.lag)
    return join_on(solved, bounds, spec.groups)


def predict_forecast(df: DataFrame, models: DataFrame | None, spec: SeriesSpec,
                     p: ForecastParams = ForecastParams(), baseline: str | None = None,
                     hot: HotSeries | None = None) -> DataFrame:
    """Add ``predict``. ``baseline="moving_average"`` needs no model."""
    if baseline == "moving_average":
        return moving_average(df, spec, p.tsteps, "predict", hot)
    out = lag_matrix(df, spec, p, "_lags", hot)
    out = join_on(out, models.select(*spec.groups, "intercept", "coefficients",
                                     "scale_min", "scale_max"), spec.groups, "left")
    dot = F.aggregate(
        F.zip_with("_lags", "coefficients", lambda x, c: scaled(x) * c),
        F.col("intercept"), lambda acc, v: acc + v)
    return (out.withColumn("predict", unscaled(dot))
            .drop("_lags", "intercept", "coefficients", "scale_min", "scale_max"))


def residuals(actual: Column, predict: Column, zero: float | None = ZERO_ACTUAL) -> Column:
    """Distance of the prediction; a fixed large value where the actual is 0.

    A missing actual counts as 0. ``zero=None`` measures zeros like any value.
    """
    actual = F.coalesce(actual, F.lit(0.0))
    distance = F.abs(actual - predict)
    if zero is None:
        return distance
    return F.when(actual == 0, F.lit(zero)).otherwise(distance)
