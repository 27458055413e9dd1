"""Detector 3: trend with a band, per series.

A straight line comes from the built-in regression aggregates. A piecewise
linear trend needs only six sums per (series, segment between knots); the
normal equations of the hinge basis follow from these, so rows are reduced where
they are and only some fifty short rows per series are solved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.kernels import z_quantile
from tidemark.operators.series import HotSeries, join_on, position_in, with_position
from tidemark.session import materialize
from tidemark.spec import SeriesSpec


#: Different interval widths that the models of one table may have.
MOST_WIDTHS = 100


@dataclass(frozen=True)
class TrendParams:
    interval_width: float = 0.95
    changepoint_range: float = 0.1
    n_changepoints: int = 50
    kind: str = "linear"
    # Scales of the normal prior on slope and offset, and of the
    # Laplace prior on slope changes.
    slope_scale: float = 5.0
    change_scale: float = 0.05


def to_ds_y(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Columns ``ds`` (time to the second) and ``y`` beside the user's own."""
    return df.withColumns({"ds": F.date_trunc("second", spec.time), "y": F.col(spec.feature)})


def days_since(time: Column | str, start: Column) -> Column:
    """Days from ``start`` to the time, both truncated to seconds."""
    t = F.date_trunc("second", time)
    return (F.unix_micros(t) - F.unix_micros(F.date_trunc("second", start))) / 86400e6


def changepoint_grid(df: DataFrame, spec: SeriesSpec, p: TrendParams = TrendParams(),
                     hot: HotSeries | None = None, params: DataFrame | None = None) -> DataFrame:
    """Rows (groups, ``knot``, ``ds``): knots at evenly spaced rows of the first
    share of the history; fewer where the history is short. ``params`` may have per series
    its own ``changepoint_range`` and ``n_changepoints``."""
    placed = with_position(to_ds_y(df.select(*spec.groups, *spec.order, spec.feature), spec), spec, hot)
    if params is not None:
        own = params.select(*spec.groups, F.col("changepoint_range").alias("_range"), F.col("n_changepoints").alias("_most"))
        placed = join_on(placed, own, spec.groups, "left")
    return knots_of(placed, p).select(*spec.groups, "knot", "ds")


def _early(share) -> Column:
    """The rows that knots lie in."""
    return F.floor(F.col("n") * share)


def knot_at(share, most) -> Column:
    """The number of the knot that the row ``pos`` of ``n`` is, else NULL.

    Knot j sits at row round(j * (early - 1) / count); a row can be hit at most
    once, by the j next to its own position.
    """
    early = _early(share)
    count = F.when(early <= most, early - 1).otherwise(most)
    step = F.try_divide(early - 1, count)
    near = F.round(F.try_divide(F.col("pos") - 1, step)).cast("int")
    hit = (near >= 1) & (near <= count) & (F.bround(near * step) == F.col("pos") - 1)
    return F.when((F.col("pos") <= early) & (count >= 1) & hit, near)


def knots_of(placed: DataFrame, p: TrendParams) -> DataFrame:
    """The rows (with ``pos`` and ``n``) that are knots, and their ``knot`` number.

    Columns ``_range`` and ``_most``, if there, hold the series' own parameters.
    """
    share, most = F.lit(p.changepoint_range), F.lit(p.n_changepoints)
    if "_range" in placed.columns:
        share, most = F.coalesce("_range", share), F.coalesce("_most", most)
    return placed.withColumn("knot", knot_at(share, most)).where(F.col("knot").isNotNull())


def _line_sums(t: Column, y: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.avg(y).alias("_ybar"), F.avg(t).alias("_tbar"),
            F.regr_sxx(y, t).alias("_sxx"), F.regr_sxy(y, t).alias("_sxy"),
            F.regr_syy(y, t).alias("_syy")]


def fit_linear(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Model rows: groups, ``start``, ``slope`` (per day), ``intercept``, ``sigma``.

    One time only, or one row: the mean with slope 0.
    """
    y = F.col(spec.feature)
    known = df.where(y.isNotNull())
    starts = known.groupBy(*spec.groups).agg(F.min(spec.time).alias("start"))
    rows = join_on(known.select(*spec.groups, spec.time, spec.feature), starts, spec.groups)
    sums = rows.groupBy(*spec.groups, "start").agg(
        *_line_sums(days_since(spec.time, F.col("start")), y))
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(F.lit(0.0))
    left = F.col("_syy") - F.col("slope") * F.col("_sxy")
    return (sums.withColumn("slope", slope)
            .withColumn("intercept", F.col("_ybar") - F.col("slope") * F.col("_tbar"))
            .withColumn("sigma", F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("rows")))
            .select(*spec.groups, "start", "slope", "intercept", "sigma"))


def segment_of(t: Column, knots: str = "knot_days", most: int = 1 << 14) -> Column:
    """How many of the sorted knots are at or before ``t``."""
    return position_in(F.col(knots), t, most)


def segment_sums(df: DataFrame, knots: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per (series, segment): row count and sums of t, t*t, y, t*y, y*y.

    ``knots`` has per series ``start`` and the sorted array ``knot_days``, and may have ``center``,
    a number taken off each y: sums around the mean keep their digits where values are large.
    """
    y = F.col(spec.feature)
    if "center" in knots.columns:
        y = y - F.col("center")
    known = df.where(F.col(spec.feature).isNotNull()).select(*spec.groups, spec.time, spec.feature)
    rows = join_on(known, knots, spec.groups)
    rows = rows.withColumn("_t", days_since(spec.time, F.col("start")))
    t = F.col("_t")
    return rows.groupBy(*spec.groups, segment_of(t).alias("segment")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(t).alias("sum_t"), F.sum(t * t).alias("sum_tt"),
        F.sum(y).alias("sum_y"), F.sum(t * y).alias("sum_ty"), F.sum(y * y).alias("sum_yy"),
        F.max(t).alias("max_t"), F.max(F.abs(F.col(spec.feature))).alias("max_y"))


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; the shortest one where it is singular."""
    try:
        found = np.linalg.solve(matrix, right)
        if np.allclose(matrix @ found, right, rtol=1e-8, atol=1e-12):
            return found
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(matrix, rcond=1e-13, hermitian=True) @ right


def hinge_fit(part: pd.DataFrame, knots: np.ndarray, p: TrendParams, center: float):
    """Offset, slope, slope changes and residual deviation from segment sums around ``center``.

    The prior is on the offset from 0, so it pulls the centred one towards ``-center``.
    """
    part = part.sort_values("segment")
    m = knots.size
    width = max(float(part["max_t"].max()), 1e-12)
    size = max(float(part["max_y"].max()), 1e-12)
    sums = np.zeros((m + 1, 6))
    raw = part[["rows", "sum_t", "sum_tt", "sum_y", "sum_ty", "sum_yy"]].to_numpy(float)
    sums[part["segment"].to_numpy(int)] = raw
    sums /= np.array([1, width, width ** 2, size, width * size, size ** 2])
    # Row k of the tail sums covers all rows from knot k on.
    tail = np.cumsum(sums[::-1], axis=0)[::-1]
    s = np.concatenate([[0.0], knots / width])
    start = np.arange(m + 1)
    late = np.maximum(start[:, None], start[None, :])
    a, b = s[:, None], s[None, :]
    n, t, tt = tail[late, 0], tail[late, 1], tail[late, 2]
    slopes = tt - (a + b) * t + a * b * n
    gram = np.empty((m + 2, m + 2))
    gram[1:, 1:] = slopes
    gram[0, 0] = tail[0, 0]
    gram[0, 1:] = gram[1:, 0] = tail[:, 1] - s * tail[:, 0]
    right = np.concatenate([[tail[0, 3]], tail[:, 4] - s * tail[:, 3]])
    total = tail[0]

    def solve(noise, changes):
        prior = np.full(m + 2, noise / p.slope_scale ** 2)
        prior[2:] = noise / (p.change_scale * np.maximum(np.abs(changes), 1e-9))
        beta = _solve(gram + np.diag(prior), right - np.eye(m + 2)[0] * prior[0] * center / size)
        left = total[5] - 2 * beta @ right + beta @ gram @ beta
        return beta, max(left, 0.0) / max(total[0], 1.0)

    plain = np.linalg.pinv(gram[:2, :2], hermitian=True) @ right[:2]
    left = total[5] - 2 * plain @ right[:2] + plain @ gram[:2, :2] @ plain
    noise = max(left, 0.0) / max(total[0], 1.0)
    # Coefficients, then noise and the weights of the prior on slope changes (a
    # Laplace prior as a reweighted quadratic one), until the noise settles.
    changes = np.full(m, p.change_scale)
    for _ in range(100):
        before = noise
        beta, noise = solve(noise, changes)
        changes = beta[2:]
        if abs(noise - before) <= 1e-9 * before:
            break
    return center + beta[0] * size, beta[1:] * size / width, float(np.sqrt(noise) * size)


def fit_piecewise(df: DataFrame, spec: SeriesSpec, p: TrendParams = TrendParams(),
                  hot: HotSeries | None = None, params: DataFrame | None = None) -> DataFrame:
    """Model rows: groups, ``start``, ``knot_days``, ``slopes`` (base slope, then the
    change at each knot), ``intercept``, ``sigma``."""
    known = df.where(F.col(spec.feature).isNotNull())
    starts = known.groupBy(*spec.groups).agg(F.min(spec.time).alias("start"), F.avg(spec.feature).alias("center"))
    grid = changepoint_grid(known, spec, p, hot, params)
    grid = join_on(grid, starts, spec.groups)
    days = F.sort_array(F.collect_set(days_since("ds", F.col("start"))))
    found = grid.groupBy(*spec.groups).agg(days.alias("knot_days"))
    empty = F.array().cast("array<double>")
    knots = join_on(starts, found, spec.groups, "left")
    knots = knots.withColumn("knot_days", F.coalesce("knot_days", empty))
    sums = segment_sums(known, knots, spec)
    keys = list(spec.groups)
    both = join_on(sums, knots, keys)
    schema = T.StructType([df.schema[g] for g in keys] + [
        T.StructField("start", T.TimestampType()),
        T.StructField("knot_days", T.ArrayType(T.DoubleType())),
        T.StructField("slopes", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()), T.StructField("sigma", T.DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        at = np.asarray(part["knot_days"].iloc[0], dtype=float)
        intercept, slopes, sigma = hinge_fit(part, at, p, part["center"].iloc[0])
        row = {g: [part[g].iloc[0]] for g in keys}
        row |= {"start": [part["start"].iloc[0]], "knot_days": [at], "slopes": [slopes],
                "intercept": [intercept], "sigma": [sigma]}
        return pd.DataFrame(row)

    by = keys or [F.lit(0).alias("_one")]
    return both.groupBy(*by).applyInPandas(run, schema)


def fit_trend(df: DataFrame, spec: SeriesSpec, p: TrendParams = TrendParams(),
              hot: HotSeries | None = None, params: DataFrame | None = None) -> DataFrame:
    """Trend models of one shape for both kinds: a line has no knots.

    ``params`` has per series ``changepoint_range``, ``n_changepoints`` and ``interval_width``; a series without them, or a null,
    has those of ``p``. The width stays with the model.
    """
    if p.kind == "piecewise":
        out = fit_piecewise(df, spec, p, hot, params)
    else:
        out = fit_linear(df, spec).withColumn("knot_days", F.array().cast("array<double>"))
        out = out.withColumn("slopes", F.array("slope")).drop("slope")
    if params is None:
        return out
    out = join_on(out, params.select(*spec.groups, "interval_width"), spec.groups, "left")
    return out.withColumn("interval_width", F.coalesce("interval_width", F.lit(p.interval_width)))


def _deviations(models: DataFrame, width: float) -> Column:
    """Standard deviations on each side of the band: those of the model's own width where it has one."""
    if "interval_width" not in models.columns:
        return F.lit(z_quantile((1 + width) / 2))
    widths = [r[0] for r in models.select("interval_width").distinct().limit(MOST_WIDTHS + 1).collect()]  # from a grid
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"more than {MOST_WIDTHS} different interval widths")
    own = [F.when(F.col("interval_width") == w, z_quantile((1 + w) / 2)) for w in widths if w is not None]
    return F.coalesce(*own, F.lit(z_quantile((1 + width) / 2)))


def fit_trend_grid(df: DataFrame, spec: SeriesSpec, params: list[TrendParams],
                   hot: HotSeries | None = None) -> tuple[DataFrame, DataFrame]:
    """Piecewise trends for several parameters from one pass of sums.

    The rows are summed between the knots of all parameters together; the sums of
    each parameter's wider segments add up from these. Gives the lines (groups,
    ``segment``, arrays ``offsets`` and ``slopes`` over the parameters) and the
    knots (groups, ``start``, ``knot_days``) that number the segments.
    """
    keys = list(spec.groups)
    known = df.where(F.col(spec.feature).isNotNull())
    starts = known.groupBy(*keys).agg(F.min(spec.time).alias("start"), F.avg(spec.feature).alias("center"))
    placed = with_position(to_ds_y(known.select(*keys, *spec.order, spec.feature), spec), spec, hot)
    share = max(p.changepoint_range for p in params)
    placed = placed.where(F.col("pos") <= _early(share)).select(*keys, "ds", "pos", "n")
    # A row says in place for which parameters it is a knot, so the ranked rows are made once.
    used = [F.when(knot_at(F.lit(p.changepoint_range), F.lit(p.n_changepoints)).isNotNull(), i) for i, p in enumerate(params)]
    grid = placed.withColumn("_param", F.explode(F.array_compact(F.array(*used))))
    days = days_since("ds", F.col("start"))
    grid = join_on(grid, starts, keys).select(*keys, "_param", days.alias("day"))
    found = grid.groupBy(*keys).agg(
        F.sort_array(F.collect_set("day")).alias("knot_days"),
        F.sort_array(F.collect_set(F.struct("_param", "day"))).alias("_used"))
    empty = F.array().cast("array<double>")
    knots = join_on(starts, found, keys, "left").withColumn("knot_days", F.coalesce("knot_days", empty))
    knots = materialize(knots, "knots")
    plain = knots.select(*keys, "start", "knot_days")
    sums = segment_sums(known, knots.select(*keys, "start", "knot_days", "center"), spec)
    schema = T.StructType([df.schema[g] for g in keys] + [
        T.StructField("segment", T.IntegerType()), T.StructField("offsets", T.ArrayType(T.DoubleType())),
        T.StructField("slopes", T.ArrayType(T.DoubleType()))])

    def run(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if len(part) == 0:
            return pd.DataFrame(columns=schema.names)
        at = np.asarray(found["knot_days"].iloc[0], dtype=float)
        used = found["_used"].iloc[0]
        used = [] if used is None else [(u["_param"], u["day"]) for u in used]
        begin = np.concatenate([[-np.inf], at])
        offsets, slopes = np.empty((at.size + 1, len(params))), np.empty((at.size + 1, len(params)))
        fine = part["segment"].to_numpy(int)
        for i, p in enumerate(params):
            own = np.array([d for j, d in used if j == i])
            wide = np.searchsorted(own, begin, side="right")
            merged = part.assign(segment=wide[fine]).groupby("segment", as_index=False).agg(
                {**{c: "sum" for c in ("rows", "sum_t", "sum_tt", "sum_y", "sum_ty", "sum_yy")},
                 "max_t": "max", "max_y": "max"})
            intercept, change, _ = hinge_fit(merged, own, p, found["center"].iloc[0])
            slope = np.cumsum(change)
            offset = intercept - np.concatenate([[0.0], np.cumsum(change[1:] * own)])
            offsets[:, i], slopes[:, i] = offset[wide], slope[wide]
        seen = np.unique(fine)
        out = pd.DataFrame({g: [part[g].iloc[0]] * seen.size for g in keys})
        return out.assign(segment=seen, offsets=list(offsets[seen]), slopes=list(slopes[seen]))

    # One short group per series: its segments, and its knots once.
    by = keys or [F.lit(0).alias("_one")]
    side = knots.toDF(*knots.columns)
    lines = sums.groupBy(*by).cogroup(side.groupBy(*by)).applyInPandas(run, schema)
    return lines, plain


def trend_band(df: DataFrame, models: DataFrame, spec: SeriesSpec,
               interval_width: float = 0.95) -> DataFrame:
    """Add ``yhat``, ``yhat_lower`` and ``yhat_upper``; a model with an ``interval_width`` of its own is used with that."""
    z = _deviations(models, interval_width)
    used = models.select(*spec.groups, "start", "knot_days", "slopes", "intercept", (F.col("sigma") * z).alias("_half"))
    out = join_on(df, used, spec.groups, "left")
    out = out.withColumn("_t", days_since(spec.time, F.col("start")))
    t = F.col("_t")
    bends = F.aggregate(
        F.zip_with("knot_days", F.slice("slopes", F.lit(2), F.size("knot_days")),
                   lambda s, change: F.greatest(t - s, F.lit(0.0)) * change),
        F.lit(0.0), lambda acc, v: acc + v)
    yhat = F.col("intercept") + F.get("slopes", F.lit(0)) * t + bends
    half = F.col("_half")
    out = out.withColumn("yhat", yhat)
    out = out.withColumns({"yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half})
    return out.drop("_t", "start", "knot_days", "slopes", "intercept", "_half")


def _beyond(a: Column, b: Column) -> Column:
    """``a > b`` by more than rounding, so that an exact fit flags nothing."""
    return a - b > F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))


def band_label(y: Column, lower: Column, upper: Column) -> Column:
    """1 outside the band."""
    return F.when(_beyond(y, upper) | _beyond(lower, y), 1).otherwise(0)


def band_score(y: Column, lower: Column, upper: Column) -> Column:
    """Distance to the band relative to the value; 0 inside, NULL where the value is 0."""
    def away(bound):
        return F.abs(F.try_divide(y - bound, y))

    return (F.when(_beyond(y, upper), away(upper)).when(_beyond(lower, y), away(lower))
            .otherwise(F.lit(0.0)))


def label_band(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add ``ad_label_3`` and ``anomaly_score_3``."""
    y, lo, hi = F.col(spec.feature), F.col("yhat_lower"), F.col("yhat_upper")
    return df.withColumns({"ad_label_3": band_label(y, lo, hi), "anomaly_score_3": band_score(y, lo, hi)})


def mape(actual: Column, predict: Column) -> Column:
    """Aggregate: mean absolute percentage error; zero actuals are left out."""
    return F.avg(F.abs(F.try_divide(actual - predict, actual))) * 100
