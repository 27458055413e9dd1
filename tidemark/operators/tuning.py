"""Parameter grids and the choice of the best combination per series.

The data is expanded only by those parameters that change a fit, and only over
the tail of each series; everything else is a small table of combinations.
"""

from __future__ import annotations

import math
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.sampling import add_hashes, draw
from tidemark.operators.forecast import (
    ForecastParams, is_normalized, lag_frame, min_rows_gate, minmax_scale, normal_sums, product_terms, solve_sums)
from tidemark.operators.iforest import KNOTS, as_models, iforest_sample, merge_curves, score_iforest, tree_curves
from tidemark.operators.residual_score import mean_ci_inlier
from tidemark.operators.series import (
    ROWS_PER_GROUP, HotSeries, exact_percentiles, hot_series, join_on, with_position, with_window)
from tidemark.operators.trend import (
    TrendParams, days_since, fit_trend, fit_trend_grid, mape, segment_of, trend_band)
from tidemark.session import materialize
from tidemark.spec import SeriesSpec

# Default parameters of the detectors, and the ranges that are tuned.
DEFAULTS = {
    "iso_f": {"contamination": 0.01, "num_of_trees": 1000, "split_ratio": 0.8},
    "lstm": {"activation": "relu", "batch_count": 8, "batch_size": 16, "epochs": 10, "l1": 0.01,
             "l2": 0.01, "lag": 2, "lahead": 2, "lr": 0.04, "split_ratio": 0.8, "tsteps": 2,
             "units": 8},
    "prophet": {"contamination": 0.3, "interval_width": 0.95, "num_of_trees": 200,
                "split_ratio": 0.8, "changepoint_range": 0.1, "n_changepoints": 50},
}
RANGES = {
    "iso_f": {"contamination": "0.1*0.5", "num_of_trees": "200*1200"},
    "lstm": {"batch_size": "8*24", "epochs": "5*20", "lag": "2*4", "lahead": "2*4",
             "lr": "0.01*0.05", "tsteps": "2*4", "units": "4*12"},
    "prophet": {"changepoint_range": "0.1*0.5", "interval_width": "0.9*0.95",
                "n_changepoints": "50*300"},
}
# Share of the newest rows each detector is tuned on.
TAIL_SHARE = {"iso_f": 0.3, "prophet": 0.1, "lstm": 1.0}

SPARK_TYPES = {int: "int", float: "double", str: "string"}

#: Blocks of rolling-origin evaluation.
FOLDS = 5

# Trees that one closed-form subsample stands for.
TREES_PER_SUBSAMPLE = 1


def grid_steps(spec: str) -> tuple[Decimal, Decimal, int]:
    """Start, step and number of values of ``"start*stop"`` or ``"start*stop*step"``.

    The stop is excluded; without a third number the step equals the start.
    """
    numbers = [Decimal(v) for v in spec.split("*")]
    start, stop = numbers[:2]
    step = numbers[2] if len(numbers) > 2 else start
    return start, step, max(0, math.ceil((stop - start) / step))


def param_grid(spark: SparkSession, defaults: dict, ranges: dict) -> DataFrame:
    """All combinations: ``combo_id`` in the order of the parameters, then one typed
    column per parameter; parameters without a range keep their default."""
    sizes = {p: grid_steps(ranges[p])[2] if p in ranges else 1 for p in defaults}
    total = 1
    for n in sizes.values():
        total *= n
    out = spark.range(total).withColumnRenamed("id", "combo_id")
    below = total
    for name, default in defaults.items():
        kind = SPARK_TYPES[type(default)]
        if name not in ranges:
            out = out.withColumn(name, F.lit(default).cast(kind))
            continue
        start, step, n = grid_steps(ranges[name])
        below //= n
        index = F.floor(F.col("combo_id") / below) % n
        out = out.withColumn(name, typed(F.lit(float(start)) + index * float(step), default))
    return out


def typed(value: Column, default) -> Column:
    """Cast to the type of the parameter's default."""
    kind = SPARK_TYPES[type(default)]
    return F.round(value, 9).cast(kind) if kind == "double" else value.cast(kind)


def half_grid(grid: DataFrame, seed: int = 0) -> DataFrame:
    """A random half of the combinations."""
    n = grid.count()
    hashed = add_hashes(grid, ["combo_id"], seed).withColumn("_draw", draw(F.lit(0)))
    return hashed.orderBy("_draw", "combo_id").limit(n // 2).select(*grid.columns)


def tail_window(df: DataFrame, spec: SeriesSpec, share: float, hot: HotSeries | None = None) -> DataFrame:
    """The newest ``share`` of each series' rows."""
    placed = with_position(df, spec, hot)
    return placed.where(F.col("n") - F.col("pos") < F.floor(F.col("n") * share)).drop("n", "pos")


def macro_f1(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates of two 0/1 columns: confusion counts and the mean F1 of both classes."""
    def count(a, p):
        return F.sum(((actual == a) & (predicted == p)).cast("long"))

    tp, fp, fn, tn = count(1, 1), count(0, 1), count(1, 0), count(0, 0)
    one = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    zero = F.coalesce(F.try_divide(2 * tn, 2 * tn + fp + fn), F.lit(0.0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "macro_f1": (one + zero) / 2}


def objective_forecast(df: DataFrame, spec: SeriesSpec, grid: DataFrame,
                       hot: HotSeries | None = None) -> DataFrame:
    """Rows (groups, ``combo_id``, ``error``): mean absolute training error, in
    scaled units.

    Combinations that agree in lag, lahead, tsteps and batch size share one fit.
    """
    keys = ["lag", "lahead", "tsteps", "batch_size"]
    hot = hot or hot_series(df, spec)
    normalized = is_normalized(df, spec.feature).first()["normalized"]
    scaled = minmax_scale(df, spec, "_scaled", normalized)
    out = None
    for row in grid.select(*keys).distinct().collect():
        p = ForecastParams(row["lag"], row["lahead"], row["tsteps"], row["batch_size"])
        frame = lag_frame(min_rows_gate(scaled, spec, p.batch_size), spec, "_scaled", p, hot)
        models = solve_sums(normal_sums(frame, spec.groups, p.lag), spec.groups, p.lag)
        fitted = F.aggregate(F.zip_with("lags", "coefficients", lambda x, c: x * c),
                             F.col("intercept"), lambda acc, v: acc + v)
        # Rounded, so that exact fits tie and the first combination wins.
        error = (join_on(frame, models, spec.groups).groupBy(*spec.groups)
                 .agg(F.round(F.avg(F.abs(fitted - F.col("target"))), 9).alias("error"))
                 .withColumns({k: F.lit(row[k]) for k in keys}))
        out = error if out is None else out.unionByName(error)
    combos = grid.select("combo_id", *keys)
    return out.join(F.broadcast(combos), keys).select(*spec.groups, "combo_id", "error")


def objective_rolling(df: DataFrame, spec: SeriesSpec, grid: DataFrame, folds: int = FOLDS,
                      hot: HotSeries | None = None) -> DataFrame:
    """Rows (groups, ``combo_id``, ``error``): mean absolute error of forecasting the next row, in scaled units, by rolling origin.

    A series' rows are cut into ``folds`` blocks; each block but the first is forecast by a fit on all rows before it.
    One pass sums products per (series, block) for all lag settings together, and a block's fit comes from the sums of
    the blocks before it; a second pass takes the errors of all settings.
    """
    settings = sorted({(r["lag"], r["lahead"]) for r in grid.select("lag", "lahead").distinct().collect()})
    fits = [ForecastParams(lag, lahead, horizon=1) for lag, lahead in settings]
    offsets = [[p.horizon + i * max(p.shift, 1) for i in range(p.lag)] for p in fits]
    every = sorted({o for own in offsets for o in own})
    hot = hot or hot_series(df, spec)
    scaled = minmax_scale(df, spec, "_y", is_normalized(df, spec.feature).first()["normalized"])
    frame = with_window(scaled, spec, every[-1], lambda w: {"_x": F.array(*[F.lag("_y", o).over(w) for o in every])}, hot)
    frame = with_position(frame, spec, hot)
    keys = [*spec.groups, "_block"]
    block = F.floor((F.col("pos") - 1) * folds / F.col("n")).cast("int")
    frame = frame.select(*spec.groups, block.alias("_block"), F.col("_y").alias("target"), "_x")

    def lags(own: list[int]) -> list[Column]:
        return [F.col("_x")[every.index(o)] for o in own]

    def known(own: list[int]) -> Column:
        out = F.col("target").isNotNull()
        for x in lags(own):
            out = out & x.isNotNull()
        return out

    sums = frame.groupBy(*keys).agg(*[
        F.sum(F.when(known(own), value)).alias(f"{k}_{name}")
        for k, own in enumerate(offsets) for name, value in product_terms(lags(own), F.col("target")).items()])
    before = Window.partitionBy(*spec.groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    models = None
    for k, p in enumerate(fits):
        own = [c.removeprefix(f"{k}_") for c in sums.columns if c.startswith(f"{k}_")]
        earlier = sums.select(*keys, *[F.sum(f"{k}_{c}").over(before).alias(c) for c in own]).where(F.col("rows") > p.lag)
        solved = solve_sums(earlier, keys, p.lag).withColumn("_setting", F.lit(k))
        models = solved if models is None else models.unionByName(solved)
    packed = models.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct("_setting", F.struct("intercept", "coefficients")))).alias("_fits"))
    judged = join_on(frame, packed, keys)
    errors = []
    for k, own in enumerate(offsets):
        fit = F.col("_fits")[k]
        guess = fit["intercept"]
        for i, x in enumerate(lags(own)):
            guess = guess + fit["coefficients"][i] * x
        errors.append(F.round(F.avg(F.when(known(own), F.abs(guess - F.col("target")))), 9).alias(f"_e{k}"))
    wide = judged.groupBy(*spec.groups).agg(*errors)
    cells = F.array(*[F.struct(F.lit(a).alias("lag"), F.lit(b).alias("lahead"), F.col(f"_e{k}").alias("error"))
                      for k, (a, b) in enumerate(settings)])
    long = wide.select(*spec.groups, F.explode(cells).alias("_c")).select(*spec.groups, "_c.*")
    combos = grid.select("combo_id", "lag", "lahead")
    return long.join(F.broadcast(combos), ["lag", "lahead"]).select(*spec.groups, "combo_id", "error")


def objective_iforest(df: DataFrame, spec: SeriesSpec, grid: DataFrame, seed: int = 42,
                      trees_per_subsample: int = TREES_PER_SUBSAMPLE,
                      hot: HotSeries | None = None) -> DataFrame:
    """Rows (groups, ``combo_id``, ``error``): 1 - macro F1 against the rows outside
    the mean's confidence interval.

    One pass scores each row by every number of trees; the forests share their
    subsamples, and the contamination levels share the scores.
    """
    combos = grid.select("combo_id", "num_of_trees", "contamination")
    pairs = combos.select("num_of_trees", "contamination").distinct().collect()
    trees = sorted({p["num_of_trees"] for p in pairs})
    shares = sorted({p["contamination"] for p in pairs})
    per_size = {n: max(1, n // trees_per_subsample) for n in trees}

    sample = iforest_sample(df, spec, max(per_size.values()), seed=seed, once=True)
    # Each tree is fitted once. Trees between two sizes are merged first; a forest is the mean of all such merged curves up to its size.
    by_trees = spec.with_groups([*spec.groups, "num_of_trees"])
    wanted = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in per_size.items()])
    between = F.size(F.filter(wanted, lambda w: w["k"] <= F.col("_number")))
    fitted = materialize(tree_curves(sample, spec), "trees").withColumnRenamed("tree", "_number").withColumn("_class", between)
    classes = merge_curves(fitted.withColumnRenamed("_number", "tree"), [*spec.groups, "_class"], KNOTS)
    sizes = F.transform(F.slice(wanted, F.col("_class") + 1, F.lit(len(trees))), lambda w: w["n"])
    curves = classes.withColumn("num_of_trees", F.explode(sizes)).withColumnRenamed("_class", "tree")
    curves = as_models(merge_curves(curves, by_trees.groups, KNOTS), by_trees.groups)

    hot = hot_series(df, spec, ROWS_PER_GROUP) if hot is None else hot
    flagged = mean_ci_inlier(df, spec).select(*spec.groups, *spec.order, spec.feature,
                                              (1 - F.col("inlier")).alias("_outlier"))
    rows = flagged.withColumn("num_of_trees", F.explode(F.array(*[F.lit(n) for n in trees])))
    if hot.table is not None:
        every = F.explode(F.array(*[F.lit(n) for n in trees]))
        hot = replace(hot, spec=by_trees, table=hot.table.withColumn("num_of_trees", every))
    scored = score_iforest(rows, curves, by_trees, hot=hot)
    scored = scored.select(*by_trees.groups, "_outlier", "anomaly_score_2")
    limits = exact_percentiles(scored, by_trees.groups, "anomaly_score_2", shares, "_limits", hot)
    judged = join_on(scored, limits, by_trees.groups)
    errors = []
    for i in range(len(shares)):
        label = (F.col("anomaly_score_2") < F.col("_limits")[i]).cast("int")
        errors.append((1 - macro_f1(F.col("_outlier"), label)["macro_f1"]).alias(f"_e{i}"))
    wide = judged.groupBy(*by_trees.groups).agg(*errors)
    cells = F.array(*[F.struct(F.lit(s).alias("contamination"), F.col(f"_e{i}").alias("error"))
                      for i, s in enumerate(shares)])
    long = wide.select(*by_trees.groups, F.explode(cells).alias("_c")).select(*by_trees.groups, "_c.*")
    return (long.join(F.broadcast(combos), ["num_of_trees", "contamination"])
            .select(*spec.groups, "combo_id", "error"))


def objective_trend(df: DataFrame, spec: SeriesSpec, grid: DataFrame, kind: str = "piecewise",
                    hot: HotSeries | None = None) -> DataFrame:
    """Rows (groups, ``combo_id``, ``error``): percentage error of the trend's size.

    The interval width does not move the trend, so combinations share fits, and
    a straight line has only one.
    """
    keys = ["changepoint_range", "n_changepoints"]
    combos = grid.select("combo_id", *keys)
    y = F.col(spec.feature)
    # Read several times below: what ranked these rows is not done again, nor held by one task several times over.
    df = materialize(df.select(*dict.fromkeys([*spec.groups, *spec.order, spec.feature])), "tail")
    if kind == "linear":
        fitted = trend_band(df, fit_trend(df, spec, TrendParams(), hot), spec)
        error = fitted.groupBy(*spec.groups).agg(mape(y, F.abs(F.col("yhat"))).alias("error"))
        every = F.explode(F.array(*[F.lit(r["combo_id"]) for r in combos.collect()]))
        return error.withColumn("combo_id", every).select(*spec.groups, "combo_id", "error")
    pairs = [tuple(r) for r in combos.select(*keys).distinct().orderBy(*keys).collect()]
    params = [TrendParams(changepoint_range=a, n_changepoints=b, kind=kind) for a, b in pairs]
    lines, knots = fit_trend_grid(df, spec, params, hot)
    rows = join_on(df.where(y.isNotNull()).select(*spec.groups, spec.time, spec.feature), knots, spec.groups)
    t = days_since(spec.time, F.col("start"))
    rows = rows.withColumn("_t", t).withColumn("segment", segment_of(F.col("_t")))
    rows = rows.drop("knot_days", "start").join(lines, [*spec.groups, "segment"])
    errors = [mape(y, F.abs(F.col("offsets")[i] + F.col("slopes")[i] * F.col("_t"))).alias(f"_e{i}")
              for i in range(len(pairs))]
    wide = rows.groupBy(*spec.groups).agg(*errors)
    cells = F.array(*[F.struct(F.lit(a).alias(keys[0]), F.lit(b).alias(keys[1]), F.col(f"_e{i}").alias("error"))
                      for i, (a, b) in enumerate(pairs)])
    long = wide.select(*spec.groups, F.explode(cells).alias("_c")).select(*spec.groups, "_c.*")
    return long.join(F.broadcast(combos), keys).select(*spec.groups, "combo_id", "error")


def best_params(errors: DataFrame, grid: DataFrame, groups) -> DataFrame:
    """Per series the combination with the least error; the first one wins ties."""
    best = errors.where(F.col("error").isNotNull()).groupBy(*groups).agg(
        F.min(F.struct("error", "combo_id")).alias("_b"))
    chosen = best.select(*groups, F.col("_b.combo_id").alias("combo_id"), F.col("_b.error").alias("error"))
    return chosen.join(grid, "combo_id")


def params_for(series: DataFrame, tuned: DataFrame, defaults: dict, groups) -> DataFrame:
    """One row per series: tuned parameters where there are some, else the defaults."""
    columns = [c for c in defaults if c in tuned.columns]
    out = join_on(series, tuned.select(*groups, *columns), groups, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(defaults[c])) for c in columns})


def tune_if_needed(series: DataFrame, tuned: DataFrame, groups) -> DataFrame:
    """Series that have no parameters yet."""
    return series.join(tuned, list(groups), "left_anti")

