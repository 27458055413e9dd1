"""Detector 2: isolation forest on one feature, per series.

Each tree sees at most 256 rows, so the work of a (series, tree) is bounded
however long the series is. In one dimension the expected path length of fully
grown random-split trees has a closed form (mode ``exact``); ``sampled`` grows
real trees. Either way a series ends up with one curve: path length over value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import series
from tidemark.operators.residual_score import draw_rounds
from tidemark.operators.series import (
    HotSeries, exact_percentile, exact_percentiles, hot_series, join_on, meet, slots_for)
from tidemark.session import materialize
from tidemark.spec import SeriesSpec

PSI = 256
EULER = 0.5772156649

# Trees of a forest, each on a sample of its own; in mode ``exact`` each one is the
# mean over infinitely many random trees on its rows.
TREES = 1000
#: Knots of a model's curve, as many as eight trees have.
KNOTS = 8 * PSI
#: Curves that are merged at a time.
MERGED = 32
#: Different contaminations that the series of one fit may have.
MOST_SHARES = 1000
#: Models of at most so many bytes are sent to every task; larger ones meet the rows by key.
MODEL_BYTES = 32 << 20
# Trees of the registered queries whose SQL draws the samples too.
SUBSAMPLES = 8


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        many = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def expected_path(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the expected path length at each (closed form).

    A gap is on the path of a value iff it is the first split among the gaps up
    to it, with probability (its width / distance covered).
    """
    x, times = np.unique(values, return_counts=True)
    height = average_path(times)
    if x.size > 1:
        gap = np.diff(x)
        right = x[None, 1:] - x[:, None]
        left = x[:, None] - x[None, :-1]
        ahead = np.arange(x.size - 1)[None, :] >= np.arange(x.size)[:, None]
        span = np.where(ahead, right, left)
        height = height + (gap[None, :] / span).sum(axis=1)
    return x, height


def random_tree(values: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of one random tree, ascending, and the path length between them."""
    x = np.sort(values)
    cap = math.ceil(math.log2(max(x.size, 2)))
    cuts, heights = [], []

    def grow(part, depth):
        if depth >= cap or part.size <= 1 or part[0] == part[-1]:
            heights.append(depth + float(average_path(part.size)))
            return
        cut = rng.uniform(part[0], part[-1])
        at = np.searchsorted(part, cut, side="right")
        grow(part[:at], depth + 1)
        cuts.append(cut)
        grow(part[at:], depth + 1)

    grow(x, 0)
    return np.array(cuts), np.array(heights)


def iforest_sample(df: DataFrame, spec: SeriesSpec, trees: int = TREES, psi: int = PSI,
                   seed: int = 42, once: bool = False, params: DataFrame | None = None) -> DataFrame:
    """Rows (groups, ``tree``, feature): up to ``psi`` random rows per series and tree.

    With ``once``, series of ``psi`` rows or less have tree 0 only, as all their samples are the same. ``params`` may have
    per series its own ``num_of_trees``.
    """
    known = df.where(F.col(spec.feature).isNotNull())
    sizes = known.groupBy(*spec.groups).agg(F.count(F.lit(1)).alias("known"))
    sizes = sizes.withColumn("sample_size", F.least(F.lit(psi), F.col("known")).cast("long"))
    own = F.lit(trees)
    if params is not None:
        sizes = join_on(sizes, params.select(*spec.groups, F.col("num_of_trees").alias("_trees")), spec.groups, "left")
        own = F.coalesce(F.col("_trees"), own)
        trees = max(trees, params.agg(F.max("num_of_trees")).first()[0] or 0)
    sizes = sizes.withColumn("rounds", F.when(F.lit(once) & (F.col("known") <= psi), 1).otherwise(own)).drop("_trees")
    drawn = draw_rounds(known, sizes, spec, trees, spec.feature, seed)
    return drawn.withColumnRenamed("round", "tree")


def tree_heights(sample: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Expected path length at each distinct sampled value, per series and tree."""
    y = spec.feature
    schema = T.StructType([sample.schema[c] for c in (*spec.groups, "tree", y)]
                          + [T.StructField("height", T.DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, height = expected_path(part[y].to_numpy(float))
        out = pd.DataFrame({g: [part[g].iloc[0]] * x.size for g in (*spec.groups, "tree")})
        return out.assign(**{y: x, "height": height})

    return sample.groupBy(*spec.groups, "tree").applyInPandas(run, schema)


def interpolated(x: np.ndarray, knots: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """A curve at ``x``: linear between knots, or a step curve where there is one more height than knots."""
    if heights.size == knots.size + 1:
        return heights[np.searchsorted(knots, x, side="left")]
    return np.interp(x, knots, heights)


def merged(curves: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of curves (knots, heights, trees), weighted by their trees, at all of their knots."""
    total = sum(n for _, _, n in curves)
    if any(h.size == x.size + 1 for x, h, _ in curves):
        cuts = np.concatenate([x for x, _, _ in curves])
        jumps = np.concatenate([np.diff(h) * n for _, h, n in curves])
        order = np.argsort(cuts, kind="stable")
        steps = np.concatenate([[0.0], np.cumsum(jumps[order])])
        return cuts[order], (sum(h[0] * n for _, h, n in curves) + steps) / total
    knots = np.unique(np.concatenate([x for x, _, _ in curves]))
    return knots, sum(np.interp(knots, x, h) * n for x, h, n in curves) / total


def reduced(knots: np.ndarray, heights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """A curve with at most ``most`` knots, and how far it is from the given one at most.

    Knots are kept where the curve bends or jumps most; the distance is measured at all knots, where it is largest.
    """
    if knots.size <= most:
        return knots, heights, 0.0
    if heights.size == knots.size + 1:
        weight = np.abs(np.diff(heights))
        weight += (weight.sum() + 1e-300) / weight.size
        run = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * most, most - 1e-9).astype(int)
        first = np.flatnonzero(np.diff(run, prepend=-1))  # the first cut of each run of cuts stays
        low, high = (f.reduceat(heights[1:], first) for f in (np.minimum, np.maximum))
        return knots[first], np.concatenate([heights[:1], (low + high) / 2]), float((high - low).max() / 2)
    slope = np.diff(heights) / np.diff(knots)
    width = (knots[2:] - knots[:-2]) / 2
    bend = np.sqrt(np.abs(np.diff(slope)) * width)
    weight = np.concatenate([[0.0], bend + (bend.sum() + 1e-300) / bend.size, [0.0]])
    at = np.searchsorted(np.cumsum(weight), np.linspace(0, weight.sum(), most))
    kept = np.unique(np.concatenate([[0], np.clip(at, 0, knots.size - 1)[1:-1], [knots.size - 1]]))
    error = np.abs(np.interp(knots, knots[kept], heights[kept]) - heights).max()
    return knots[kept], heights[kept], float(error)


CURVE = "struct<knots: array<double>, heights: array<double>, trees: int, error: double>"


def _series_name(spec: SeriesSpec):
    return F.to_json(F.struct(*spec.groups), {"ignoreNullFields": "false"}) if spec.groups else F.lit("{}")


def tree_curves(sample: DataFrame, spec: SeriesSpec, mode: str = "exact", seed: int = 42) -> DataFrame:
    """One row per series and tree: ``size`` (rows of the tree's sample) and ``curve``, the path length over the value."""
    @F.pandas_udf(CURVE)
    def grow(values: pd.Series, name: pd.Series, tree: pd.Series) -> pd.DataFrame:
        rows = []
        for v, n, t in zip(values, name, tree, strict=True):
            v = np.asarray(v, float)
            x, height = expected_path(v) if mode == "exact" else random_tree(v, np.random.default_rng([seed, n, t]))
            rows.append((x, height, 1, 0.0))
        return pd.DataFrame(rows, columns=["knots", "heights", "trees", "error"])

    rows = sample.groupBy(*spec.groups, "tree").agg(F.collect_list(spec.feature).alias("values"))
    name = F.crc32(_series_name(spec).cast("binary"))
    return rows.select(*spec.groups, "tree", F.size("values").alias("size"), grow("values", name, "tree").alias("curve"))


def merge_curves(curves: DataFrame, groups, most: int | None = None) -> DataFrame:
    """One row per group from rows with ``tree`` (a number), ``size`` and ``curve``: ``size`` and the mean ``curve``.

    ``MERGED`` curves at a time are merged, level by level; on the way a curve keeps twice ``most`` knots, so no step sees more than
    MERGED times as many.
    """
    @F.pandas_udf(CURVE)
    def merge(parts: pd.Series, limit: pd.Series) -> pd.DataFrame:
        rows = []
        for some, most in zip(parts, limit, strict=True):
            some = sorted(some, key=lambda c: c["tree"])
            each = [(np.asarray(c["curve"]["knots"], float), np.asarray(c["curve"]["heights"], float), c["curve"]["trees"]) for c in some]
            total = sum(n for _, _, n in each)
            knots, heights = merged(each)
            error = sum(c["curve"]["error"] * c["curve"]["trees"] for c in some) / total
            if most > 0:
                knots, heights, more = reduced(knots, heights, most)
                error += more
            rows.append((knots, heights, total, error))
        return pd.DataFrame(rows, columns=["knots", "heights", "trees", "error"])

    last = curves.agg(F.max("tree")).first()[0] if most else 0
    while True:
        bucket = F.call_function("div", F.col("tree").cast("long"), F.lit(MERGED).cast("long")) if most else F.lit(0).cast("long")
        packed = curves.select(*groups, bucket.alias("bucket"), "size", F.struct("tree", "curve").alias("part"))
        curves = packed.groupBy(*groups, "bucket").agg(F.max("size").alias("size"), F.collect_list("part").alias("parts"))
        last = (last or 0) // MERGED
        limit = F.lit(0 if not most else 2 * most if last else most)
        curves = curves.select(*groups, F.col("bucket").alias("tree"), "size", merge("parts", limit).alias("curve"))
        if not last:
            return curves.drop("tree")


def as_models(curves: DataFrame, groups) -> DataFrame:
    """The columns of a model: ``knots``, ``heights``, ``path_norm`` and ``path_error``, written once."""
    n = F.col("size")
    norm = F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + EULER) - 2 * (n - 1) / n)
    return materialize(curves.select(*groups, "curve.knots", "curve.heights", norm.cast("double").alias("path_norm"),
                                     F.col("curve.error").alias("path_error")), "curves")


def fit_curves(sample: DataFrame, spec: SeriesSpec, mode: str = "exact", seed: int = 42, most: int | None = KNOTS) -> DataFrame:
    """One row per series: the forest as a curve (``knots``, ``heights``), the normaliser ``path_norm``, and ``path_error``, how far
    its path lengths are from those of the whole forest at most.

    A curve has at most ``most`` knots; None keeps those of all trees.
    """
    trees = materialize(tree_curves(sample, spec, mode, seed), "trees")
    return as_models(merge_curves(trees, spec.groups, most), spec.groups)


def curve_score(y: np.ndarray, knots: np.ndarray, heights: np.ndarray, norm: float) -> np.ndarray:
    """``-2 ** (-E[h] / norm)``; linear between knots, or a step curve where there
    is one more height than knots. A missing value is scored as 0."""
    height = interpolated(np.where(np.isnan(y), 0.0, y), knots, heights)
    return -np.power(2.0, -height / norm) if norm > 0 else np.full(y.shape, -0.5)


def _sent(models: DataFrame, spec: SeriesSpec) -> dict[str, tuple] | None:
    """The models by the name of their series, where their measured size allows it. Read ``models`` from storage."""
    sizes = models.agg(F.sum(8 * (F.size("knots") + F.size("heights")) + 400).alias("bytes")).first()["bytes"] or 0
    if sizes > MODEL_BYTES:
        return None
    rows = models.select(_series_name(spec).alias("name"), "knots", "heights", "path_norm").collect()
    return {r["name"]: (np.asarray(r["knots"], float), np.asarray(r["heights"], float), r["path_norm"]) for r in rows}


def score_iforest(df: DataFrame, curves: DataFrame, spec: SeriesSpec, name: str = "anomaly_score_2",
                  hot: HotSeries | None = None) -> DataFrame:
    """Add the score of every row; series without a curve get NULL.

    Models that are small by measure are sent to the tasks and looked up in place, so rows do not move and only the
    feature and the series' name reach Python. Larger tables of models meet the rows by key in groups of bounded size.
    """
    sent = _sent(curves, spec)
    if sent is None:
        return _score_by_key(df, curves, spec, name, hot)
    shared = df.sparkSession.sparkContext.broadcast(sent)

    @F.pandas_udf("double")
    def look_up(value: pd.Series, names: pd.Series) -> pd.Series:
        out = np.full(len(value), np.nan)
        code, series_names = pd.factorize(names)
        for k, one in enumerate(series_names):
            if one in shared.value:
                mine = code == k
                out[mine] = curve_score(value.to_numpy(float)[mine], *shared.value[one])
        return pd.Series(out)

    score = look_up(F.col(spec.feature).cast("double"), _series_name(spec))
    return df.withColumn(name, score).withColumn(name, F.nanvl(name, F.lit(None).cast("double")))


def _score_by_key(df: DataFrame, curves: DataFrame, spec: SeriesSpec, name: str, hot: HotSeries | None) -> DataFrame:
    y, keys = spec.feature, list(spec.groups)
    hot = hot or hot_series(df, spec, series.ROWS_PER_GROUP)
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType())])
    if hot.table is None:
        df, curves = df.withColumn("_slots", F.lit(1)), curves.withColumn("_slots", F.lit(1))
    else:
        table = F.broadcast(hot.table.select(*keys, slots_for(F.col("_rows")).alias("_slots")))
        one = F.coalesce("_slots", F.lit(1))
        df = join_on(df, table, keys, "left").withColumn("_slots", one)
        curves = join_on(curves, table, keys, "left").withColumn("_slots", one)

    def run(rows: pd.DataFrame, curve: pd.DataFrame) -> pd.DataFrame:
        if len(curve) == 0:
            return rows.assign(**{name: np.nan})
        c = curve.iloc[0]
        score = curve_score(rows[y].to_numpy(float), np.asarray(c["knots"], float),
                            np.asarray(c["heights"], float), c["path_norm"])
        return rows.assign(**{name: score})

    scored = meet(df, curves, spec, schema, run)
    return scored.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))


def contamination_threshold(scored: DataFrame, spec: SeriesSpec, contamination: float = 0.01,
                            score: str = "anomaly_score_2", name: str = "threshold",
                            hot: HotSeries | None = None) -> DataFrame:
    """Per series the score below which the share ``contamination`` of rows lies."""
    return exact_percentile(scored, spec.groups, score, contamination, name, hot)


def label_iforest(score, threshold):
    """1 where the score is below the threshold."""
    return F.when(score < threshold, 1).otherwise(0)


def fit_iforest(df: DataFrame, spec: SeriesSpec, contamination: float = 0.01,
                trees: int | None = None, mode: str = "exact", seed: int = 42,
                hot: HotSeries | None = None, most: int | None = KNOTS, params: DataFrame | None = None) -> DataFrame:
    """Model rows: groups, ``knots``, ``heights``, ``path_norm``, ``path_error``, ``threshold``.

    ``params`` has per series ``contamination`` and ``num_of_trees``; a series without them, or a null, has the arguments' values.
    """
    trees = trees or TREES
    hot = hot or hot_series(df, spec, series.ROWS_PER_GROUP)
    curves = fit_curves(iforest_sample(df, spec, trees, PSI, seed, mode == "exact", params), spec, mode, seed, most)
    scored = score_iforest(df.select(*spec.groups, *spec.order, spec.feature), curves, spec, hot=hot)
    if params is None:
        return join_on(curves, contamination_threshold(scored, spec, contamination, hot=hot), spec.groups)
    shares = params.select(*spec.groups, F.coalesce("contamination", F.lit(contamination)).alias("_share"))
    # The shares that occur are few: they come from a grid.
    levels = sorted({r["_share"] for r in shares.select("_share").distinct().limit(MOST_SHARES + 1).collect()} | {contamination})
    if len(levels) > MOST_SHARES:
        raise ValueError(f"more than {MOST_SHARES} different contaminations")
    limits = exact_percentiles(scored, spec.groups, "anomaly_score_2", levels, "_limits", hot)
    limits = join_on(limits, shares, spec.groups, "left")
    own = F.array_position(F.array(*[F.lit(x) for x in levels]), F.coalesce("_share", F.lit(contamination)))
    return join_on(curves, limits.select(*spec.groups, F.get("_limits", own.cast("int") - 1).alias("threshold")), spec.groups)


def predict_iforest(df: DataFrame, models: DataFrame, spec: SeriesSpec,
                    hot: HotSeries | None = None) -> DataFrame:
    """Add ``anomaly_score_2`` and ``ad_label_2``."""
    curves = models.select(*spec.groups, "knots", "heights", "path_norm")
    out = score_iforest(df, curves, spec, hot=hot)
    out = join_on(out, models.select(*spec.groups, "threshold"), spec.groups, "left")
    label = label_iforest(F.col("anomaly_score_2"), F.col("threshold"))
    return out.withColumn("ad_label_2", label).drop("threshold")
