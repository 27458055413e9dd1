"""Bayesian and classical scores of forecast residuals.

Per series, ``rounds`` random subsets of the residuals give 30 small summaries;
every residual is then folded over these summaries into the parameters of a
Beta distribution, whose quantile is the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import beta_quantile, t_critical, t_two_sided
from tidemark.functions.sampling import DRAW_RANGE, add_hashes, draw, enough, rounds_within, smallest
from tidemark.operators.series import attach_stats, join_on
from tidemark.spec import SeriesSpec

# Rounds, confidence level, pool size, and label limits of the score.
ROUNDS = 30
ALPHA = 0.01
POOL = 10000
# Up to so many rounds each row is drawn for all of them in place.
FEW_ROUNDS = 64
LOW, HIGH = 0.05, 0.95


def sample_size(rows: Column, known: Column) -> Column:
    """Rows drawn per round from a series of ``rows`` rows, ``known`` of them usable."""
    size = (F.when(rows >= 2000, F.lit(1000)).when(rows > 30, F.floor(rows * 0.5))
            .otherwise(F.lit(5))).cast("long")
    return F.greatest(F.when(known > size, size).otherwise(known - 2), F.lit(1)).cast("long")


def sample_sizes(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series: ``rows``, ``known`` and ``sample_size``."""
    counts = df.groupBy(*spec.groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count(spec.feature).alias("known"))
    return counts.withColumn("sample_size", sample_size(F.col("rows"), F.col("known")))


def draw_rounds(df: DataFrame, sizes: DataFrame, spec: SeriesSpec, rounds: int,
                value: str, seed: int = 0) -> DataFrame:
    """Rows (groups, ``round``, ``value``) of ``rounds`` random subsets per series.

    ``sizes`` has per series ``known`` (rows to draw from) and ``sample_size``, and
    may have ``rounds``, the number of rounds of the series up to ``rounds``.
    A row stays only in the rounds in which its draw is small enough, so what is
    shuffled and ranked is bounded by rounds * sample size, not by the series. A few rounds are tried
    in place; of many, only those in which the row is drawn are made, in Arrow batches. Either way no row is multiplied before.
    """
    limit = enough(F.col("sample_size").cast("double")) / F.col("known") * F.lit(float(DRAW_RANGE))
    last = (F.col("rounds") if "rounds" in sizes.columns else F.lit(rounds)).cast("int").alias("_rounds")
    rows = add_hashes(df.select(*spec.groups, *spec.tie, value), spec.tie, seed)
    rows = join_on(rows, sizes.select(*spec.groups, "known", "sample_size", last), spec.groups)
    if rounds <= FEW_ROUNDS:
        every = F.filter(F.sequence(F.lit(0), F.col("_rounds") - 1), lambda k: draw(k) <= limit)
    else:
        every = rounds_within("_h1", "_h2", limit, "_rounds")
    rows = rows.withColumn("_every", every).withColumn("round", F.explode("_every")).drop("_every")
    rows = rows.withColumn("_draw", draw(F.col("round")))
    chosen = smallest(rows, [*spec.groups, "round"], spec.tie, F.col("sample_size"))
    return chosen.select(*spec.groups, "round", value)


def scaled_residual(df: DataFrame, spec: SeriesSpec, residual: str = "residuals") -> DataFrame:
    """Min-max scaled residual per series, and the mean of the scaled residuals."""
    r = F.coalesce(F.col(residual), F.lit(0.0))
    out = attach_stats(df, spec.groups, F.min(r).alias("_rmin"), F.max(r).alias("_rmax"),
                       F.avg(r).alias("_ravg"))
    width = F.col("_rmax") - F.col("_rmin")

    def scaled(v):
        return F.when(width == 0, F.lit(0.0)).otherwise((v - F.col("_rmin")) / width)

    return (out.withColumns({"scaled": scaled(r), "mean_scaled": scaled(F.col("_ravg"))})
            .drop("_rmin", "_rmax", "_ravg"))


def residual_rounds(df: DataFrame, spec: SeriesSpec, residual: str = "residuals",
                    rounds: int = ROUNDS, seed: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """Per series and round: minimum, maximum, range and scaled mean of the subset."""
    sizes = sample_sizes(df, spec) if sizes is None else sizes
    known = df.where(F.col(spec.feature).isNotNull())
    chosen = draw_rounds(known, sizes, spec, rounds, residual, seed)
    width = F.col("round_max") - F.col("round_min")
    mean = F.when(width == 0, F.lit(0.0)).otherwise((F.col("_avg") - F.col("round_min")) / width)
    return (chosen.groupBy(*spec.groups, "round")
            .agg(F.min(residual).alias("round_min"), F.max(residual).alias("round_max"),
                 F.avg(residual).alias("_avg"))
            .withColumns({"round_range": width, "round_mean": mean}).drop("_avg"))


def fold_rounds(value: Column, rounds: Column, size: Column, carry: bool) -> Column:
    """Beta parameters (struct ``a``, ``b``) of a value over the rounds of its series, an array in their order."""
    one = F.lit(1).cast("long")
    start = F.struct(one.alias("a"), one.alias("b"), F.lit(1.0).alias("share"))

    def step(state: Column, r: Column) -> Column:
        inside = (value > r["round_min"]) & (value < r["round_max"])
        at = (value - r["round_min"]) / F.when(r["round_range"] == 0, 1.0).otherwise(r["round_range"])
        moved = F.when(at < r["round_mean"], at + 0.5).otherwise(at)
        return F.struct(state["a"], state["b"], F.when(inside, moved).otherwise(state["share"] if carry else F.lit(1.0)).alias("share"))

    def count(state: Column) -> Column:
        share = state["share"]
        return F.struct((state["a"] + (size * (1 - share)).cast("long")).alias("a"), (state["b"] + (size * share).cast("long")).alias("b"),
                        share.alias("share"))

    # The share is bound first, as both sums use it.
    return F.aggregate(rounds, start, lambda s, r: F.get(F.transform(F.array(step(s, r)), count), F.lit(0)),
                       lambda s: F.struct(s["a"], s["b"]))


def beta_params(df: DataFrame, rounds: DataFrame, sizes: DataFrame, spec: SeriesSpec,
                residual: str = "residuals", carry: bool = True, score: str | None = None) -> DataFrame:
    """Add ``p``, ``a`` and ``b`` of each residual, and the quantile as ``score``.

    Rounds run in order. A value outside a round's range keeps the share of the
    round before (``carry``), which starts at 1. The rounds of a series are one array column, joined by measured size
    and folded in place; rows of a series without rounds are left out.
    """
    if "scaled" not in df.columns:
        df = scaled_residual(df, spec, residual)
    p = F.when(F.col(residual) < F.col("mean_scaled"), F.col("scaled") + 0.5).otherwise(F.col("scaled"))
    df = df.withColumn("p", p).drop("scaled", "mean_scaled")
    each = F.array_sort(F.collect_list(F.struct("round", "round_min", "round_max", "round_range", "round_mean")))
    side = join_on(rounds.groupBy(*spec.groups).agg(each.alias("_rounds")), sizes.select(*spec.groups, "sample_size"), spec.groups)
    out = join_on(df, side, spec.groups)
    out = out.withColumn("_ab", fold_rounds(F.col(residual), F.col("_rounds"), F.col("sample_size"), carry))
    out = out.withColumns({"a": F.col("_ab.a"), "b": F.col("_ab.b")}).drop("_ab", "_rounds", "sample_size")
    return out.withColumn(score, beta_quantile("p", F.col("a"), F.col("b"))) if score else out


def label_two_tail(score: Column) -> Column:
    """1 for a score in either tail; no score, no anomaly."""
    return F.when((score < LOW) | (score > HIGH), 1).otherwise(0)


def beta_score(df: DataFrame, spec: SeriesSpec, residual: str = "residuals",
               rounds: int = ROUNDS, seed: int = 0, carry: bool = True) -> DataFrame:
    """Add ``anomaly_score_1`` and ``ad_label_1`` from the residuals."""
    sizes = sample_sizes(df, spec)
    summary = residual_rounds(df, spec, residual, rounds, seed, sizes)
    out = beta_params(df, summary, sizes, spec, residual, carry, "anomaly_score_1")
    return (out.withColumn("ad_label_1", label_two_tail(F.col("anomaly_score_1")))
            .drop("p", "a", "b"))


def student_t_score(df: DataFrame, spec: SeriesSpec, residual: str = "residuals") -> DataFrame:
    """Add ``t_value`` and the two-sided p-value of each residual's distance from
    the series mean; a series without spread gets neither."""
    r = F.coalesce(F.col(residual), F.lit(0.0))
    out = attach_stats(df, spec.groups, F.avg(r).alias("_avg"), F.var_pop(r).alias("_var"),
                       F.count(F.lit(1)).alias("_n"))
    error = F.sqrt(F.col("_var") / F.col("_n"))
    t = F.when(error > 0, F.abs(r - F.col("_avg")) / error)
    out = out.withColumn("t_value", t)
    return (out.withColumn("anomaly_score_1", t_two_sided(F.col("t_value"), F.col("_n") - 1))
            .drop("_avg", "_var", "_n"))


def bayes_value_params(sample: DataFrame, values: DataFrame, spec: SeriesSpec, value: str,
                       rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """``p``, ``a`` and ``b`` of given values against a separate sample of each series.

    Scaled by the sample's bounds; each round stands alone (no carried share).
    """
    y = spec.feature
    bounds = sample.groupBy(*spec.groups).agg(
        F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.avg(y).alias("_avg"))
    width = F.col("_hi") - F.col("_lo")
    out = join_on(values, bounds, spec.groups)
    for name, source in (("scaled", F.col(value)), ("mean_scaled", F.col("_avg"))):
        rel = F.when(width == 0, F.lit(0.0)).otherwise((source - F.col("_lo")) / width)
        out = out.withColumn(name, rel)
    out = out.drop("_lo", "_hi", "_avg")
    sizes = sample_sizes(sample, spec)
    summary = residual_rounds(sample, spec, y, rounds, seed, sizes)
    # The groups of the meeting go by the rows that are scored.
    sizes = join_on(sizes.drop("rows"), values.groupBy(*spec.groups).agg(F.count(F.lit(1)).alias("rows")),
                    spec.groups)
    return beta_params(out, summary, sizes, spec, value, carry=False)


def bayes_score_value(sample: DataFrame, values: DataFrame, spec: SeriesSpec, value: str,
                      rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """Add ``score``, the Beta quantile of :func:`bayes_value_params`."""
    out = bayes_value_params(sample, values, spec, value, rounds, seed)
    return out.withColumn("score", beta_quantile("p", F.col("a"), F.col("b"))).drop("p", "a", "b")


def mean_ci_inlier(df: DataFrame, spec: SeriesSpec, alpha: float = ALPHA,
                   name: str = "inlier") -> DataFrame:
    """1 where the feature lies strictly inside the t interval of the series mean."""
    y = spec.feature
    stats = df.groupBy(*spec.groups).agg(F.avg(y).alias("_avg"), F.var_pop(y).alias("_var"),
                                         F.count(y).alias("_n"))
    half = t_critical(1 - alpha / 2, F.col("_n") - 1) * F.sqrt(F.col("_var") / F.col("_n"))
    stats = stats.select(*spec.groups, "_avg", half.alias("_half"))
    out = join_on(df, stats, spec.groups)
    inside = F.abs(F.col(y) - F.col("_avg")) < F.col("_half")
    return out.withColumn(name, F.when(inside, 1).otherwise(0)).drop("_avg", "_half")


def residual_pool(df: DataFrame, spec: SeriesSpec, ratio: float, seed: int = 0) -> DataFrame:
    """A random subset per series: ``POOL`` rows of a larger one, else that share."""
    counts = df.groupBy(*spec.groups).agg(F.count(F.lit(1)).alias("known"))
    size = F.when(F.col("known") > POOL, F.lit(POOL)).otherwise(F.floor(F.col("known") * ratio))
    counts = counts.withColumn("_size", size.cast("long"))
    rows = join_on(add_hashes(df, spec.tie, seed), counts, spec.groups)
    rows = rows.withColumn("_draw", draw(F.lit(0)))
    limit = enough(F.col("_size").cast("double")) / F.col("known") * F.lit(float(DRAW_RANGE))
    chosen = smallest(rows.where(F.col("_draw") <= limit), spec.groups, spec.tie, F.col("_size"))
    return chosen.select(*df.columns)
