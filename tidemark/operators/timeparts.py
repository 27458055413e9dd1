"""Which calendar parts split a series into statistically different groups."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import PARTS, date_part
from tidemark.functions.kernels import t_critical, t_ppf, t_two_sided
from tidemark.functions.sampling import DRAW_RANGE, add_hashes, cap_sample, draw, enough
from tidemark.spec import SeriesSpec

# Sample cap, sample share and level of the resampled tests, and the
# limits that decide; the last two apply once a coarser part has been accepted.
SAMPLE_CAP = 100000
SAMPLE_SHARE = 0.6
TEST_ALPHA = 0.05
H0_SHARE, PAIR_SHARE = 0.9, 0.5
RELAXED_H0_SHARE, RELAXED_PAIR_SHARE = 0.7, 0.7
DAY_OF_YEAR = 366

# Fixed values, one line per part: the grains it is not offered for, or those it
# needs, and the accepted coarser parts that make it redundant.
WEEKLY = ("week", "week_part", "week_day", "day")
RULES = {
    "year": ("not", WEEKLY, ()),
    "quarter": ("not", WEEKLY, ("year",)),
    "month": ("not", WEEKLY, ("quarter",)),
    "week": ("in", ("hour", "min", "second"), ("year", "quarter", "month")),
    "week_part": ("in", ("day", "hour"), ()),
    "week_day": ("in", ("hour", "min", "second"), ("week_part",)),
    "day_part": ("in", ("min", "second"), ()),
    "hour": ("in", ("second",), ("day_part",)),
}
RELAXED_BY = {"quarter": ("year",), "month": ("year", "quarter"),
              "week": ("year", "quarter", "month")}


def _span(time: str) -> Column:
    return (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6


def span_seconds(df: DataFrame, time: str) -> DataFrame:
    """One row: seconds from the first to the last time."""
    return df.agg(_span(time).alias("span_seconds"))


def _overview(df: DataFrame, time: str) -> DataFrame:
    """One row: ``grain``, ``candidates`` and ``span_seconds``, in one pass."""
    varies = [(F.min(date_part(time, p)) != F.max(date_part(time, p))).alias(p) for p in PARTS]
    grain = F.lit(None).cast("string")
    coarser = F.lit(None).cast("string")
    for i, part in enumerate(PARTS):
        # Later, finer parts take precedence.
        grain = F.when(F.col(part), F.lit(part)).otherwise(grain)
        coarser = F.when(F.col(part), F.lit("*".join(PARTS[:i]))).otherwise(coarser)
    facts = df.agg(*varies, _span(time).alias("span_seconds"))
    return facts.select(grain.alias("grain"), coarser.alias("candidates"), "span_seconds")


def finest_part(df: DataFrame, time: str) -> DataFrame:
    """One row: ``grain``, the finest calendar part with two values, and
    ``candidates``, the coarser parts joined by ``*``. NULL if all times are equal."""
    return _overview(df, time).select("grain", "candidates")


def part_allowed(part: str, grain: Column, accepted: Column) -> Column:
    """Whether ``part`` is worth testing, given the grain and the array of accepted parts."""
    if part not in RULES:
        return F.lit(False)
    sense, grains, blockers = RULES[part]
    fits = grain.isin(*grains) if sense == "in" else ~grain.isin(*grains)
    for b in blockers:
        fits = fits & ~F.array_contains(accepted, b)
    return F.coalesce(fits, F.lit(False))


def _allowed(part: str, grain: str | None, accepted) -> bool:
    if grain is None or part not in RULES:
        return False
    sense, grains, blockers = RULES[part]
    return ((grain in grains) == (sense == "in")) and not set(blockers) & set(accepted)


def span_gate(part: str, span: Column, compat: bool = True) -> Column:
    """Whether the time span is long enough for the part.

    With ``compat`` only year, quarter and hour can pass at all.
    """
    days = F.floor(span / 86400)
    if part == "year":
        return days >= 2 * DAY_OF_YEAR
    if part == "quarter":
        return days >= DAY_OF_YEAR
    return F.lit(part == "hour" or not compat)


def part_counts(df: DataFrame, time: str, part: str) -> DataFrame:
    return df.groupBy(date_part(time, part).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("rows"))


def part_counts_ok(df: DataFrame, time: str, part: str) -> DataFrame:
    """One row: ``ok`` if the part has two or more values, none of them occurring once."""
    ok = (F.count(F.lit(1)) >= 2) & (F.min("rows") > 1)
    return part_counts(df, time, part).agg(F.coalesce(ok, F.lit(False)).alias("ok"))


def level_pairs(levels: DataFrame, *columns: str) -> DataFrame:
    """All pairs of a part's values, ``a`` before ``b``; columns get ``_a`` and ``_b``.

    Works on aggregated rows, one per calendar value (24 hours, a few dozen
    quarters), never on data rows: the test is defined over these pairs.
    """
    entry = F.struct("level", *columns)
    one = levels.agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    pairs = F.flatten(F.transform("_all", lambda a: F.transform(
        F.filter("_all", lambda b: b["level"] > a["level"]),
        lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = one.select(F.explode(pairs).alias("_p"))
    picked = [F.col(f"_p.{side}.{c}").alias(f"{c}_{side}")
              for c in ("level", *columns) for side in ("a", "b")]
    return out.select(*picked)


def t_statistic(mean1, mean2, var1, var2, n1, n2) -> Column:
    """Two-sample t; without spread NULL for equal means, infinite otherwise."""
    error = F.sqrt(var1 / n1 + var2 / n2)
    flat = F.when(mean1 != mean2, F.lit(float("inf")))
    return F.when(error > 0, (mean1 - mean2) / error).otherwise(flat)


def t_test(df: DataFrame, mean1: str, mean2: str, var1: str, var2: str, n1: str, n2: str,
           alpha: float = TEST_ALPHA) -> DataFrame:
    """Add ``t``, ``dof``, ``confidence``, ``ci_low``, ``ci_high`` and ``rejected``.

    ``confidence`` is one minus the two-sided p-value; the hypothesis of equal
    means is rejected above ``1 - alpha / 2``. Variances are population variances.
    """
    c = {k: F.col(v) for k, v in dict(m1=mean1, m2=mean2, v1=var1, v2=var2, n1=n1, n2=n2).items()}
    error = F.sqrt(c["v1"] / c["n1"] + c["v2"] / c["n2"])
    out = df.withColumn("t", t_statistic(c["m1"], c["m2"], c["v1"], c["v2"], c["n1"], c["n2"]))
    out = out.withColumn("dof", c["n1"] + c["n2"] - 2)
    out = out.withColumn("confidence", 1 - t_two_sided(F.col("t"), F.col("dof")))
    half = t_critical(1 - alpha / 2, F.col("dof")) * error
    gap = F.abs(c["m1"] - c["m2"])
    rejected = F.coalesce(F.col("confidence") > 1 - alpha / 2, F.lit(False)).cast("int")
    return (out.withColumn("_half", half)
            .withColumns({"ci_low": gap - F.col("_half"), "ci_high": gap + F.col("_half"),
                          "rejected": rejected}).drop("_half"))


def bootstrap_rounds(smaller: Column) -> Column:
    """Test rounds for a pair, by the size of its smaller sample."""
    share = (F.when(smaller < 1000, F.lit(0.1))
             .when((smaller > 1000) & (smaller < 10000), F.lit(0.01)).otherwise(F.lit(0.0001)))
    return F.greatest(F.lit(1), F.floor(smaller * share)).cast("long")


def _rounds_of(n: int) -> int:
    share = 0.1 if n < 1000 else 0.01 if 1000 < n < 10000 else 0.0001
    return max(1, int(n * share))


def _pair_plan(levels, cap: int, spark, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Small tables made from the counts per calendar value, of which there are 60
    at most, or as many as years or quarters. Per value and pair the sample size,
    rounds and critical value; per value the most rows and rounds its pairs need."""
    found = sorted((r["level"], min(r["n"], cap), r["center"]) for r in levels)
    pairs, needs = [], {}
    for (a, n_a, _), (b, n_b, _) in combinations(found, 2):
        smaller = min(n_a, n_b)
        pairs.append((a, b, int(smaller * SAMPLE_SHARE), _rounds_of(smaller)))
        for level in (a, b):
            needs.setdefault(level, []).append(pairs[-1][2:])
    dofs = sorted({2 * m - 2 for _, _, m, _ in pairs if m > 1})
    crit = dict(zip(dofs, t_ppf(np.full(len(dofs), 1 - alpha / 4), np.array(dofs, float)).tolist()))
    rows = [(level, a, b, m, k, crit.get(2 * m - 2)) for a, b, m, k in pairs for level in (a, b)]
    sides = spark.createDataFrame(
        rows, "level string, level_a string, level_b string, m bigint, rounds bigint, _crit double")
    per_level = [(level, n, center, *map(max, zip(*needs[level]))) for level, n, center in found if level in needs]
    wanted = spark.createDataFrame(
        per_level, "level string, n bigint, center double, _largest bigint, _rounds bigint")
    return sides, wanted


def bootstrap_t_test(df: DataFrame, part: Column, spec: SeriesSpec, seed: int = 0,
                     cap: int = SAMPLE_CAP, alpha: float = TEST_ALPHA) -> DataFrame:
    """For each pair of the part's values, the share of rounds that accept equal means.

    Each value's sample is ranked once per round; the first m rows of the ranking
    are the draw of size m, so running sums give the moments of every size that
    some pair needs. Work is bounded by values * rounds * cap.
    """
    y = spec.feature
    rows = df.select(part.cast("string").alias("level"), *spec.tie, F.col(y).cast("double").alias(y))
    rows = rows.where(F.col(y).isNotNull())
    levels = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("center")).collect()
    sides, wanted = _pair_plan(levels, cap, df.sparkSession, alpha)
    if any(r["n"] > cap for r in levels):
        rows = cap_sample(rows, ["level"], spec.tie, cap, seed)
    # What is left is bounded, and is about to be multiplied by the rounds.
    rows = rows.repartition(*spec.tie)

    limit = enough(F.col("_largest").cast("double")) / F.col("n") * F.lit(float(DRAW_RANGE))
    drawn = add_hashes(rows, spec.tie, seed + 1).join(F.broadcast(wanted), "level")
    drawn = drawn.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rounds") - 1)))
    drawn = drawn.withColumn("_draw", draw(F.col("round"))).where(F.col("_draw") <= limit)
    drawn = drawn.select("level", "round", "_draw", *spec.tie, "center",
                         (F.col(y) - F.col("center")).alias("_d"))
    w = Window.partitionBy("level", "round").orderBy("_draw", *spec.tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ranked = drawn.withColumns({
        "m": F.row_number().over(w).cast("long"), "_s": F.sum("_d").over(upto),
        "_q": F.sum(F.col("_d") * F.col("_d")).over(upto)})
    shift = F.col("_s") / F.col("m")
    # Each pair takes its two values' moments at the rank that is its sample size.
    runs = ranked.join(F.broadcast(sides), ["level", "m"]).where(F.col("round") < F.col("rounds"))
    runs = runs.withColumns({
        "mean": F.col("center") + shift,
        "var": F.greatest(F.col("_q") / F.col("m") - shift * shift, F.lit(0.0))})
    first = F.col("level") == F.col("level_a")
    picked = [F.max(F.when(first if side == "a" else ~first, F.col(c))).alias(f"{c}_{side}")
              for c in ("mean", "var") for side in ("a", "b")]
    runs = runs.groupBy("level_a", "level_b", "m", "rounds", "_crit", "round").agg(*picked)
    t = t_statistic(*[F.col(c) for c in ("mean_a", "mean_b", "var_a", "var_b", "m", "m")])
    accepted = F.coalesce(F.abs(t) <= F.col("_crit"), t.isNull()).cast("double")
    return runs.groupBy("level_a", "level_b", "m", "rounds").agg(F.avg(accepted).alias("h0_share"))


def part_is_significant(tested: DataFrame, relaxed: bool = False) -> DataFrame:
    """One row: how many pairs differ, and whether that is enough."""
    h0, share = (RELAXED_H0_SHARE, RELAXED_PAIR_SHARE) if relaxed else (H0_SHARE, PAIR_SHARE)
    out = tested.agg(F.count(F.lit(1)).alias("pairs"),
                     F.coalesce(F.sum((F.col("h0_share") < h0).cast("long")), F.lit(0)).alias("differing"))
    verdict = (F.col("differing") > F.col("pairs") * share).cast("int")
    return out.withColumn("significant", verdict)


def t_test_exact(df: DataFrame, part: Column, spec: SeriesSpec, alpha: float = TEST_ALPHA) -> DataFrame:
    """The same tests on the moments of all rows, without resampling."""
    y = spec.feature
    levels = (df.where(F.col(y).isNotNull())
              .groupBy(part.cast("string").alias("level"))
              .agg(F.avg(y).alias("mean"), F.var_pop(y).alias("var"), F.count(F.lit(1)).alias("n")))
    pairs = level_pairs(levels, "mean", "var", "n")
    return t_test(pairs, "mean_a", "mean_b", "var_a", "var_b", "n_a", "n_b", alpha)


@dataclass(frozen=True)
class PartDecision:
    part: str
    tested: bool
    pairs: int
    differing: int
    accepted: bool


def select_time_parts(df: DataFrame, spec: SeriesSpec, seed: int = 0, compat: bool = True,
                      exact: bool = False) -> list[PartDecision]:
    """Decide the calendar parts from coarse to fine; one Spark job per tested part."""
    passes = [span_gate(p, F.col("span_seconds"), compat).alias(p) for p in PARTS]
    first = _overview(df, spec.time).select("grain", "candidates", *passes).first()
    grain = first["grain"]
    if grain is None:
        return []
    decisions: list[PartDecision] = []
    accepted: set[str] = set()
    for part in [p for p in first["candidates"].split("*") if p]:
        if part in spec.groups:
            continue
        tested = bool(first[part]) and _allowed(part, grain, accepted)
        tested = tested and part_counts_ok(df, spec.time, part).first()["ok"]
        pairs = differing = 0
        if tested:
            column = date_part(spec.time, part)
            if exact:
                result = t_test_exact(df, column, spec)
                result = result.withColumn("h0_share", 1.0 - F.col("rejected"))
            else:
                result = bootstrap_t_test(df, column, spec, seed)
            relaxed = bool(set(RELAXED_BY.get(part, ())) & accepted)
            row = part_is_significant(result, relaxed).first()
            pairs, differing = row["pairs"], row["differing"]
            if row["significant"]:
                accepted.add(part)
        decisions.append(PartDecision(part, tested, pairs, differing, part in accepted))
    return decisions


def accepted_parts(decisions: list[PartDecision]) -> list[str]:
    return [d.part for d in decisions if d.accepted]


def apply_time_parts(df: DataFrame, spec: SeriesSpec, parts) -> tuple[DataFrame, SeriesSpec]:
    """Add the parts as columns and to the groups; parts may be text joined by ``*``."""
    if isinstance(parts, str):
        parts = parts.split("*")
    parts = [p for p in parts if p and p not in spec.groups]
    out = df.withColumns({p: date_part(spec.time, p) for p in parts}) if parts else df
    return out, spec.with_groups([*spec.groups, *parts])
