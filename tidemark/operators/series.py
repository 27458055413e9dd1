"""Series statistics and ordered windows that hold up when one series is huge.

A window over ``partitionBy(series).orderBy(time)`` puts a whole series into one
task. That is right for ordinary series and wrong for one with a third of all
rows. So the row counts per series are measured first. Where all series are
within :data:`ROWS_PER_CHUNK`, the plain window is used. Larger series are cut
into runs of consecutive rows (chunks); windows run per chunk, over the chunk's
rows and the few rows just before it, and rank numbers get the counts of the
earlier chunks added. Results are the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize
from tidemark.spec import SeriesSpec

ROWS_PER_CHUNK = 5_000_000
SAMPLED_PER_CHUNK = 64

CHUNK = "_chunk"


def join_on(df: DataFrame, other: DataFrame, groups, how: str = "inner") -> DataFrame:
    """Join a table with one row per series; without groups, its single row.

    The join strategy is left to the measured sizes, except for the single row.
    """
    groups = list(groups)
    if groups:
        return df.join(other, groups, how)
    one = other.withColumn("_one", F.lit(0))
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one", how).drop("_one")


def attach_stats(df: DataFrame, groups, *aggs: Column, how: str = "inner") -> DataFrame:
    """Add per-series aggregates to every row.

    Partial aggregation, then an equi join: a small result is broadcast by its
    measured size, a large one is joined by key with AQE splitting skewed keys.
    """
    return join_on(df, df.groupBy(*groups).agg(*aggs), groups, how)


@dataclass(frozen=True)
class HotSeries:
    """The series with more than ``limit`` rows, if any, and their row counts.

    At most (rows of the table / limit) entries, so it may live on the driver.
    """

    spec: SeriesSpec
    limit: int
    table: DataFrame | None

    def above(self, limit: int) -> "HotSeries":
        """Those with more than a higher limit."""
        if self.table is None:
            return replace(self, limit=limit)
        kept = self.table.where(F.col("_rows") > limit)
        return replace(self, limit=limit, table=None if kept.isEmpty() else kept)


def hot_series(df: DataFrame, spec: SeriesSpec, limit: int | None = None) -> HotSeries:
    limit = limit or ROWS_PER_CHUNK
    return HotSeries(spec, limit, _above(df, list(spec.groups), limit))


def _above(df: DataFrame, groups: list[str], limit: int) -> DataFrame | None:
    """The groups of more than ``limit`` rows and their counts, or None."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > limit).collect()
    return df.sparkSession.createDataFrame(found, counts.schema) if found else None


def _join_hot(df: DataFrame, table: DataFrame, groups, how: str) -> DataFrame:
    """Join with a table of at most (rows / limit) series."""
    return df.join(F.broadcast(table), list(groups), how) if groups else join_on(df, table, [], how)


def _cut_points(df: DataFrame, hot: HotSeries) -> DataFrame:
    """For each hot series, the sorted keys at which a new chunk starts.

    A hash of the key keeps about SAMPLED_PER_CHUNK keys per chunk; every
    SAMPLED_PER_CHUNK-th of them is a cut. The choice only balances the work,
    so results do not depend on it. The cuts (about rows / limit) are collected
    so that every use in the plan sees the same ones.
    """
    spec = hot.spec
    groups, order = list(spec.groups), spec.order
    share = min(1.0, SAMPLED_PER_CHUNK / hot.limit)
    step = SAMPLED_PER_CHUNK if share < 1.0 else hot.limit
    keys = _join_hot(df.select(*groups, *order), hot.table, groups, "inner")
    keys = keys.where(F.pmod(F.xxhash64(*order), F.lit(1_000_000_000)) < int(share * 1e9))
    w = Window.partitionBy(*groups).orderBy(*order)
    cuts = (keys.withColumn("_i", F.row_number().over(w))
            .where(F.col("_i") % step == 0)
            .groupBy(*groups)
            .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("_cuts")))
    return df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def position_in(cuts: Column, key: Column, longest: int) -> Column:
    """How many sorted ``cuts`` are <= ``key``, by halving."""
    steps = F.sequence(F.lit(1), F.lit(max(1, longest.bit_length())))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(cuts, mid) <= key
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(
            F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(right, acc["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(steps, start, halve)["lo"]


def add_chunks(df: DataFrame, hot: HotSeries) -> DataFrame:
    """Column ``_chunk``: 0 for ordinary series, the run number for hot ones."""
    if hot.table is None:
        return df.withColumn(CHUNK, F.lit(0))
    spec = hot.spec
    cuts = _cut_points(df, hot)
    longest = cuts.agg(F.max(F.size("_cuts")).alias("m")).first()["m"] or 0
    out = _join_hot(df, cuts, spec.groups, "left")
    place = position_in(F.col("_cuts"), F.struct(*spec.order), longest)
    place = F.when(F.col("_cuts").isNull(), 0).otherwise(place).cast("int")
    return out.withColumn(CHUNK, place).drop("_cuts")


def _preceding_rows(chunked: DataFrame, hot: HotSeries, k: int) -> DataFrame:
    """The last ``k`` rows ahead of each chunk, labelled with that chunk.

    Only the last k rows of each chunk of hot series are looked at; the row
    limit is applied before the shuffle.
    """
    groups, order = list(hot.spec.groups), hot.spec.order
    rows = _join_hot(chunked, hot.table.drop("_rows"), groups, "left_semi") if groups else chunked
    newest = [F.col(c).desc() for c in order]
    tails = (rows.withColumn("_from_end", F.row_number().over(
                Window.partitionBy(*groups, CHUNK).orderBy(*newest)))
             .where(F.col("_from_end") <= k))
    everything = F.struct(*[F.col(c) for c in chunked.columns])
    w = Window.partitionBy(*groups).orderBy(*order)
    ends = (tails
            .withColumn("_last_rows", F.collect_list(everything).over(w.rowsBetween(-(k - 1), 0)))
            .where(F.col("_from_end") == 1)
            .withColumn("_next", F.lead(CHUNK).over(w))
            .where(F.col("_next").isNotNull()))
    lent = ends.select(F.explode("_last_rows").alias("_r"), "_next")
    return lent.select("_r.*", "_next").withColumn(CHUNK, F.col("_next")).drop("_next")


def with_window(df: DataFrame, spec: SeriesSpec, reach: int,
                build: Callable[[Window], dict[str, Column]],
                hot: HotSeries | None = None) -> DataFrame:
    """Add ordered window columns whose frames reach back at most ``reach`` rows."""
    hot = hot or hot_series(df, spec)
    groups = list(spec.groups)
    if hot.table is None:
        w = Window.partitionBy(*groups).orderBy(*spec.order)
        return df.withColumns(build(w))
    chunked = add_chunks(df, hot).withColumn("_lent", F.lit(False))
    if reach > 0:
        lent = _preceding_rows(chunked, hot, reach).withColumn("_lent", F.lit(True))
        chunked = chunked.unionByName(lent)
    w = Window.partitionBy(*groups, CHUNK).orderBy(*spec.order)
    built = build(w)
    out = chunked.withColumns(built).where(~F.col("_lent"))
    return out.drop("_lent", CHUNK)


def with_position(df: DataFrame, spec: SeriesSpec, hot: HotSeries | None = None,
                  position: str = "pos", count: str = "n") -> DataFrame:
    """Add the 1-based rank of each row in its series and the series' row count."""
    hot = hot or hot_series(df, spec)
    groups = list(spec.groups)
    out = attach_stats(df, groups, F.count(F.lit(1)).alias(count))
    if hot.table is None:
        w = Window.partitionBy(*groups).orderBy(*spec.order)
        return out.withColumn(position, F.row_number().over(w).cast("long"))
    chunked = add_chunks(out, hot)
    hot_rows = _join_hot(chunked, hot.table.drop("_rows"), groups, "left_semi") if groups else chunked
    sizes = hot_rows.groupBy(*groups, CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*groups).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, CHUNK, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*groups, CHUNK).orderBy(*spec.order)
    # One row per chunk of a hot series, about rows / limit in all.
    out = chunked.join(F.broadcast(starts), [*groups, CHUNK], "left")
    rank = F.row_number().over(w).cast("long") + F.coalesce(F.col("_start"), F.lit(0))
    return out.withColumn(position, rank).drop("_start", CHUNK)


# Rows of one series that meet its model or summary in one Python group.
ROWS_PER_GROUP = 500_000


def slots_for(rows: Column) -> Column:
    """Groups to spread a series of so many rows over."""
    return F.greatest(F.ceil(rows / ROWS_PER_GROUP), F.lit(1)).cast("int")


def meet(rows: DataFrame, side: DataFrame, spec: SeriesSpec, schema, run) -> DataFrame:
    """Run ``run(rows, side)`` on rows of a series and that series' few side rows.

    Both tables carry ``_slots``, the number of groups their series is spread
    over; each group gets a share of the rows and a copy of the side rows, so no
    group holds a whole hot series.
    """
    groups = list(spec.groups)
    spread = F.pmod(F.xxhash64(*(spec.tie or spec.order)), F.col("_slots")).cast("int")
    rows = rows.withColumn("_slot", spread).drop("_slots")
    every = F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))
    side = side.withColumn("_slot", every).drop("_slots")
    # Both tables may come from the same source: give the side columns of its own.
    side = side.toDF(*side.columns)
    pair = rows.groupBy(*groups, "_slot").cogroup(side.groupBy(*groups, "_slot"))
    return pair.applyInPandas(lambda r, s: run(r.drop(columns="_slot"), s), schema)


# Rows of one bracket that may be sorted in one task, and the cuts by which a larger one is divided.
ROWS_PER_BRACKET = 500_000
SPLITTERS = 255


@dataclass(frozen=True)
class Bracket:
    """The ``rows`` rows of group number ``group`` from ``low`` to ``high``; ``ranks`` (from 0 inside it) are looked for."""

    group: int
    low: float
    high: float
    rows: int
    ranks: tuple[tuple[int, int], ...]


def _inside(rows: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Rows (``_b``, ``_v``): the values in each bracket. Brackets of a group do not overlap."""
    held: dict[int, list] = {}
    for i, b in enumerate(brackets):
        held.setdefault(b.group, []).append((b.low, b.high, i))
    table = rows.sparkSession.createDataFrame(
        list(held.items()), "_g int, _open array<struct<low: double, high: double, number: int>>")
    v = F.col("_v")
    fits = F.filter("_open", lambda o: (v >= o["low"]) & (v <= o["high"]))
    # At most (rows / limit) groups with two brackets for each percentile.
    return (rows.join(F.broadcast(table), "_g").select(F.get(fits, F.lit(0))["number"].alias("_b"), "_v")
            .where(F.col("_b").isNotNull()))


def _at_ranks(counted: DataFrame, brackets: list[Bracket], order: str) -> list:
    """The rows of ``counted`` (``_b``, ``order``, ``_c`` rows each) in which the ranks lie, with ``_id``, ``_rank`` and ``_upto``."""
    ranks = counted.sparkSession.createDataFrame(
        [(i, t, rank) for i, b in enumerate(brackets) for t, rank in b.ranks], "_b int, _id int, _rank long")
    upto = F.sum("_c").over(Window.partitionBy("_b").orderBy(order))
    found = counted.withColumn("_upto", upto).join(F.broadcast(ranks), "_b")
    return found.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))).collect()


def narrow(rows: DataFrame, brackets: list[Bracket], limit: int) -> list[Bracket]:
    """Divides each bracket above ``limit`` rows once, and keeps the parts in which ranks lie.

    Approximate percentiles, which are values of the rows, are the cuts; the rows at
    and between them are counted exactly. A part is bounded by its own smallest and largest value.
    """
    large = [b for b in brackets if b.rows > limit and b.low < b.high]
    inside = _inside(rows, large)
    shares = [i / (SPLITTERS - 1) for i in range(SPLITTERS)]
    cuts = inside.groupBy("_b").agg(
        F.array_distinct(F.percentile_approx("_v", shares, 10 * SPLITTERS)).alias("_cuts"))
    before = position_in(F.col("_cuts"), F.col("_v"), SPLITTERS)
    at_cut = F.get("_cuts", F.col("_before") - 1).eqNullSafe(F.col("_v"))
    # SPLITTERS numbers for each bracket: by key, each bracket's rows would meet in one task.
    parts = (inside.join(F.broadcast(cuts), "_b").withColumn("_before", before)
             .withColumn("_part", 2 * F.col("_before") - at_cut.cast("int"))
             .groupBy("_b", "_part")
             .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    kept: dict[tuple, list] = {}
    for r in _at_ranks(parts, large, "_part"):
        key = (large[r["_b"]].group, r["_low"], r["_high"], r["_c"])
        kept.setdefault(key, []).append((r["_id"], r["_rank"] - r["_upto"] + r["_c"]))
    return [b for b in brackets if b not in large] + [Bracket(*k, tuple(t)) for k, t in kept.items()]


def values_at_ranks(rows: DataFrame, brackets: list[Bracket], limit: int) -> dict[int, float]:
    """The value at each rank, by its number. No task sorts more than ``limit`` distinct values of a bracket."""
    while any(b.rows > limit and b.low < b.high for b in brackets):
        brackets = narrow(rows, brackets, limit)
    found = {t: b.low for b in brackets if b.low == b.high for t, _ in b.ranks}
    rest = [b for b in brackets if b.low != b.high]
    if rest:
        counted = _inside(rows, rest).groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
        found |= {r["_id"]: r["_v"] for r in _at_ranks(counted, rest, "_v")}
    return found


def exact_percentiles(df: DataFrame, groups, value: str, qs: list[float], name: str,
                      hot: HotSeries | None = None) -> DataFrame:
    """Array of exact linear-interpolation percentiles per group; NULL for a group without known values.

    The built-in aggregate keeps all distinct values of a group in memory, so it
    serves the groups that are not hot. For the hot ones, all percentiles of all
    groups are selected together by counting: see :func:`narrow`. Their values are written once, so that they are
    computed once however many rounds follow. Each round is two scans and leaves about 1 / SPLITTERS of a bracket; only
    a few numbers for each hot group reach the driver.
    """
    groups, qs = list(groups), [float(q) for q in qs]
    limit = ROWS_PER_BRACKET if hot is None else min(hot.limit, ROWS_PER_BRACKET)
    table = _above(df, groups, limit) if hot is None else hot.table
    builtin = F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias(name)
    if table is None:
        return df.groupBy(*groups).agg(builtin)
    # No equal key for a missing one: such a group stays with the ordinary ones.
    keys = table.select(*groups).dropna().collect() if groups else [()]
    if not keys:
        return df.groupBy(*groups).agg(builtin)
    fields = [df.schema[g] for g in groups]
    numbered = df.sparkSession.createDataFrame(
        [(*k, i) for i, k in enumerate(keys)], T.StructType([*fields, T.StructField("_g", T.IntegerType())]))
    # Filters and joins come after the writing: ahead of it, each would compute the values once more.
    df = materialize(df.select(*groups, value), "values")
    known = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    rows = _join_hot(known, numbered, groups, "inner").select("_g", "_v")
    spans = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
    start, wanted = [], {}
    for s in spans:
        ranks = []
        for i, q in enumerate(qs):
            at = (s["n"] - 1) * q
            low = int(at)
            t = 2 * (s["_g"] * len(qs) + i)
            ranks += [(t, low), (t + 1, min(low + 1, s["n"] - 1))]
            wanted[s["_g"], i] = (t, at - low)
        start.append(Bracket(s["_g"], s["low"], s["high"], s["n"], tuple(ranks)))
    found = values_at_ranks(rows, start, limit) if start else {}

    def percentile(g: int, i: int) -> float:
        t, part = wanted[g, i]
        return found[t] + part * (found[t + 1] - found[t])

    out = [(*k, [percentile(g, i) for i in range(len(qs))] if (g, 0) in wanted else None) for g, k in enumerate(keys)]
    selected = df.sparkSession.createDataFrame(out, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
    if not groups:
        return selected
    ordinary = _join_hot(df, numbered.drop("_g"), groups, "left_anti")
    return ordinary.groupBy(*groups).agg(builtin).unionByName(selected)


def exact_percentile(df: DataFrame, groups, value: str, q: float, name: str,
                     hot: HotSeries | None = None) -> DataFrame:
    """Exact linear-interpolation percentile per group; see :func:`exact_percentiles`."""
    many = exact_percentiles(df, groups, value, [q], name, hot)
    return many.withColumn(name, F.get(name, F.lit(0)))


# Up to this limit Spark cuts `row_number() <= k` ahead of the shuffle.
GROUP_LIMIT = 1000


def last_rows(df: DataFrame, spec: SeriesSpec, k: int, hot: HotSeries | None = None) -> DataFrame:
    """The last ``k`` rows of each series."""
    if k > GROUP_LIMIT:
        placed = with_position(df, spec, hot)
        return placed.where(F.col("n") - F.col("pos") < k).drop("n", "pos")
    newest = [F.col(c).desc() for c in spec.order]
    rank = F.row_number().over(Window.partitionBy(*spec.groups).orderBy(*newest))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
