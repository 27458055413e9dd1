"""Random draws that do not depend on partitioning.

One md5 of the row identifier gives two 32-bit numbers; draw ``r`` of a row is
``(h1 + (r + 1) * h2) mod 2147483647``. Any number of rounds so costs one hash a row,
and another engine can repeat the draw. The sample of size ``m`` in round ``r``
is the ``m`` rows with the smallest draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import join_on

DRAW_RANGE = 2147483647
# A row that is drawn in more than one of so many rounds has all of them tried, as that costs less there.
TRY_BELOW = 16


def add_hashes(df: DataFrame, ids, seed: int = 0) -> DataFrame:
    """Columns ``_h1`` and ``_h2`` from the identifier columns and the seed."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))
    digest = F.md5(key)

    def number(start):
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")

    return df.withColumns({"_h1": number(1), "_h2": number(9)})


def draw(round_: Column) -> Column:
    return F.pmod(F.col("_h1") + (round_ + 1) * F.col("_h2"), F.lit(DRAW_RANGE))


def enough(size: Column) -> Column:
    """How many rows to let through ahead of ranking so that the ``size``
    smallest draws are among them: the shortfall probability is below exp(-60)
    by the Chernoff bound, and what is ranked stays within a fixed factor of
    the sample, however many rows there are."""
    return size + 60 + F.sqrt(F.lit(3600.0) + size * 120.0)


def first_hit(step: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The least ``k`` from 0 on with ``(start + k * step) % DRAW_RANGE <= limit``, or -1.

    That asks for a multiple of ``step`` in an interval of the circle. Where none lies in the first
    turn, the question goes over to the turns, whose circle is ``step`` wide: at most half as wide, as the
    step is taken in the shorter direction. So it ends after some 30 halvings at most.
    """
    low = -start % DRAW_RANGE
    high = np.where(start <= limit, low, low + limit)
    low = np.where(start <= limit, 0, low)
    circle = np.full(len(step), DRAW_RANGE)
    out = np.full(len(step), -1)
    live, levels = np.arange(len(step)), []
    while live.size:
        back = 2 * step > circle
        step = np.where(back, circle - step, step)
        low, high = (np.where(back & (low > 0), circle - y, x) for x, y in ((low, high), (high, low)))
        turns = -(-low // np.maximum(step, 1))
        done = (low == 0) | (turns * step <= high) & (step > 0)
        out[live[done]] = np.where(low[done] == 0, 0, turns[done])
        go = ~done & (step > 0)
        live, step, circle, low, high = (v[go] for v in (live, step, circle, low, high))
        levels.append((live, step, circle, low))
        step, circle, low, high = circle % step, step, -high % step, -low % step
    for live, step, circle, low in reversed(levels):
        inner = out[live]
        out[live] = np.where(inner < 0, -1, -(-(low + circle * inner) // np.maximum(step, 1)))
    return out


def hits(h1: np.ndarray, h2: np.ndarray, limit: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, round) of every draw at most ``limit``, by row and round, without looking at the other rounds.

    Between two hits of a row lie only three distances: the least one that moves the draw up by at most the limit,
    the least one that moves it down by at most the limit, and their sum. So a row costs three searches
    (:func:`first_hit`) and one step for each hit.
    """
    limit = np.minimum(limit, DRAW_RANGE - 1).astype(np.int64)
    step = h2 % DRAW_RANGE
    start = (h1 + h2) % DRAW_RANGE
    at = np.where(limit >= 0, first_hit(step, start, np.maximum(limit, 0)), -1)
    row = np.flatnonzero((at >= 0) & (at < rounds))
    at, step, start, limit, rounds = (v[row] for v in (at, step, start, limit, rounds))
    up = 1 + first_hit(step, step, limit)
    down = 1 + first_hit(-step % DRAW_RANGE, -step % DRAW_RANGE, limit)
    rise, fall = up * step % DRAW_RANGE, -down * step % DRAW_RANGE
    place = (start + at * step) % DRAW_RANGE
    rows, found = [], []
    while row.size:
        rows.append(row)
        found.append(at)
        can_rise, can_fall = place + rise <= limit, place >= fall
        rises = can_rise & (~can_fall | (up <= down))
        falls = can_fall & ~rises
        both = ~(rises | falls)
        at = at + np.where(rises | both, up, 0) + np.where(falls | both, down, 0)
        place = place + np.where(rises | both, rise, 0) - np.where(falls | both, fall, 0)
        go = at < rounds
        row, at, place, up, down, rise, fall, limit, rounds = (
            v[go] for v in (row, at, place, up, down, rise, fall, limit, rounds))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int)
    row, at = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(row, kind="stable")
    return row[order], at[order]


def tried(h1: np.ndarray, h2: np.ndarray, limit: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`hits` by looking at every round: for rows drawn in most of them."""
    number = np.arange(max(rounds, default=0))
    return np.nonzero(((h1[:, None] + (number + 1) * h2[:, None]) % DRAW_RANGE <= limit[:, None]) & (number < rounds[:, None]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def rounds_within(h1: pd.Series, h2: pd.Series, limit: pd.Series, rounds: pd.Series) -> pd.Series:
    """The rounds from 0 on, less than ``rounds``, in which :func:`draw` gives at most ``limit``."""
    columns = [c.to_numpy() for c in (h1, h2, limit, rounds)]
    often = columns[2] > DRAW_RANGE / TRY_BELOW
    found, step = [], 1000
    for k in range(0, len(h1), step):
        for search, chosen in ((hits, ~often[k:k + step]), (tried, often[k:k + step])):
            own = k + np.flatnonzero(chosen)
            row, at = search(*(c[own] for c in columns))
            found.append((own[row], at))
    out = [np.zeros(0, np.int32)] * len(h1)
    for row, at in found:
        own, first = np.unique(row, return_index=True)
        for i, part in zip(own, np.split(at.astype(np.int32), first[1:])):
            out[i] = part
    return pd.Series(out, dtype=object)


def below_threshold(draw_: Column, size: Column, count: Column) -> Column:
    """Cheap row filter ahead of the ranking in :func:`smallest`."""
    return draw_ <= enough(size.cast("double")) / count * F.lit(float(DRAW_RANGE))


def smallest(df: DataFrame, by, ids, size: Column) -> DataFrame:
    """Rows with the ``size`` smallest ``_draw`` per ``by``."""
    w = Window.partitionBy(*by).orderBy("_draw", *ids)
    return (df.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= size))


def cap_sample(df: DataFrame, by, ids, n: int = 100000, seed: int = 0) -> DataFrame:
    """At most ``n`` rows per ``by``, drawn at random; all rows of smaller groups."""
    by = list(by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hashed = add_hashes(df, ids, seed).withColumn("_draw", draw(F.lit(0)))
    hashed = join_on(hashed, counts, by)
    # Groups within the cap need no ranking at all.
    small = hashed.where(F.col("_n") <= n)
    large = hashed.where((F.col("_n") > n)
                         & below_threshold(F.col("_draw"), F.lit(n), F.col("_n")))
    drawn = smallest(large, by, ids, F.lit(n)).drop("_rank")
    return small.unionByName(drawn).select(*df.columns)
