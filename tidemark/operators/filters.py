"""Row filters and the enumeration of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

ALL = "ALL"

# Pairs that one task of a product makes.
PAIRS_PER_TASK = 5_000_000


def filter_levels(df: DataFrame, levels: dict) -> DataFrame:
    """Rows equal to every given level; the level ``ALL`` filters nothing."""
    for column, value in levels.items():
        if value != ALL:
            df = df.where(F.col(column) == F.lit(value))
    return df


def filter_expr(df: DataFrame, expression: str) -> DataFrame:
    """Rows matching a SQL condition."""
    return df.where(expression)


def time_range(df: DataFrame, time: str, low, high) -> DataFrame:
    return df.where(F.col(time).between(F.lit(low), F.lit(high)))


def non_null(df: DataFrame, feature: str) -> DataFrame:
    return df.where(F.col(feature).isNotNull())


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of a row of ``left`` and a row of ``right``, made by tasks of at most about :data:`PAIRS_PER_TASK` pairs.

    The tasks form a grid over blocks of both sides, whose shape follows the two counts, so that the rows are copied as
    little as possible: a row goes once to each block of the other side. Rows are hashed to blocks by their content.
    """
    rows = [side.count() for side in (left, right)]
    tasks = max(1, -(-rows[0] * rows[1] // PAIRS_PER_TASK))
    # Blocks of about the same number of rows on both sides, and no more blocks than rows.
    high = min(max(rows[0], 1), max(1, round((tasks * rows[0] / max(rows[1], 1)) ** 0.5)))
    wide = min(max(rows[1], 1), -(-tasks // high))
    high = min(max(rows[0], 1), -(-tasks // wide))

    def blocks(side: DataFrame, own: str, number: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*side.columns), F.lit(number)).cast("int")
        out = side.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return out.repartition(high * wide, "_high", "_wide")

    pair = blocks(left, "_high", high, "_wide", wide).join(blocks(right, "_wide", wide, "_high", high), ["_high", "_wide"])
    return pair.drop("_high", "_wide")


def series_levels(df: DataFrame, groups, dense: bool = False) -> DataFrame:
    """One row per series; ``dense`` also lists combinations without rows.

    The dense form is by definition the product of the distinct levels, made by :func:`product`. The levels of each
    column are written first, as they are counted and read again.
    """
    groups = list(groups)
    if not dense:
        return df.dropna(subset=groups).select(*groups).distinct()
    levels = [materialize(df.select(g).where(F.col(g).isNotNull()).distinct(), "levels") for g in groups]
    out = levels[0]
    for level in levels[1:]:
        out = product(out, level)
    return out
