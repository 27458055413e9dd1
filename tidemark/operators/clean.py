"""Null handling and uniqueness of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import HotSeries, attach_stats, with_window
from tidemark.spec import SeriesSpec


def drop_sparse_series(df: DataFrame, spec: SeriesSpec, limit: float = 0.5) -> DataFrame:
    """Keep the series whose share of null features is below ``limit``."""
    share = F.avg(F.col(spec.feature).isNull().cast("double"))
    groups = list(spec.groups)
    if not groups:
        return df if (df.agg(share).first()[0] or 0.0) < limit else df.limit(0)
    kept = df.groupBy(*groups).agg(share.alias("_share")).where(F.col("_share") < limit)
    return df.join(kept, groups, "left_semi")


def fill_previous(df: DataFrame, spec: SeriesSpec, k: int = 3,
                  hot: HotSeries | None = None) -> DataFrame:
    """A null feature becomes the mean of the known raw values among the ``k``
    rows before it, or the series mean where there is none."""
    y = F.col(spec.feature)
    out = with_window(df, spec, k, lambda w: {"_near": F.avg(y).over(w.rowsBetween(-k, -1))}, hot)
    out = attach_stats(out, spec.groups, F.avg(y).alias("_mean"))
    filled = F.coalesce(y, F.col("_near"), F.col("_mean"))
    return out.withColumn(spec.feature, filled).drop("_near", "_mean")


def clean_series(df: DataFrame, spec: SeriesSpec, limit: float = 0.5, k: int = 3,
                 hot: HotSeries | None = None) -> DataFrame:
    """:func:`drop_sparse_series` and :func:`fill_previous` in one pass over the
    series statistics. Rows with a null group belong to no series and are left out."""
    y = F.col(spec.feature)
    if spec.groups:
        df = df.dropna(subset=list(spec.groups))
    out = attach_stats(df, spec.groups, F.avg(y).alias("_mean"),
                       F.avg(y.isNull().cast("double")).alias("_share"))
    out = out.where(F.col("_share") < limit).drop("_share")
    out = with_window(out, spec, k, lambda w: {"_near": F.avg(y).over(w.rowsBetween(-k, -1))}, hot)
    filled = F.coalesce(y, F.col("_near"), F.col("_mean"))
    return out.withColumn(spec.feature, filled).drop("_near", "_mean")


def uniqueness_report(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows and distinct times of each series.

    Two aggregations by (series, time), then by series, so that the distinct
    times of one series need not meet in one task.
    """
    groups = list(spec.groups)
    per_time = df.groupBy(*groups, spec.time).agg(F.count(F.lit(1)).alias("_rows"))
    return per_time.groupBy(*groups).agg(
        F.sum("_rows").alias("rows"),
        F.count(spec.time).alias("distinct_times"))


def times_are_unique(df: DataFrame, spec: SeriesSpec) -> bool:
    report = uniqueness_report(df, spec)
    return report.where(F.col("rows") > F.col("distinct_times")).isEmpty()


def rows_are_unique(df: DataFrame, spec: SeriesSpec) -> bool:
    """Whether no two rows agree in groups, time and tie, and each has a time."""
    per_row = df.groupBy(*dict.fromkeys([*spec.groups, *spec.order])).agg(F.count(F.lit(1)).alias("_rows"))
    return per_row.where((F.col("_rows") > 1) | F.col(spec.time).isNull()).isEmpty()


def collapse_duplicates(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per series and time with the mean feature."""
    return df.groupBy(*spec.groups, spec.time).agg(F.avg(spec.feature).alias(spec.feature))
