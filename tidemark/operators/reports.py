"""Aggregates behind the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import ALL, filter_levels
from tidemark.operators.series import exact_percentile, join_on
from tidemark.spec import SeriesSpec

# Fixed value: rows the result view shows.
LATEST = 1000


def sort_by_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.orderBy(*spec.order)


def timeline(df: DataFrame, spec: SeriesSpec, filters: dict | None = None) -> DataFrame:
    """Mean feature per time, after the filters."""
    kept = filter_levels(df, filters or {})
    return kept.groupBy(spec.time).agg(F.avg(spec.feature).alias(spec.feature))


def descriptives(df: DataFrame, feature: str, filters: dict | None = None) -> DataFrame:
    """Rows (``metric``, ``value``): mean, max, min and median of the known values."""
    known = filter_levels(df, filters or {}).where(F.col(feature).isNotNull())
    simple = known.agg(F.avg(feature).alias("mean"), F.max(feature).cast("double").alias("max"),
                       F.min(feature).cast("double").alias("min"))
    rows = simple.unpivot([], ["mean", "max", "min"], "metric", "value")
    median = exact_percentile(known.select(feature), [], feature, 0.5, "value")
    return rows.unionByName(median.select(F.lit("median").alias("metric"), "value"))


def filter_options(df: DataFrame, columns) -> DataFrame:
    """Rows (``dimension``, ``option``) of the first three columns, and ``ALL`` for each."""
    columns = list(columns)[:3]
    text = df.select(*[F.col(c).cast("string") for c in columns])
    found = (text.unpivot([], columns, "dimension", "option")
             .where(F.col("option").isNotNull()).distinct())
    every = df.sparkSession.createDataFrame([(c, ALL) for c in columns], found.schema)
    return found.unionByName(every)


def latest(df: DataFrame, spec: SeriesSpec, n: int = LATEST) -> DataFrame:
    """The last ``n`` rows by time, ascending; the limit is taken per task first."""
    newest = [F.col(c).desc() for c in spec.order]
    return df.orderBy(*newest).limit(n).orderBy(*spec.order)


def anomaly_timeline(results: DataFrame, spec: SeriesSpec, filters: dict | None = None,
                     n: int = LATEST) -> DataFrame:
    """Prediction and voted label by time among the latest results."""
    shown = filter_levels(latest(results, spec, n), filters or {})
    return shown.select(*spec.groups, *spec.order, "predict", "predicted_label")


def anomaly_rate(results: DataFrame, dimension: str) -> DataFrame:
    """Mean label of each detector per value of a dimension."""
    labels = [c for c in results.columns if c.startswith("ad_label_")]
    return results.groupBy(dimension).agg(*[F.avg(c).alias(c) for c in labels])


def coverage(series: DataFrame, models: DataFrame, groups) -> DataFrame:
    """Share of the series each detector has a model for, and the mean over detectors.

    ``models`` has the group columns and ``model``.
    """
    groups = list(groups)
    listed = series.select(*groups).distinct()
    total = listed.agg(F.count(F.lit(1)).alias("series"))
    have = (models.select(*groups, "model").distinct()
            .join(listed, groups, "left_semi")
            .groupBy("model").agg(F.count(F.lit(1)).alias("done")))
    shares = join_on(have, total, []).withColumn("share", F.col("done") / F.col("series"))
    overall = shares.agg(F.lit("all").alias("model"), F.sum("done").alias("done"),
                         F.sum("series").alias("series"), F.avg("share").alias("share"))
    return shares.select("model", "done", "series", "share").unionByName(overall)
