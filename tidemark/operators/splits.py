"""Train and prediction periods."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import HotSeries, last_rows
from tidemark.spec import SeriesSpec

# Weekday periods from Monday on, and day and second lengths of periods.
WEEKDAYS = ("Mondays", "Tuesdays", "Wednesdays", "Thursdays", "Fridays", "Saturdays", "Sundays")
PERIOD_DAYS = {"Daily": 1, "Weekly": 7, "Every 2 Weeks": 14, "Monthly": 30}
PERIOD_SECONDS = {"hourly": 3600, "Every Min": 60, "min": 60, "Every Second": 1}

DAY_SECONDS = 86400


def _plus_seconds(t: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(t) + seconds.cast("long") * 1_000_000)


def ratio_split_date(low: Column, high: Column, ratio: float = 0.8) -> Column:
    """``low`` plus that share of the span, in whole seconds."""
    span = (F.unix_micros(high) - F.unix_micros(low)) / 1e6
    return _plus_seconds(low, F.floor(span * ratio))


def period_split_date(high: Column, period: str, compat: bool = False) -> Column:
    """``high`` minus a period such as ``Daily`` or ``hourly``; or the weekday.

    A weekday name gives the most recent such day not after ``high``; with
    ``compat`` the one in the same Monday-to-Sunday week, even if it is later.
    """
    if period in WEEKDAYS:
        wanted = WEEKDAYS.index(period)
        back = F.weekday(high) - wanted
        if not compat:
            back = F.pmod(back, F.lit(7))
        return _plus_seconds(high, -back * DAY_SECONDS)
    by_name = {k.lower(): v * DAY_SECONDS for k, v in PERIOD_DAYS.items()}
    by_name.update({k.lower(): v for k, v in PERIOD_SECONDS.items()})
    return _plus_seconds(high, F.lit(-by_name[period.lower()]))


def split_date(df: DataFrame, time: str | None, period: str | None = None,
               ratio: float = 0.8) -> datetime:
    """The one date that splits the whole table, from its first and last time;
    without ``time`` the table has these as ``low`` and ``high``."""
    ends = df.agg(F.min(time).alias("low"), F.max(time).alias("high")) if time else df
    return ends.select(_split_of(period, ratio).alias("d")).first()["d"]


def _split_of(period: str | None, ratio: float) -> Column:
    if period is None or period.lower() == "only once":
        return ratio_split_date(F.col("low"), F.col("high"), ratio)
    return period_split_date(F.col("high"), period)


def split(df: DataFrame, time: str, date) -> tuple[DataFrame, DataFrame]:
    """Rows before ``date`` and rows from ``date`` on."""
    date = date if isinstance(date, Column) else F.lit(date)
    return df.where(F.col(time) < date), df.where(F.col(time) >= date)


def query_date(job: str, date):
    """Only the prediction job restricts what is read."""
    return date if job == "prediction" else None


def with_lookback(df: DataFrame, spec: SeriesSpec, date, rows: int,
                  hot: HotSeries | None = None) -> DataFrame:
    """Rows from ``date`` on and, flagged ``warmup``, the last ``rows`` rows of
    each series before it."""
    date = date if isinstance(date, Column) else F.lit(date)
    before, after = split(df, spec.time, date)
    before = last_rows(before, spec, rows, hot)
    return (before.withColumn("warmup", F.lit(1))
            .unionByName(after.withColumn("warmup", F.lit(0))))
