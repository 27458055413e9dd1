"""The batch operators on streams of new rows."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.operators.ensemble import vote_present
from tidemark.operators.iforest import predict_iforest
from tidemark.operators.trend import label_band, trend_band
from tidemark.spec import SeriesSpec


def run_incremental(stream: DataFrame, path: str, checkpoint: str,
                    transform: Callable[[DataFrame], DataFrame] | None = None,
                    run_date: str = "") -> StreamingQuery:
    """Process what is new since the last run, then stop.

    Every micro-batch owns one partition of the output, and a repeated batch
    replaces it, so a restart after a failure writes each row once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # The transformation may look at the batch more than once.
        batch = batch.persist()
        out = transform(batch) if transform else batch
        out = out.withColumns({"run_date": F.lit(run_date), "batch": F.lit(batch_id)})
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_date", "batch").parquet(path))
        batch.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def score_arrivals(batch: DataFrame, spec: SeriesSpec, forest: DataFrame, trend: DataFrame,
                   interval_width: float = 0.95) -> DataFrame:
    """Score rows that need no history: forest and band, then the vote of the two."""
    out = predict_iforest(batch, forest, spec)
    out = label_band(trend_band(out, trend, spec, interval_width), spec)
    return vote_present(out.drop("yhat", "yhat_lower", "yhat_upper"))


def detect_stream(stream: DataFrame, spec: SeriesSpec, forest: DataFrame, trend: DataFrame,
                  path: str, checkpoint: str, interval_width: float = 0.95) -> StreamingQuery:
    """Score arriving rows with saved models."""
    return run_incremental(
        stream, path, checkpoint, lambda b: score_arrivals(b, spec, forest, trend, interval_width))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fill_with_recent(y: np.ndarray, recent: np.ndarray, total: float, count: int) -> np.ndarray:
    """``y`` with each unknown value as the mean of the known ones among the last raw values, ``recent`` standing ahead
    of ``y``; where none is known, the mean of all earlier known values, of which ``count`` before ``y`` sum up to ``total``."""
    known = ~np.isnan(y)
    near = sliding_window_view(np.concatenate([recent, y]), len(recent))[:-1]
    there = ~np.isnan(near)
    sums, counts = total + np.cumsum(np.where(known, y, 0)), count + np.cumsum(known)
    by_mean = np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
    by_near = np.where(there, near, 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
    return np.where(known, y, np.where(there.any(axis=1), by_near, by_mean))


class FillPrevious(StatefulProcessor):
    """State of a series: its last raw values (a list) and the sum and number of its known values.

    Where the rows carry ``_at``, a timer stands at the latest time of the series; when the watermark passes it, the state goes.
    """

    def __init__(self, columns: list[str], feature: str, order: list[str], k: int, expires: bool):
        self.columns, self.feature, self.order, self.k, self.expires = columns, feature, order, k, expires

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "value double")
        self.known = handle.getValueState("known", "total double, count long")

    def handleInputRows(self, key, rows, timerValues):
        # Names that start with an underscore do not arrive as they are.
        part = pd.concat(list(rows)).set_axis(self.columns, axis=1).sort_values(self.order, kind="stable")
        if part.empty:
            return
        y = part[self.feature].to_numpy(float)
        held = [np.nan if v is None else v for (v,) in self.recent.get()]
        total, count = self.known.get() if self.known.exists() else (0.0, 0)
        recent = np.concatenate([np.full(self.k - len(held), np.nan), held])
        filled = fill_with_recent(y, recent, total, count)
        last = np.concatenate([recent, y])[-self.k:]
        self.recent.put([(None if np.isnan(v) else float(v),) for v in last])
        self.known.update((float(total + np.nansum(y)), int(count + np.count_nonzero(~np.isnan(y)))))
        if self.expires:
            before = list(self.handle.listTimers())
            for timer in before:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max([*before, int(part["_millis"].max())]))
            part = part.drop(columns=["_at", "_millis"])
        yield part.assign(**{self.feature: filled})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def fill_previous_stream(stream: DataFrame, spec: SeriesSpec, k: int = 3, silence: str | None = None) -> DataFrame:
    """Null filling with the last ``k`` raw values and the running mean as state.

    Rows of a series are taken in time order within a micro-batch; the source's
    rate limit (``maxFilesPerTrigger``) bounds how many there are. A null without
    a known value among the last k rows gets the mean so far.

    With ``silence`` (such as ``"7 days"``), the state of a series is removed once the watermark, so much behind the latest time of the
    stream, has passed the series' own latest time; the series starts anew when it comes back, and rows later than
    the watermark are dropped, as in :func:`timeline_stream`. Without it, state is kept for good and no row is dropped. Rows need a
    time then. The state lives in RocksDB, which is set for the session as this kind of state needs it.
    """
    y, keys = spec.feature, list(spec.groups)
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream if keys else stream.withColumn("_one", F.lit(0))
    schema = rows.schema
    if silence is not None:
        at = F.col(spec.time).cast("timestamp")
        rows = rows.withColumns({"_at": at, "_millis": F.unix_millis(at)}).withWatermark("_at", silence)
    out = rows.groupBy(*(keys or ["_one"])).transformWithStateInPandas(
        FillPrevious(rows.columns, y, spec.order, k, silence is not None), schema, "Append", "None" if silence is None else "EventTime")
    return out.withColumn(y, F.nanvl(y, F.lit(None).cast("double"))).select(*stream.columns)


def timeline_stream(stream: DataFrame, spec: SeriesSpec, width: str, slide: str | None = None,
                    late: str = "1 hour") -> DataFrame:
    """Mean feature per group and time window; rows later than ``late`` are dropped."""
    timed = stream.withColumn(spec.time, F.col(spec.time).cast("timestamp"))
    window = F.window(spec.time, width, slide) if slide else F.window(spec.time, width)
    return (timed.withWatermark(spec.time, late).groupBy(window, *spec.groups)
            .agg(F.avg(spec.feature).alias(spec.feature), F.count(F.lit(1)).alias("rows"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), *spec.groups, spec.feature, "rows"))


def collapse_duplicates_stream(stream: DataFrame, spec: SeriesSpec, late: str = "1 hour") -> DataFrame:
    """The first row per series and time within the watermark."""
    timed = stream.withColumn(spec.time, F.col(spec.time).cast("timestamp"))
    return timed.withWatermark(spec.time, late).dropDuplicatesWithinWatermark([*spec.groups, spec.time])
