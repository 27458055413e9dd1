"""Streaming forms. The stream is the events table, arriving in slices of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import EVENTS, SQL_EVENTS, SQL_NULLS, events, events_nulls, query, r, sr, st, text
from tidemark.catalog.detectors import sql_band, sql_scores
from tidemark.operators import iforest, trend
from tidemark.session import scratch_path
from tidemark.streaming import stream as ts

COLUMNS = ("event_id", "ts", "event_type", "value")


SLICES = 3


def _slices(df):
    """The rows of each third of the time span."""
    ends = df.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z")).first()
    width = (ends["z"] - ends["a"]) // SLICES + 1
    number = F.floor((F.unix_micros("ts") - F.lit(ends["a"])) / F.lit(width))
    return [df.where(number == k) for k in range(SLICES)]


def _arrivals(spark, df):
    """A folder that fills up slice by slice: yields the stream after each arrival."""
    path, df = scratch_path(spark, "arrivals"), df.select(*COLUMNS)
    for part in _slices(df):
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(df.schema).parquet(path)


def _drain(spark, df, build):
    """Run the stream once per arrival, each run going on from the last one's state."""
    path, checkpoint, schema = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"), None
    for arrivals in _arrivals(spark, df):
        out = build(arrivals)
        schema = out.schema
        (out.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(path)


_BAND = sql_band(SQL_EVENTS)


@query("st1_detect_stream", _BAND + f""", {sql_scores(iforest.SUBSAMPLES)},
 limits AS (SELECT event_type, quantile_cont(score, 0.01) AS threshold FROM scores GROUP BY 1),
 two AS (SELECT event_id, score, (score < threshold)::INT AS ad_label_2 FROM scores JOIN limits USING (event_type)),
 three AS (SELECT event_id, (value > upper OR value < lower)::INT AS ad_label_3, CASE WHEN value > upper THEN
   abs((value - upper) / nullif(value, 0)) WHEN value < lower THEN abs((value - lower) / nullif(value, 0)) ELSE 0 END AS away FROM b)
 SELECT event_id, {sr('score')} AS anomaly_score_2, ad_label_2, {sr('away')} AS anomaly_score_3, ad_label_3,
  greatest(ad_label_2, ad_label_3) AS predicted_label FROM two JOIN three USING (event_id)""")
def st1(spark, sf):
    df = events(spark, sf).select(*COLUMNS)
    forest, band = iforest.fit_iforest(df, EVENTS, trees=iforest.SUBSAMPLES), trend.fit_trend(df, EVENTS)
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    for arrivals in _arrivals(spark, df):
        ts.detect_stream(arrivals, EVENTS, forest, band, path, checkpoint).awaitTermination()
    out = spark.read.parquet(path)
    return out.select("event_id", r("anomaly_score_2").alias("anomaly_score_2"), "ad_label_2",
                      r("anomaly_score_3").alias("anomaly_score_3"), "ad_label_3", "predicted_label")


@query("st2_run_incremental", "SELECT event_id, value FROM events WHERE value IS NOT NULL")
def st2(spark, sf):
    """Two runs after each arrival: the second finds nothing new."""
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    for arrivals in _arrivals(spark, events(spark, sf)):
        for day in ("2024-02-01", "2024-02-02"):
            ts.run_incremental(arrivals, path, checkpoint, lambda b: b.where("value is not null"), day).awaitTermination()
    return spark.read.parquet(path).select("event_id", "value")


@query("st3_fill_previous_stream", f"""SELECT event_id, {sr('''coalesce(value,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))''')} AS value FROM {SQL_NULLS}""")
def st3(spark, sf):
    out = _drain(spark, events_nulls(spark, sf), lambda s: ts.fill_previous_stream(s, EVENTS))
    return out.select("event_id", r("value").alias("value"))


@query("st4_timeline_stream", f"""SELECT event_type, {st('w')} AS window_start, {st("w + INTERVAL 6 HOUR")} AS window_end,
 {sr('avg(value)')} AS value, count(*) AS rows FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM events)
 WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY event_type, w""")
def st4(spark, sf):
    """Windows that are complete at the last watermark."""
    out = _drain(spark, events(spark, sf), lambda s: ts.timeline_stream(s, EVENTS, "6 hours"))
    return out.select("event_type", text("window_start").alias("window_start"), text("window_end").alias("window_end"),
                      r("value").alias("value"), "rows")


@query("st5_collapse_duplicates_stream", "SELECT event_id, event_type, value FROM events")
def st5(spark, sf):
    """Every row arrives twice."""
    df = events(spark, sf)
    twice = df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    out = _drain(spark, twice, lambda s: ts.collapse_duplicates_stream(s, EVENTS))
    return out.select("event_id", "event_type", "value")
