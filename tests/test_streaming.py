"""Streams give what the batch operators give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.data import ALONE, SPEC, by_id, frame, noisy
from tidemark.operators import iforest, trend
from tidemark.streaming import stream as st


def arrive(spark, path, *frames):
    for part in frames:
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(part.schema).parquet(path)


def drain(out, path, checkpoint):
    (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def halves(df, at="2021-01-01 01:00:00"):
    early = F.col("t") < F.lit(at).cast("timestamp")
    return df.where(early), df.where(~early)


def test_detect_stream(spark, tmp_path):
    df = noisy(spark, 120)
    forest, band = iforest.fit_iforest(df, SPEC), trend.fit_trend(df, SPEC)
    for s in arrive(spark, str(tmp_path / "in"), *halves(df)):
        st.detect_stream(s, SPEC, forest, band, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = by_id(spark.read.parquet(str(tmp_path / "out")), "ad_label_2", "ad_label_3", "anomaly_score_2", "predicted_label")
    want = by_id(st.score_arrivals(df, SPEC, forest, band), "ad_label_2", "ad_label_3", "anomaly_score_2", "predicted_label")
    pd.testing.assert_frame_equal(got, want)


def test_incremental_runs_see_each_row_once(spark, tmp_path):
    df = noisy(spark, 80)
    for s in arrive(spark, str(tmp_path / "in"), *halves(df, "2021-01-01 00:30:00")):
        for day in ("d1", "d2"):
            st.run_incremental(s, str(tmp_path / "out"), str(tmp_path / "c"), run_date=day).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("id").distinct().count() == 160 and out.select("batch").distinct().count() == 2


def test_fill_stream_carries_state(spark, tmp_path):
    y = [None, 1, 2, None, None, None, None, 8, None]
    df = frame(spark, [("a", i, v) for i, v in enumerate(y)])
    cut = F.col("id") < 4
    for s in arrive(spark, str(tmp_path / "in"), df.where(cut), df.where(~cut)):
        drain(st.fill_previous_stream(s, SPEC), str(tmp_path / "out"), str(tmp_path / "c"))
    got = by_id(spark.read.parquet(str(tmp_path / "out")), "y").y
    # The leading null has no past; id 6 falls back on the mean so far.
    assert pd.isna(got[0]) and got[1:].tolist() == [1, 2, 1.5, 1.5, 2, 1.5, 8, 8]


def test_fill_stream_equals_one_run(spark, tmp_path):
    """Three restarts give what one run over all rows gives."""
    df = noisy(spark, 200, nulls=0.6, series=("a", "b"))
    cuts = [F.col("t") < F.lit(f"2021-01-01 {h}").cast("timestamp") for h in ("00:40:00", "01:10:00", "02:30:00")]
    parts = [df.where(cuts[0]), df.where(~cuts[0] & cuts[1]), df.where(~cuts[1] & cuts[2]), df.where(~cuts[2])]
    for name, slices in (("many", parts), ("one", [df])):
        for s in arrive(spark, str(tmp_path / name / "in"), *slices):
            drain(st.fill_previous_stream(s, SPEC), str(tmp_path / name / "out"), str(tmp_path / name / "c"))
    many, one = (by_id(spark.read.parquet(str(tmp_path / name / "out")), "y") for name in ("many", "one"))
    pd.testing.assert_frame_equal(many, one, rtol=1e-12)
    assert len(one) == 400


def test_silent_series_leave_no_state(spark, tmp_path):
    quiet = frame(spark, [("quiet", 0, 5.0)])
    loud = frame(spark, [("loud", 9000, 6.0)])
    back = frame(spark, [("quiet", 9002, None), ("loud", 9003, None)])
    path, held = str(tmp_path / "c"), []
    for s in arrive(spark, str(tmp_path / "in"), quiet, loud, back):
        drain(st.fill_previous_stream(s, SPEC, silence="1 hour"), str(tmp_path / "out"), path)
        state = spark.read.format("statestore").option("path", path).option("stateVarName", "known").load()
        held.append({r["key"]["g"] for r in state.collect()})
    assert held == [{"quiet"}, {"loud"}, {"quiet", "loud"}]
    assert [(r["g"], r["y"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()] == [
        ("quiet", 5.0), ("loud", 6.0), ("quiet", None), ("loud", 6.0)]


def test_fill_stream_without_groups(spark, tmp_path):
    df = frame(spark, [("a", 0, 1.0), ("b", 1, 3.0), ("a", 2, None)])
    for s in arrive(spark, str(tmp_path / "in"), df):
        drain(st.fill_previous_stream(s, ALONE), str(tmp_path / "out"), str(tmp_path / "c"))
    assert by_id(spark.read.parquet(str(tmp_path / "out")), "y").y.tolist() == [1, 3, 2]


@pytest.mark.parametrize("slide", [None, "10 minutes"])
def test_timeline_stream(spark, tmp_path, slide):
    df = noisy(spark, 150)
    late = frame(spark, [("a", 5, 1000.0)])     # arrives hours after its window closed
    for s in arrive(spark, str(tmp_path / "in"), *halves(df), late):
        drain(st.timeline_stream(s, SPEC, "20 minutes", slide, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    window = F.window("t", "20 minutes", slide) if slide else F.window("t", "20 minutes")
    want = (df.groupBy(window, "g").agg(F.avg("y").alias("y"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "g", "y").toPandas())
    want = want[want.window_end <= df.agg(F.max("t")).first()[0] - pd.Timedelta("10min")]
    key = ["g", "window_start"]
    pd.testing.assert_frame_equal(got[["window_start", "window_end", "g", "y"]].sort_values(key).reset_index(drop=True),
                                  want.sort_values(key).reset_index(drop=True))


def test_replayed_rows_are_dropped(spark, tmp_path):
    df = noisy(spark, 50)
    for s in arrive(spark, str(tmp_path / "in"), df, df):
        drain(st.collapse_duplicates_stream(s, SPEC, "2 hours"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
