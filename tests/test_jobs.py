"""The whole jobs on series with planted anomalies."""

from dataclasses import replace
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.data import ALONE, SPEC, START, by_id, frame, noisy
from tidemark.operators import series
from tidemark.operators.forecast import ForecastParams
from tidemark.operators.trend import TrendParams
from tidemark.plans import jobs
from tidemark.sources import store

COLUMNS = ["predict", "anomaly_score_1", "ad_label_1", "anomaly_score_2", "ad_label_2", "anomaly_score_3",
           "ad_label_3", "predicted_label"]
LABELS = [c for c in COLUMNS if "label" in c]
SETTINGS = jobs.JobSettings(time_parts=False)


def spiked(spark, parts=3):
    """Two calm series with five spikes each in the scored fifth."""
    rng = np.random.default_rng(7)
    rows, planted = [], []
    for k, g in enumerate(("a", "b")):
        y = 50 + rng.normal(0, 2, 600)
        at = rng.choice(np.arange(490, 600), 5, replace=False)
        y[at] += 60
        rows += [(g, i * 60, v) for i, v in enumerate(y)]
        planted += [k * 600 + int(i) for i in at]
    return frame(spark, rows, parts), set(planted)


@pytest.fixture(scope="module")
def detected(spark):
    df, planted = spiked(spark)
    return by_id(jobs.detect(df, SPEC, SETTINGS), *COLUMNS), planted


def test_planted_anomalies_are_found(detected):
    out, planted = detected
    assert len(out) == 240
    flagged = set(out[out.predicted_label == 1].id)
    for label in ("ad_label_2", "ad_label_3"):
        assert planted <= set(out[out[label] == 1].id)
    assert planted <= flagged and len(flagged) <= 20
    assert out.predict.notna().all() and out.anomaly_score_2.between(-1, 0).all()


def test_train_and_predict_equal_detect(spark, detected, tmp_path):
    df, _ = spiked(spark, 5)
    path = str(tmp_path)
    assert jobs.train(df, SPEC, path, SETTINGS) == []
    models = store.load_models(spark, f"{path}/models").groupBy("model").count().collect()
    assert {r.model: r["count"] for r in models} == {"lstm": 2, "iso_f": 2, "prophet": 2}
    out = by_id(jobs.predict(df, SPEC, path, SETTINGS, run_date="2024-01-01"), *COLUMNS)
    pd.testing.assert_frame_equal(out, detected[0], check_exact=False, rtol=1e-9)
    # A series without models comes back unlabelled.
    more = df.union(df.where("g = 'a'").withColumn("g", F.lit("new")).withColumn("id", F.col("id") + 5000))
    out = by_id(jobs.predict(more, SPEC, path, SETTINGS), "g", *COLUMNS)
    new = out[out.g == "new"]
    assert len(out) == 360 and len(new) == 120 and new.predicted_label.eq(0).all() and new.anomaly_score_2.isna().all()
    # New rows only: all of them come back.
    late = df.withColumns({"t": F.col("t") + F.expr("interval 30 days"), "id": F.col("id") + 9000})
    out = by_id(jobs.predict(late, SPEC, path, SETTINGS), *COLUMNS)
    assert len(out) == 1200 and out.anomaly_score_2.notna().all()


def test_all_raw_rows_and_columns_come_back(spark):
    """Sparse series, null groups, null features, a series after the split, another column."""
    df, _ = spiked(spark)
    late = F.col("t") >= F.lit(START + timedelta(seconds=30000))
    odd = [df.where("g = 'a'").withColumns({"g": F.lit("sparse"), "y": F.lit(None).cast("double"), "id": F.col("id") + 2000}),
           df.where("g = 'a'").withColumns({"g": F.lit(None).cast("string"), "id": F.col("id") + 4000}),
           df.where("g = 'a'").where(late).withColumns({"g": F.lit("late"), "id": F.col("id") + 6000})]
    for part in odd:
        df = df.unionByName(part)
    df = df.withColumns({"y": F.when(F.col("id") % 50 != 0, F.col("y")), "city": F.concat(F.lit("c"), "id"), "predict": F.lit("x")})
    out = by_id(jobs.detect(df, SPEC, SETTINGS), "g", "y", "city", *COLUMNS)
    raw = by_id(df.where(F.col("t") >= F.lit(START + timedelta(seconds=int(599 * 60 * 0.8)))), "g", "y", "city")
    pd.testing.assert_frame_equal(out[raw.columns], raw)
    assert out.y.isna().sum() > 120 and out[LABELS].notna().all().all()
    bare = out[(out.g == "sparse") | out.g.isna()]
    assert len(bare) == 240 and bare.predicted_label.eq(0).all() and bare.anomaly_score_2.isna().all()
    last = out[out.g == "late"]
    assert len(last) == 100 and last.anomaly_score_2.isna().all() and last.anomaly_score_3.notna().all()


def test_prediction_reads_from_the_saved_date(spark, tmp_path):
    """The bound reaches the files' scan, and unreadable or repeated rows do no harm."""
    df, _ = spiked(spark)
    path = str(tmp_path)
    jobs.train(df, SPEC, path, SETTINGS)
    meta = store.load_metadata(spark, f"{path}/metadata")
    assert START < meta["read_from"] < meta["split_date"] < START + timedelta(seconds=36000)
    assert meta["split_date"] - meta["read_from"] < timedelta(seconds=60 * 30)
    df.write.parquet(f"{path}/rows")
    out = jobs.predict(spark.read.parquet(f"{path}/rows"), SPEC, path, SETTINGS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in plan
    plain = SPEC.__class__("t", "y", "g")
    assert jobs.detect(df.union(df), plain, SETTINGS).count() == 480


def test_hot_series_change_nothing(spark, detected, monkeypatch):
    """The same results when every series is cut into chunks and slots."""
    monkeypatch.setattr(series, "ROWS_PER_CHUNK", 70)
    monkeypatch.setattr(jobs, "ROWS_PER_CHUNK", 70)
    monkeypatch.setattr(jobs, "ROWS_PER_GROUP", 50)
    monkeypatch.setattr(series, "ROWS_PER_GROUP", 50)
    out = by_id(jobs.detect(spiked(spark, 6)[0], SPEC, SETTINGS), *COLUMNS)
    pd.testing.assert_frame_equal(out, detected[0], check_exact=False, rtol=1e-9)


def test_variants(spark):
    df, planted = spiked(spark)
    other = replace(SETTINGS, score_method="student_t", forest_fit_on="window", trend=TrendParams(kind="linear"),
                    forecast=ForecastParams(lag=2, lahead=2, horizon=1), period="hourly")
    out = by_id(jobs.detect(df, SPEC, other), *COLUMNS)
    assert len(out) == 2 * 61 and out.anomaly_score_1.between(0, 1).all()
    sampled = by_id(jobs.detect(df, SPEC, replace(SETTINGS, forest_mode="sampled", trees=50)), *COLUMNS)
    assert planted <= set(sampled[sampled.ad_label_2 == 1].id)


def test_one_series_without_groups(spark):
    out = by_id(jobs.detect(noisy(spark, 200, series=("a",)), ALONE, SETTINGS), *COLUMNS)
    assert len(out) == 41 or len(out) == 40


def test_text_input_duplicates_and_no_identifier(spark):
    df = noisy(spark, 120).select("g", F.col("t").cast("string").alias("t"), F.col("y").cast("string").alias("y"))
    twice = df.union(df)
    spec = SPEC.__class__("t", "y", "g")
    out = jobs.detect(twice, spec, replace(SETTINGS, collapse=True)).toPandas()
    assert len(out) == 2 * len(out.t.unique()) and set(COLUMNS) <= set(out.columns)


def test_time_parts_become_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    s = np.arange(0, 2 * 86400, 40)
    df = frame(spark, [("a", v, 100.0 * (v // 3600 % 24 >= 12) + rng.normal()) for v in s])
    settings = jobs.JobSettings()
    parts = jobs.train(df, SPEC, str(tmp_path), settings)
    assert parts == ["hour"]
    assert store.load_metadata(spark, f"{tmp_path}/metadata")["time_groups"] == "hour"
    out = jobs.predict(df, SPEC, str(tmp_path), settings).toPandas()
    assert "hour" in out.columns and len(out) > 0


def test_tune(spark, tmp_path):
    df, _ = spiked(spark)
    ranges = {"contamination": "0.1*0.3", "num_of_trees": "200*600"}
    best = jobs.tune(df, SPEC, "iso_f", str(tmp_path), ranges).toPandas()
    assert set(best.g) == {"a", "b"} and best.contamination.isin([0.1, 0.2]).all()
    assert spark.read.parquet(f"{tmp_path}/params/model=iso_f").count() == 2
    # Series tuned before keep their parameters; a new one is added.
    more = df.where("g = 'a'").withColumns({"g": F.lit("c"), "id": F.col("id") + 5000})
    again = jobs.tune(more, SPEC, "iso_f", str(tmp_path), ranges).toPandas()
    assert sorted(again.g) == ["a", "b", "c"]
    kept = again.merge(best, on="g")
    assert len(kept) == 2 and (kept.combo_id_x == kept.combo_id_y).all()
    half = jobs.tune(df, SPEC, "lstm", implicit=True).toPandas()
    assert set(half.g) == {"a", "b"} and half.error.between(0.001, 0.5).all()


def test_training_tunes_once_and_uses_what_it_finds(spark, tmp_path, monkeypatch):
    """The first training saves parameters of every series; the next leaves them, and adds those of a new series."""
    from tidemark.operators import tuning

    df, _ = spiked(spark)
    path = str(tmp_path)
    small = {"iso_f": {"contamination": "0.05*0.25", "num_of_trees": "4*12"}, "lstm": {"batch_size": "8*24"},
             "prophet": {"interval_width": "0.5*0.95*0.2", "n_changepoints": "3*9"}}
    monkeypatch.setattr(tuning, "RANGES", small)
    first = replace(SETTINGS, tune_first=True, trees=8)
    jobs.train(df, SPEC, path, first)
    tuned = {m: {r.g: r for r in store.load_models(spark, f"{path}/params", m).collect()} for m in tuning.DEFAULTS}
    assert all(sorted(t) == ["a", "b"] for t in tuned.values())
    assert {r.num_of_trees for r in tuned["iso_f"].values()} <= {4, 8}
    models = {r.g: r for r in store.load_models(spark, f"{path}/models", "prophet").collect()}
    assert all(models[g].interval_width == tuned["prophet"][g].interval_width for g in "ab")
    assert all(len(models[g].knot_days) == tuned["prophet"][g].n_changepoints for g in "ab")
    more = df.unionByName(df.where("g = 'a'").withColumns({"g": F.lit("c"), "id": F.col("id") + 5000}))
    jobs.train(more, SPEC, path, first)
    again = {r.g: r for r in store.load_models(spark, f"{path}/params", "iso_f").collect()}
    assert sorted(again) == ["a", "b", "c"] and all(again[g].combo_id == tuned["iso_f"][g].combo_id for g in "ab")


def test_series_have_parameters_of_their_own(spark, tmp_path):
    df, _ = spiked(spark)
    path = str(tmp_path)
    forest = spark.createDataFrame([("a", 0.2, 3), ("b", 0.05, None)], "g string, contamination double, num_of_trees int")
    band = spark.createDataFrame([("a", 0.1, 0.1, 5), ("b", None, 0.4, 9)], "g string, interval_width double, changepoint_range double, n_changepoints int")
    lstm = spark.createDataFrame([("a", 400), ("b", 8)], "g string, batch_size int")
    for name, table in (("iso_f", forest), ("prophet", band), ("lstm", lstm)):
        store.save_models(table, f"{path}/params", name)
    settings = replace(SETTINGS, trees=6)
    jobs.train(df, SPEC, path, settings)
    found = {m: {r.g: r for r in store.load_models(spark, f"{path}/models", m).collect()} for m in tuned_names()}
    assert sorted(found["lstm"]) == ["b"]  # 480 rows are fewer than two batches of 400
    assert [len(found["prophet"][g].knot_days) for g in "ab"] == [5, 9]
    assert [found["prophet"][g].interval_width for g in "ab"] == [0.1, 0.95]
    out = by_id(jobs.predict(df, SPEC, path, settings), "g", *COLUMNS)
    flagged = out.groupby("g").ad_label_2.mean()
    assert flagged["a"] > 0.12 and flagged["b"] < 0.12
    assert out[out.g == "a"].ad_label_3.mean() > 0.3 > out[out.g == "b"].ad_label_3.mean()
    # A series' model is that of a job with its parameters for all.
    alone = jobs.JobSettings(time_parts=False, trees=3, contamination=0.2, trend=TrendParams(kind="piecewise", n_changepoints=5))
    jobs.train(df, SPEC, f"{path}/alone", alone)
    want = {r.g: r for r in store.load_models(spark, f"{path}/alone/models", "iso_f").collect()}["a"]
    assert found["iso_f"]["a"].threshold == pytest.approx(want.threshold) and found["iso_f"]["a"].knots == want.knots


def tuned_names():
    return ("lstm", "iso_f", "prophet")
