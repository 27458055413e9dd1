from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.data import ALONE, SPEC, by_id, frame, noisy
from tidemark.operators import ensemble, reports
from tidemark.operators import tuning as tu
from tidemark.operators import iforest
from tidemark.operators.residual_score import mean_ci_inlier


@pytest.mark.parametrize("count", [0, 1, 2, 3])
def test_vote(spark, count):
    for labels in product((0, 1), repeat=count):
        got = spark.range(1).select(ensemble.vote([F.lit(v) for v in labels]).alias("v")).first().v
        total = sum(labels)
        want = {0: 2, 1: total, 2: int(total >= 1), 3: int(total >= 2)}[count]
        assert got == want


def model(spark, i, rows):
    df = spark.createDataFrame(rows, f"g string, id long, ad_label_{i} int, anomaly_score_{i} double")
    base = frame(spark, [("a", 0, 1), ("a", 1, None), ("b", 0, 3)]).select("id", "t")
    return df.join(base, "id")


def test_join_models(spark):
    raw = frame(spark, [("a", 0, 1), ("a", 1, None), ("b", 0, 3)])
    one = model(spark, 1, [("a", 0, 1, 0.9)]).withColumn("predict", F.lit(5.0))
    three = model(spark, 3, [("a", 1, 1, 0.2), ("b", 2, 0, 0.1)])
    out = by_id(ensemble.vote_present(ensemble.join_models(raw, {1: one, 2: None, 3: three}, SPEC)),
                "y", "predict", "ad_label_1", "ad_label_3", "anomaly_score_3", "predicted_label")
    assert out.ad_label_1.tolist() == [1, 0, 0] and out.ad_label_3.tolist() == [0, 1, 0]
    assert out.predicted_label.tolist() == [1, 1, 0] and np.isnan(out.y[1]) and np.isnan(out.predict[1])
    filled = by_id(ensemble.join_models(raw, {1: one}, SPEC, fill_raw=True), "y", "predict")
    assert filled.y.tolist() == [1, 0, 3] and filled.predict.tolist() == [5, 0, 0]
    with pytest.raises(ensemble.DuplicateTimes):
        ensemble.join_models(raw, {1: one.union(one)}, SPEC)
    assert ensemble.vote_present(raw).first().predicted_label == 2


def test_join_models_where_times_repeat(spark):
    """The tie tells rows of one time apart; without it they are refused."""
    raw = frame(spark, [("a", 0, 1), ("a", 0, 2), ("a", 1, 3), ("b", 0, 4)])
    one = raw.where("id <> 2").select("g", "t", "id", (F.col("id") % 2).cast("int").alias("ad_label_1"), F.col("y").alias("anomaly_score_1"))
    out = by_id(ensemble.join_models(raw, {1: one}, SPEC), "ad_label_1", "anomaly_score_1")
    assert out.id.tolist() == [0, 1, 2, 3] and out.ad_label_1.tolist() == [0, 1, 0, 1] and out.anomaly_score_1.tolist() == [1, 2, 0, 4]
    for repeated in (one.drop("id"), one.union(one.where("id = 0")), one.withColumn("t", F.lit(None).cast("timestamp"))):
        with pytest.raises(ensemble.DuplicateTimes):
            ensemble.join_models(raw, {1: repeated}, SPEC)


def test_grids(spark):
    for name, size in (("iso_f", 20), ("lstm", 48), ("prophet", 20)):
        grid = tu.param_grid(spark, tu.DEFAULTS[name], tu.RANGES[name]).toPandas()
        assert len(grid) == size == len(grid.drop(columns="combo_id").drop_duplicates())
    assert sorted(grid.n_changepoints.unique()) == [50, 100, 150, 200, 250] and set(grid.interval_width) == {0.9}
    grid = tu.param_grid(spark, {"a": 1, "b": 0.5, "c": "x"}, {"a": "2*9*3", "b": "0.1*0.3"}).orderBy("combo_id").collect()
    assert [(r.a, r.b, r.c) for r in grid] == [(a, b, "x") for a in (2, 5, 8) for b in (0.1, 0.2)]
    half = tu.half_grid(tu.param_grid(spark, tu.DEFAULTS["lstm"], tu.RANGES["lstm"]), 1)
    assert half.count() == 24 == half.distinct().count()


def test_best_params(spark):
    grid = tu.param_grid(spark, {"k": 1}, {"k": "1*4"})
    errors = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 2, 0.5), ("c", 0, None)],
                                   "g string, combo_id long, error double")
    best = {r.g: (r.combo_id, r.k) for r in tu.best_params(errors, grid, ["g"]).collect()}
    assert best == {"a": (1, 2), "b": (2, 3)}
    series = spark.createDataFrame([("a",), ("z",)], "g string")
    tuned = spark.createDataFrame([("a", 0.4)], "g string, contamination double")
    got = {r.g: r.contamination for r in tu.params_for(series, tuned, tu.DEFAULTS["iso_f"], ["g"]).collect()}
    assert got == {"a": 0.4, "z": 0.01}
    assert [r.g for r in tu.tune_if_needed(series, tuned, ["g"]).collect()] == ["z"]


def test_macro_f1(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "a int, p int").agg(*[c.alias(n) for n, c in tu.macro_f1(F.col("a"), F.col("p")).items()])
    r = df.first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 2, 1, 4)
    assert r.macro_f1 == pytest.approx((6 / 9 + 8 / 11) / 2)
    empty = spark.createDataFrame([(0, 0)], "a int, p int").agg(tu.macro_f1(F.col("a"), F.col("p"))["macro_f1"]).first()[0]
    assert empty == 0.5


def test_forest_objective_by_hand(spark):
    df = noisy(spark, 200, nulls=0.0)
    grid = tu.param_grid(spark, tu.DEFAULTS["iso_f"], {"contamination": "0.1*0.3", "num_of_trees": "200*600"})
    got = {(r.g, r.combo_id): r.error for r in tu.objective_iforest(df, SPEC, grid).collect()}
    assert len(got) == 2 * 4
    flagged = by_id(mean_ci_inlier(df, SPEC), "g", "inlier")
    for row in grid.collect():
        sample = iforest.iforest_sample(df, SPEC, row.num_of_trees // tu.TREES_PER_SUBSAMPLE, seed=42)
        scores = by_id(iforest.score_iforest(df, iforest.fit_curves(sample, SPEC), SPEC), "anomaly_score_2")
        for g in ("a", "b"):
            at = flagged.g == g
            s = scores.anomaly_score_2[at]
            predicted = s < np.quantile(s, row.contamination)
            actual = flagged.inlier[at] == 0
            f1 = []
            for side in (True, False):
                tp = ((predicted == side) & (actual == side)).sum()
                wrong = (predicted != actual).sum()
                f1.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0)
            assert got[(g, row.combo_id)] == pytest.approx(1 - np.mean(f1))


def test_objectives_give_every_combination(spark):
    df = noisy(spark, 120)
    grid = tu.param_grid(spark, tu.DEFAULTS["lstm"], tu.RANGES["lstm"])
    errors = tu.objective_forecast(df, SPEC, grid).toPandas()
    assert len(errors) == 96 and (errors.error < 1e-9).all()
    small = tu.param_grid(spark, tu.DEFAULTS["prophet"], {"changepoint_range": "0.2*0.5", "n_changepoints": "3*9"})
    errors = tu.objective_trend(df, SPEC, small).toPandas()
    assert len(errors) == 2 * 4 and errors.error.between(0, 100).all()
    assert len(tu.objective_trend(df, SPEC, small, kind="linear").toPandas()) == 8
    assert len(tu.objective_trend(df, ALONE, small).toPandas()) == 4


@pytest.mark.parametrize("chunk", [5_000_000, 60])
def test_rolling_origin_chooses_for_each_series(spark, monkeypatch, chunk):
    """A series driven by the row before last and one driven by the third last get different lags; errors as by hand."""
    from tidemark.operators import series

    monkeypatch.setattr(series, "ROWS_PER_CHUNK", chunk)
    rng = np.random.default_rng(4)
    made = {}
    for g, back in (("two", 2), ("three", 3)):
        y = list(rng.normal(0, 1, 3))
        for _ in range(237):
            y.append(-0.9 * y[-back] + rng.normal(0, 0.3))
        made[g] = np.array(y)
    df = frame(spark, [(g, i, v) for g, y in made.items() for i, v in enumerate(y)])
    grid = tu.param_grid(spark, tu.DEFAULTS["lstm"], {"lag": "1*3", "lahead": "2*6"})
    errors = tu.objective_rolling(df, SPEC, grid)
    best = {r.g: (r.lag, r.lahead) for r in tu.best_params(errors, grid, SPEC.groups).collect()}
    assert best == {"two": (2, 2), "three": (2, 4)}
    offsets = {0: [1], 1: [1], 2: [1, 2], 3: [1, 3]}
    for r in errors.collect():
        y = made[r.g]
        y, own = (y - y.min()) / (y.max() - y.min()), offsets[r.combo_id]
        at = np.arange(max(own), len(y))
        x, block = np.stack([np.ones(len(at))] + [y[at - o] for o in own], 1), at * 5 // len(y)
        away = [np.abs(x[block == k] @ np.linalg.lstsq(x[block < k], y[at][block < k], rcond=None)[0] - y[at][block == k]) for k in range(1, 5)]
        assert r.error == pytest.approx(np.concatenate(away).mean(), abs=1e-8)


def test_tail_window(spark):
    out = tu.tail_window(noisy(spark, 50), SPEC, 0.1).toPandas()
    assert sorted(out.id) == list(range(45, 50)) + list(range(95, 100))


def test_reports(spark):
    df = frame(spark, [("a", 0, 1), ("a", 1, 5), ("b", 0, 3), ("b", 2, None)])
    assert sorted(r.y for r in reports.timeline(df.where("y is not null"), SPEC).collect()) == [2, 5]
    stats = {r.metric: r.value for r in reports.descriptives(df, "y", {"g": "ALL"}).collect()}
    assert stats == {"mean": 3, "max": 5, "min": 1, "median": 3}
    options = {(r.dimension, r.option) for r in reports.filter_options(df, ["g", "id"]).collect()}
    assert ("g", "ALL") in options and ("id", "3") in options and len(options) == 3 + 5
    assert [r.id for r in reports.latest(df, SPEC, 2).collect()] == [1, 3]
    # Two filters hold together.
    both = reports.timeline(df, SPEC, {"g": "a", "id": 1}).collect()
    assert [r.y for r in both] == [5]
    models = spark.createDataFrame([("a", "iso_f"), ("a", "prophet"), ("b", "prophet"), ("z", "iso_f")], "g string, model string")
    shares = {r.model: r.share for r in reports.coverage(df, models, ["g"]).collect()}
    assert shares == {"iso_f": 0.5, "prophet": 1.0, "all": 0.75}
