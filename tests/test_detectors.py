import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.data import ALONE, SPEC, by_id, frame, from_arrays, noisy
from tidemark.functions.kernels import beta_ppf
from tidemark.operators import forecast as fc
from tidemark.operators import iforest, series, trend
from tidemark.operators import residual_score as rs
from tidemark.operators.series import HotSeries, hot_series

# ---- forecaster


def test_defaults_recover_the_moving_average(spark):
    df = noisy(spark, 200)
    m = fc.fit_forecaster(df, SPEC).toPandas()
    assert np.allclose(np.stack(m.coefficients), 0.5) and np.allclose(m.intercept, 0, atol=1e-9)
    out = fc.predict_forecast(df, fc.fit_forecaster(df, SPEC), SPEC)
    base = fc.predict_forecast(df, None, SPEC, baseline="moving_average")
    a, b = by_id(out, "predict"), by_id(base, "predict")
    assert np.allclose(a.predict, b.predict, equal_nan=True) and a.predict.isna().sum() == 2


@pytest.mark.parametrize("horizon", [0, 1, 2])
def test_against_least_squares(spark, horizon):
    p = fc.ForecastParams(lag=3, lahead=3, tsteps=4, horizon=horizon)
    df = noisy(spark, 150, series=("a",))
    y = by_id(df, "y").y.to_numpy()
    s = (y - y.min()) / (y.max() - y.min())
    shifts = [horizon + i for i in range(3)]
    x = np.stack([np.concatenate([np.full(k, np.nan), s[:len(s) - k]]) for k in shifts], axis=1)
    target = s if horizon else pd.Series(s).rolling(4).mean().to_numpy()
    ok = ~np.isnan(x).any(axis=1) & ~np.isnan(target)
    expected = np.linalg.lstsq(np.c_[np.ones(ok.sum()), x[ok]], target[ok], rcond=None)[0]
    m = fc.fit_forecaster(df, SPEC, p).first()
    assert np.allclose([m.intercept, *m.coefficients], expected, atol=1e-9)


def test_constant_and_short_series(spark):
    rows = [("flat", i, 7.0) for i in range(50)] + [("one", 0, 1.0)] + [("short", i, i) for i in range(32)]
    df = frame(spark, rows)
    m = {r.g: r for r in fc.fit_forecaster(df, SPEC).collect()}
    assert set(m) == {"flat"}
    out = fc.predict_forecast(df, fc.fit_forecaster(df, SPEC), SPEC).where("g = 'flat'").toPandas()
    assert np.allclose(out.predict.dropna(), 7.0)
    assert fc.predict_forecast(df, fc.fit_forecaster(df, SPEC), SPEC).where("g = 'one'").first().predict is None


def test_scaling(spark):
    df = noisy(spark, 50)
    bounds = fc.scale_bounds(df, SPEC)
    out = fc.scale(df, bounds, SPEC, "s").withColumn("back", fc.unscaled(F.col("s"))).toPandas()
    assert out.s.min() == 0 and out.s.max() == 1 and np.allclose(out.back, out.y)
    same = fc.minmax_scale(out_norm(spark), SPEC, normalized=True).toPandas()
    assert (same.y == same.y_norm).all()
    assert fc.is_normalized(out_norm(spark), "y").first()[0] and not fc.is_normalized(df, "y").first()[0]


def out_norm(spark):
    return frame(spark, [("a", i, i / 10) for i in range(11)])


@pytest.mark.parametrize("n,expected", [(7, (1, 3, 3)), (16, (1, 16, 16)), (160, (10, 16, 16)), (176, (11, 16, 32)),
                                        (336, (21, 16, 48)), (31 * 16, (31, 16, 7 * 16))])
def test_batch_plan(spark, n, expected):
    df = spark.createDataFrame([(n,)], "n long").withColumns(fc.batch_plan(F.col("n")))
    assert (df.first().batches, df.first().batch_size, df.first().holdout_rows) == expected


def test_residuals(spark):
    df = spark.createDataFrame([(0.0, 5.0), (3.0, 5.0), (None, 5.0), (3.0, None)], "y double, p double")
    got = [r[0] for r in df.select(fc.residuals(F.col("y"), F.col("p"))).collect()]
    assert got == [1e6, 2.0, 1e6, None]
    assert df.select(fc.residuals(F.col("y"), F.col("p"), None)).first()[0] == 5.0


# ---- residual scores


@pytest.mark.parametrize("carry", [True, False])
def test_beta_score_by_hand(spark, carry):
    """The score of every row, folded in plain Python over the drawn rounds."""
    df = noisy(spark, 120, seed=3).withColumn("residuals", F.abs(F.col("y") - 50))
    sizes = rs.sample_sizes(df, SPEC)
    rounds = rs.residual_rounds(df, SPEC, rounds=30, seed=9, sizes=sizes)
    out = rs.beta_params(df, rounds, sizes, SPEC, carry=carry)
    got = out.select("id", "g", "residuals", "p", "a", "b").toPandas().sort_values("id")
    size = {r.g: r.sample_size for r in sizes.collect()}
    assert size == {"a": 60, "b": 60}
    summary = rounds.toPandas().sort_values("round")
    for g, rows in got.groupby("g"):
        v = rows.residuals.to_numpy()
        scaled = (v - v.min()) / (v.max() - v.min())
        for value, s, p, a, b in zip(v, scaled, rows.p, rows.a, rows.b):
            want_p = s + 0.5 if value < scaled.mean() else s
            wa = wb = 1
            p2 = 1.0
            for r in summary[summary.g == g].itertuples():
                if not carry:
                    p2 = 1.0
                if r.round_max > value > r.round_min:
                    p1 = (value - r.round_min) / r.round_range
                    p2 = p1 + 0.5 if p1 < r.round_mean else p1
                wb += int(60 * p2)
                wa += int(60 * (1 - p2))
            assert (a, b) == (wa, wb) and p == pytest.approx(want_p)
    if carry:
        scored = by_id(rs.beta_score(df, SPEC, seed=9), "anomaly_score_1", "ad_label_1")
        want = beta_ppf(got.p.to_numpy(), got.a.to_numpy(float), got.b.to_numpy(float))
        assert np.allclose(scored.anomaly_score_1, want, equal_nan=True)
        label = (want < 0.05) | (want > 0.95)
        assert (scored.ad_label_1 == label.astype(int)).all()


def test_rounds_are_random_subsets(spark):
    df = noisy(spark, 3000, series=("a",)).withColumn("residuals", F.col("id").cast("double"))
    sizes = rs.sample_sizes(df, SPEC)
    drawn = rs.draw_rounds(df, sizes, SPEC, 30, "residuals").toPandas()
    counts = drawn.groupby("round").residuals.agg(["size", "nunique", "mean"])
    assert (counts["size"] == 1000).all() and (counts["nunique"] == 1000).all()
    assert abs(counts["mean"].mean() - 1499.5) < 40 and counts["mean"].std() > 5
    overlap = len(set(drawn[drawn["round"] == 0].residuals) & set(drawn[drawn["round"] == 1].residuals))
    assert 280 < overlap < 390
    again = rs.draw_rounds(df.repartition(11), sizes, SPEC, 30, "residuals").toPandas()
    assert set(map(tuple, again[["round", "residuals"]].values)) == set(map(tuple, drawn[["round", "residuals"]].values))


def test_sample_size(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (5, 5), (20, 20), (31, 31), (31, 10), (1999, 1999), (5000, 5000)],
                               "r long, k long")
    got = [r[0] for r in df.select(rs.sample_size(F.col("r"), F.col("k"))).collect()]
    assert got == [1, 1, 3, 5, 15, 8, 999, 1000]


def test_no_score_no_label(spark):
    df = spark.createDataFrame([(None,), (0.01,), (0.5,), (0.99,)], "s double")
    assert [r[0] for r in df.select(rs.label_two_tail(F.col("s"))).collect()] == [0, 1, 0, 1]


def test_student_t(spark):
    df = frame(spark, [("a", i, v) for i, v in enumerate([1, 2, 3, 4])] + [("flat", 0, 1), ("flat", 1, 1)])
    df = df.withColumn("residuals", F.col("y"))
    out = by_id(rs.student_t_score(df, SPEC), "t_value", "anomaly_score_1")
    assert out.t_value[0] == pytest.approx(1.5 / np.sqrt(1.25 / 4)) and np.isnan(out.anomaly_score_1[4])


# ---- forest


def test_closed_form_is_the_mean_of_random_trees():
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(0, 1, 40), 1)
    x, height = iforest.expected_path(values)

    def depth(part, target, rng):
        if part.size == 1 or part[0] == part[-1]:
            return float(iforest.average_path(part.size))
        cut = rng.uniform(part[0], part[-1])
        at = np.searchsorted(part, cut, side="right")
        return 1 + depth(part[:at] if target <= cut else part[at:], target, rng)

    for i in (0, 5, len(x) // 2, len(x) - 1):
        mean = np.mean([depth(np.sort(values), x[i], rng) for _ in range(3000)])
        assert mean == pytest.approx(height[i], abs=0.15)


def test_forest_scores(spark):
    df = noisy(spark, 500, series=("a",)).withColumn("y", F.when(F.col("id") == 77, 500.0).otherwise(F.col("y")))
    models = iforest.fit_iforest(df, SPEC, 0.01)
    out = by_id(iforest.predict_iforest(df, models, SPEC), "y", "anomaly_score_2", "ad_label_2")
    assert out.anomaly_score_2.between(-1, 0, inclusive="left").all()
    assert out.ad_label_2[77] == 1 and out.ad_label_2.sum() <= 5
    # Farther out on the same side is never less anomalous.
    low = out[out.y < out.y.quantile(0.02)].sort_values("y")
    assert low.anomaly_score_2.is_monotonic_increasing
    sampled = iforest.fit_iforest(df, SPEC, 0.01, 200, "sampled")
    other = by_id(iforest.predict_iforest(df, sampled, SPEC), "anomaly_score_2", "ad_label_2")
    assert other.ad_label_2[77] == 1
    assert np.corrcoef(out.anomaly_score_2, other.anomaly_score_2)[0, 1] > 0.9


def test_each_of_the_trees_has_a_sample_of_its_own(spark):
    """1000 samples of 256 see nearly every value of a long series; a short series needs one sample."""
    df = noisy(spark, 9000, series=("long",)).unionByName(noisy(spark, 100, series=("short",)))
    models = {r.g: r for r in iforest.fit_iforest(df, SPEC, most=None).select("g", "knots", "heights").collect()}
    assert len(models["long"].knots) > 8900
    x, height = iforest.expected_path(np.array([r.y for r in df.where("g = 'short'").collect()]))
    assert models["short"].knots == x.tolist() and models["short"].heights == pytest.approx(height.tolist())


@pytest.mark.parametrize("mode, most, error", [("exact", iforest.KNOTS, 0.02), ("exact", 300, 0.3), ("sampled", iforest.KNOTS, 0.08), ("sampled", 300, 0.4)])
def test_a_bounded_forest_is_close_to_the_whole_one(spark, mode, most, error):
    """At most ``most`` knots; the error kept with the model bounds the distance of all path lengths and scores."""
    df = noisy(spark, 6000, series=("long",)).unionByName(noisy(spark, 100, series=("short",)))
    df = df.withColumn("y", F.when(F.col("id") == 5, 400.0).otherwise(F.round("y", 3)))
    sample = iforest.iforest_sample(df, SPEC, 200, once=mode == "exact")
    trees = iforest.tree_curves(sample, SPEC, mode)
    whole, bounded = ({r.g: r for r in iforest.fit_curves(sample, SPEC, mode, most=m).collect()} for m in (None, most))
    assert trees.select(F.max(F.size("curve.knots"))).first()[0] <= iforest.PSI
    assert len(whole["long"].knots) > 4000 and len(bounded["long"].knots) <= most and whole["long"].path_error == 0
    x = np.sort(np.concatenate([np.array(whole["long"].knots), np.linspace(-50, 500, 4000)]))
    for g in ("long", "short"):
        a, b = (iforest.interpolated(x, np.array(m[g].knots), np.array(m[g].heights)) for m in (whole, bounded))
        assert np.abs(a - b).max() <= bounded[g].path_error + 1e-9 <= error
        scores = [iforest.curve_score(x, np.array(m[g].knots), np.array(m[g].heights), m[g].path_norm) for m in (whole, bounded)]
        assert np.abs(scores[0] - scores[1]).max() <= np.log(2) * bounded[g].path_error / bounded[g].path_norm + 1e-9


def test_the_merged_curve_is_the_mean_of_its_trees(spark, monkeypatch):
    """Three levels of merging give the plain mean, weighted by trees."""
    monkeypatch.setattr(iforest, "MERGED", 3)
    sample = iforest.iforest_sample(noisy(spark, 700, series=("a",)), SPEC, 20)
    for mode in ("exact", "sampled"):
        trees = iforest.tree_curves(sample, SPEC, mode).collect()
        got = iforest.fit_curves(sample, SPEC, mode, most=10**6).first()
        x = np.linspace(-30, 30, 997)
        want = np.mean([iforest.interpolated(x, np.array(t.curve.knots), np.array(t.curve.heights)) for t in trees], axis=0)
        assert iforest.interpolated(x, np.array(got.knots), np.array(got.heights)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("groups", [SPEC, ALONE])
def test_models_too_large_to_send_meet_rows_by_key(spark, monkeypatch, groups):
    df = noisy(spark, 300)
    models = iforest.fit_iforest(df, groups, trees=20)
    sent = iforest.score_iforest(df, models, groups)
    assert "CoGroup" not in sent._jdf.queryExecution().toString()
    plain = by_id(sent, "anomaly_score_2")
    monkeypatch.setattr(iforest, "MODEL_BYTES", 10)
    met = iforest.score_iforest(df, models, groups)
    assert "CoGroup" in met._jdf.queryExecution().toString()
    pd.testing.assert_frame_equal(plain, by_id(met, "anomaly_score_2"))


def test_many_rounds_draw_as_few_do(spark, monkeypatch):
    from tidemark.operators import residual_score

    df = noisy(spark, 700)
    many = sorted(map(tuple, iforest.iforest_sample(df, SPEC, 70).collect()))
    monkeypatch.setattr(residual_score, "FEW_ROUNDS", 70)
    assert sorted(map(tuple, iforest.iforest_sample(df, SPEC, 70).collect())) == many and len(many) == 2 * 70 * 256


def test_hot_series_are_scored_in_slots(spark, monkeypatch):
    df = noisy(spark, 300)
    models = iforest.fit_iforest(df, SPEC)
    plain = by_id(iforest.predict_iforest(df, models, SPEC), "anomaly_score_2", "ad_label_2")
    monkeypatch.setattr(series, "ROWS_PER_GROUP", 40)
    monkeypatch.setattr(iforest, "MODEL_BYTES", 10)
    cut = by_id(iforest.predict_iforest(df, models, SPEC), "anomaly_score_2", "ad_label_2")
    pd.testing.assert_frame_equal(plain, cut)
    alone = iforest.fit_iforest(df, ALONE)
    assert by_id(iforest.predict_iforest(df, alone, ALONE), "ad_label_2").shape[0] == 600


def test_flat_and_unknown_series(spark):
    df = frame(spark, [("flat", i, 3) for i in range(20)] + [("one", 0, 1)])
    out = by_id(iforest.predict_iforest(df, iforest.fit_iforest(df, SPEC), SPEC), "anomaly_score_2", "ad_label_2")
    assert out.ad_label_2.sum() == 0 and out.anomaly_score_2.notna().all()
    new = frame(spark, [("new", 0, 1)])
    row = iforest.predict_iforest(new, iforest.fit_iforest(df, SPEC), SPEC).first()
    assert row.anomaly_score_2 is None and row.ad_label_2 == 0


# ---- trend


def test_line(spark):
    s = np.arange(0, 100) * 86400
    df = from_arrays(spark, "a", s, 3.0 + 0.5 * np.arange(100))
    m = trend.fit_linear(df, SPEC).first()
    assert (m.slope, m.intercept, m.sigma) == pytest.approx((0.5, 3.0, 0.0), abs=1e-9)
    out = trend.trend_band(df, trend.fit_trend(df, SPEC), SPEC).toPandas()
    assert np.allclose(out.yhat, out.y)
    bent = trend.trend_band(df, trend.fit_trend(df, SPEC, trend.TrendParams(kind="piecewise")), SPEC)
    assert np.allclose(by_id(bent, "yhat").yhat, by_id(df, "y").y, atol=0.05)


def test_flat_or_single(spark):
    df = frame(spark, [("flat", i, 2) for i in range(9)] + [("one", 0, 5)] + [("same", 0, 1), ("same", 0, 3)])
    for kind in ("linear", "piecewise"):
        models = trend.fit_trend(df, SPEC, trend.TrendParams(kind=kind))
        out = trend.label_band(trend.trend_band(df, models, SPEC), SPEC).toPandas()
        assert out[out.g != "same"].ad_label_3.sum() == 0 and out.yhat.notna().all()


def test_piecewise_follows_a_break(spark):
    n = 400
    t = np.arange(n)
    y = np.where(t < 20, 5.0 * t, 100 + 0.1 * (t - 20))
    df = from_arrays(spark, "a", t * 86400, y)
    p = trend.TrendParams(kind="piecewise")
    row = trend.fit_trend(df, SPEC, p).first()
    line = trend.fit_trend(df, SPEC).first()
    assert len(row.knot_days) == 39 and row.sigma < 0.25 * line.sigma


@pytest.mark.parametrize("offset", [1e3, 1e6, 1e9])
def test_piecewise_on_large_values(spark, offset):
    """Noise of size 1 is seen around any level; labels leave out what is within 1e-9 of the level."""
    n = 1000
    noise = np.random.default_rng(2).normal(0, 1, n)
    df = from_arrays(spark, "a", np.arange(n) * 3600, offset + noise)
    p = trend.TrendParams(kind="piecewise")
    models = trend.fit_trend(df, SPEC, p)
    assert 0.9 < models.first().sigma < 1.1
    out = trend.label_band(trend.trend_band(df, models, SPEC), SPEC).toPandas()
    assert 0.02 < out.ad_label_3.mean() < 0.09 or offset > 1e8
    lines, knots = trend.fit_trend_grid(df, SPEC, [p])
    assert abs(lines.first().offsets[0] - offset) < 10


def test_piecewise_against_direct_ridge(spark):
    """The fit from segment sums equals the ridge fit on the rows themselves."""
    rng = np.random.default_rng(5)
    n = 300
    t = np.sort(rng.random(n)) * 50
    t[0] = 0
    seconds = np.floor(t * 86400)
    y = 10 + np.cumsum(rng.normal(0, 1, n))
    df = from_arrays(spark, "a", seconds, y)
    p = trend.TrendParams(kind="piecewise", n_changepoints=8)
    m = trend.fit_trend(df, SPEC, p).first()
    days, knots = seconds / 86400, np.array(m.knot_days)
    width, size = days.max(), np.abs(y).max()
    x = np.c_[np.ones(n), days / width, np.maximum(0, (days[:, None] - knots) / width)]
    v = y / size
    beta = np.linalg.lstsq(x[:, :2], v, rcond=None)[0]
    noise = np.mean((v - x[:, :2] @ beta) ** 2)
    changes = np.full(len(knots), 0.05)
    for _ in range(100):
        before = noise
        prior = np.r_[np.full(2, noise / 25), noise / (0.05 * np.maximum(np.abs(changes), 1e-9))]
        beta = np.linalg.solve(x.T @ x + np.diag(prior), x.T @ v)
        noise = np.mean((v - x @ beta) ** 2)
        changes = beta[2:]
        if abs(noise - before) <= 1e-9 * before:
            break
    assert m.intercept == pytest.approx(beta[0] * size, rel=1e-6)
    assert np.allclose(m.slopes, beta[1:] * size / width, rtol=1e-5, atol=1e-8)
    assert m.sigma == pytest.approx(np.sqrt(noise) * size, rel=1e-6)


def test_grid_of_trends_equals_single_fits(spark):
    df = noisy(spark, 500, gap=3600)
    params = [trend.TrendParams(changepoint_range=a, n_changepoints=b, kind="piecewise") for a in (0.1, 0.3) for b in (5, 60)]
    lines, knots = trend.fit_trend_grid(df, SPEC, params)
    rows = df.join(knots, "g").withColumn("_t", trend.days_since("t", F.col("start")))
    rows = rows.withColumn("segment", trend.segment_of(F.col("_t"))).join(lines, ["g", "segment"])
    for i, p in enumerate(params):
        got = by_id(rows.withColumn("yhat", F.col("offsets")[i] + F.col("slopes")[i] * F.col("_t")), "yhat")
        one = by_id(trend.trend_band(df, trend.fit_trend(df, SPEC, p), SPEC), "yhat")
        assert np.allclose(got.yhat, one.yhat, rtol=1e-7)


def test_knots_follow_the_rows(spark):
    df = from_arrays(spark, "a", np.arange(1000), np.zeros(1000))
    p = trend.TrendParams(changepoint_range=0.5, n_changepoints=7)
    got = trend.changepoint_grid(df, SPEC, p).orderBy("knot").toPandas()
    rows = np.linspace(0, 499, 8).round()[1:]
    assert got.knot.tolist() == list(range(1, 8))
    assert [d.minute * 60 + d.second for d in got.ds] == rows.astype(int).tolist()
    few = trend.changepoint_grid(df.where("id < 40"), SPEC).toPandas()
    assert len(few) == 3


def test_band_labels(spark):
    df = spark.createDataFrame([(5.0, 1.0, 4.0), (0.0, 1.0, 4.0), (2.0, 1.0, 4.0), (0.5, 1.0, 4.0)],
                               "y double, yhat_lower double, yhat_upper double")
    rows = trend.label_band(df, SPEC).collect()
    assert [r.ad_label_3 for r in rows] == [1, 1, 0, 1]
    assert [r.anomaly_score_3 for r in rows] == [pytest.approx(0.2), None, 0.0, pytest.approx(1.0)]
    error = df.agg(trend.mape(F.col("y"), F.col("yhat_upper"))).first()[0]
    assert error == pytest.approx(100 * np.mean([0.2, 1.0, 7.0]))


def test_no_groups(spark):
    df = noisy(spark, 60)
    none = HotSeries(ALONE, 10, None)
    assert hot_series(df, ALONE, 10 ** 6).table is None and none.above(3).table is None
    for kind in ("linear", "piecewise"):
        models = trend.fit_trend(df, ALONE, trend.TrendParams(kind=kind))
        assert trend.trend_band(df, models, ALONE).where("yhat is null").count() == 0
    assert fc.fit_forecaster(df, ALONE).count() == 1
    scored = rs.beta_score(df.withColumn("residuals", F.col("y")), ALONE)
    assert scored.where("anomaly_score_1 is not null").count() > 100


def test_knots_of_many_parameters_come_from_one_pass(spark):
    """The rows are ranked once, not once for each parameter, and nothing is ranked in the plan of the lines."""
    df = noisy(spark, 300)
    params = [trend.TrendParams(changepoint_range=a, n_changepoints=b, kind="piecewise") for a in (0.1, 0.4) for b in (5, 20)]
    lines, knots = trend.fit_trend_grid(df, SPEC, params)
    days = {g: {round(d, 9) for d in found} for g, found in knots.select("g", "knot_days").collect()}
    each = {}
    for p in params:
        at = trend.changepoint_grid(df, SPEC, p).join(knots.select("g", "start"), "g")
        for r in at.select("g", trend.days_since("ds", F.col("start")).alias("d")).collect():
            each.setdefault(r.g, set()).add(round(r.d, 9))
    assert days == each and lines.count() > 0
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" not in plan
