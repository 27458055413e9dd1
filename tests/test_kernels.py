"""Numeric kernels against commons-math on the driver's JVM; draws against trying every round."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import kernels, sampling


@pytest.mark.parametrize("a,b", [(3, 5), (1, 30001), (0.5, 7), (25000, 5000), (15000, 15001), (2, 2), (1, 1)])
def test_beta_quantile(spark, a, b):
    dist = spark._jvm.org.apache.commons.math3.distribution.BetaDistribution(float(a), float(b), 1e-13)
    p = np.array([0.001, 0.05, 0.3, 0.5, 0.77, 0.95, 0.9999])
    ours = kernels.beta_ppf(p, float(a), float(b))
    theirs = np.array([dist.inverseCumulativeProbability(float(v)) for v in p])
    assert np.allclose(ours, theirs, rtol=1e-8, atol=1e-12)
    assert np.allclose(kernels.betainc(float(a), float(b), ours), p, atol=1e-10)


@pytest.mark.parametrize("df", [1, 2, 9, 10, 250, 10001])
def test_student_t(spark, df):
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    t = np.array([-3.0, -0.2, 0.0, 0.4, 2.2, 8.0])
    assert np.allclose(kernels.t_sf(t, float(df)), [1 - dist.cumulativeProbability(float(v)) for v in t], atol=1e-10)
    q = np.array([0.01, 0.4, 0.975, 0.9875])
    assert np.allclose(kernels.t_ppf(q, float(df)), [dist.inverseCumulativeProbability(float(v)) for v in q], rtol=1e-7)


def test_outside_the_domain():
    out = kernels.beta_ppf(np.array([0.0, 1.0, 1.2, -0.1, np.nan, 0.5]), 2.0, np.array([3.0, 3, 3, 3, 3, -1]))
    assert out[0] == 0 and out[1] == 1 and np.isnan(out[2:]).all()


def test_columns(spark):
    df = spark.createDataFrame([(0.3, 3.0, 5.0), (1.5, 3.0, 5.0), (0.5, 0.0, 5.0)], "p double, a double, b double")
    rows = [r[0] for r in df.select(kernels.beta_quantile("p", df.a, df.b)).collect()]
    assert rows[0] == pytest.approx(0.27633969346036924) and rows[1] is None and rows[2] is None
    one = spark.range(10, 11)
    t = one.select(kernels.t_critical(0.975, one.id))
    assert t.first()[0] == pytest.approx(2.228138851986303)
    assert kernels.z_quantile(0.975) == pytest.approx(1.959963984540054)


def test_student_t_quantile_of_many_degrees():
    for df in (1e6, 2e7, 1e8, 3e8, 1e12):
        assert np.allclose(kernels.t_ppf(np.array([0.975, 0.025]), df), [1.959963985, -1.959963985], rtol=3e-6)
    edge = kernels.t_ppf(np.array([0.975]), 1e5), kernels.t_ppf(np.array([0.975]), 1.0001e5)
    assert abs(edge[0] - edge[1])[0] < 1e-8


def test_student_t_tail_of_many_degrees():
    """Next to the normal tail, from any number of degrees on; the two ways meet at the limit."""
    for df in (1e9, 1e10, 1e12, 1e15):
        assert kernels.t_sf(np.array([0.01, -0.01, 0.0, 2.0]), df) == pytest.approx([0.4960106437, 0.5039893563, 0.5, 0.0227501319], abs=1e-9)
    t = np.array([0.01, 0.7, 3.0, 12.0, 29.9, 30.1, 200.0])
    few, many = kernels.t_sf(t, kernels.MANY), kernels.t_sf(t, kernels.MANY * (1 + 1e-9))
    assert many == pytest.approx(few, rel=1e-6) and np.isnan(kernels.t_sf(np.array([np.nan]), 1e9)).all()


def test_limits_are_loud(monkeypatch):
    big = kernels.betainc(np.array([3e9]), np.array([5e9]), np.array([0.375]))
    assert big[0] == pytest.approx(0.5, abs=1e-4)
    monkeypatch.setattr(kernels, "betainc", lambda a, b, x: np.full_like(x, np.nan))
    with pytest.raises(ArithmeticError):
        kernels.beta_ppf(0.3, 2.0, 3.0)


@pytest.mark.parametrize("case", ["any", "small steps", "backward", "still", "narrow", "all"])
def test_draws_are_found_without_looking_at_every_round(case):
    rng = np.random.default_rng(len(case))
    n = 400
    h1, h2 = rng.integers(0, 2**32, (2, n))
    limit = sampling.DRAW_RANGE * 10.0 ** rng.uniform(-6, 0.3, n)
    rounds = rng.integers(0, 1500, n)
    if case == "small steps":
        h1, h2 = rng.integers(0, 5000, n), rng.integers(1, 50, n)
    elif case == "backward":
        h2 = sampling.DRAW_RANGE - rng.integers(1, 50, n)
    elif case == "still":
        h2 = rng.integers(0, 2, n) * sampling.DRAW_RANGE
    elif case == "narrow":
        limit = rng.integers(-2, 3, n) * 1.0
    elif case == "all":
        limit = sampling.DRAW_RANGE + rng.integers(-2, 3, n) * 1.0
    found, expected = (f(h1, h2, limit, rounds) for f in (sampling.hits, sampling.tried))
    assert np.array_equal(found[0], expected[0]) and np.array_equal(found[1], expected[1])


def test_rounds_of_rows_drawn_often_and_seldom(monkeypatch):
    rng = np.random.default_rng(3)
    h1, h2 = (pd.Series(v) for v in rng.integers(0, 2**32, (2, 2500)))
    limit, rounds = pd.Series(sampling.DRAW_RANGE * 10.0 ** rng.uniform(-4, 0.1, 2500)), pd.Series(rng.integers(0, 300, 2500))
    out = sampling.rounds_within.func(h1, h2, limit, rounds)
    row, at = sampling.tried(*(c.to_numpy() for c in (h1, h2, limit, rounds)))
    assert [list(v) for v in out] == [list(at[row == i]) for i in range(2500)]
    assert len(sampling.rounds_within.func(*(c[:0] for c in (h1, h2, limit, rounds)))) == 0
