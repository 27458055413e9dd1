"""Windows, ranks and percentiles: the same with and without cutting hot series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.data import ALONE, SPEC, by_id, frame, from_arrays, noisy
from tidemark.operators import clean, forecast, series, splits, trend
from tidemark.operators.forecast import ForecastParams
from tidemark.operators.series import HotSeries
from tidemark.spec import SeriesSpec

P = ForecastParams(lag=3, lahead=6, tsteps=4)


def hot_case(spark, parts):
    """One series with nine tenths of the rows, nulls, and rows that share a time."""
    rng = np.random.default_rng(1)
    n = 900
    seconds = np.sort(rng.integers(0, 300, n)) ** 2
    y = rng.normal(10, 3, n)
    y[rng.random(n) < 0.3] = np.nan
    rows = [("hot", s, None if np.isnan(v) else v) for s, v in zip(seconds, y)]
    rows += [("cool", i * 60, float(i)) for i in range(100)]
    return frame(spark, rows, parts)


OPERATORS = {
    "fill": lambda df, s, h: clean.fill_previous(df, s, hot=h).select("id", "y"),
    "average": lambda df, s, h: forecast.moving_average(df, s, 4, "y2", h).select("id", "y2"),
    "lags": lambda df, s, h: forecast.lag_matrix(df, s, P, hot=h).select(
        "id", *[F.col("lags")[i].alias(f"l{i}") for i in range(3)]),
    "position": lambda df, s, h: series.with_position(df, s, h).select("id", "pos", "n"),
    "trim": lambda df, s, h: forecast.trim_warmup(df, s, P, hot=h).select("id", "pos"),
    "last": lambda df, s, h: series.last_rows(df, s, 7, h).select("id"),
    "many_last": lambda df, s, h: series.last_rows(df, s, 1001, h).select("id"),
    "knots": lambda df, s, h: trend.changepoint_grid(df, s, hot=h).select(F.col("knot").alias("id"), "ds"),
}


@pytest.mark.parametrize("spec", [SPEC, ALONE], ids=["groups", "alone"])
@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(spark, name, spec):
    plain = series.HotSeries(spec, 10 ** 9, None)
    expected = OPERATORS[name](hot_case(spark, 1), spec, plain).toPandas()
    df = hot_case(spark, 5)
    for limit in (20, 150):
        hot = series.hot_series(df, spec, limit)
        assert hot.table is not None
        got = OPERATORS[name](df, spec, hot).toPandas()
        key = list(expected.columns)
        pd.testing.assert_frame_equal(
            got.sort_values(key).reset_index(drop=True), expected.sort_values(key).reset_index(drop=True))


def test_chunks_are_even(spark):
    df = hot_case(spark, 4)
    hot = series.hot_series(df, SPEC, 40)
    sizes = series.add_chunks(df, hot).groupBy("g", "_chunk").count().toPandas()
    assert (sizes[sizes.g == "hot"]["count"] <= 80).all() and (sizes.g == "hot").sum() > 10


def test_hot_series_are_measured(spark):
    df = hot_case(spark, 3)
    assert series.hot_series(df, SPEC).table is None
    hot = series.hot_series(df, SPEC, 99)
    assert {r["g"]: r["_rows"] for r in hot.table.collect()} == {"hot": 900, "cool": 100}
    assert hot.above(500).table.count() == 1 and hot.above(1000).table is None


@pytest.mark.parametrize("q", [0.0, 0.003, 0.01, 0.5, 0.97, 1.0])
def test_exact_percentile(spark, q):
    rng = np.random.default_rng(2)
    y = np.concatenate([np.round(rng.normal(0, 1, 30000), 2), rng.normal(5, 1, 37), [4.0]])
    g = ["big"] * 30000 + ["small"] * 37 + ["one"]
    df = from_arrays(spark, g, np.arange(len(y)), y)
    expected = pd.Series(y).groupby(pd.Series(g)).quantile(q)
    for hot in (None, series.hot_series(df, SPEC, 1000), series.HotSeries(SPEC, 1, None)):
        got = series.exact_percentile(df, ["g"], "y", q, "v", hot).toPandas().set_index("g")["v"]
        assert np.allclose(got.loc[expected.index], expected, atol=1e-12)
        many = series.exact_percentiles(df, ["g"], "y", [q, 0.25], "v", hot).toPandas().set_index("g")["v"]
        assert np.allclose([v[0] for v in many.loc[expected.index]], expected, atol=1e-12)
    alone = series.exact_percentile(df.select("y"), [], "y", q, "v").first()["v"]
    assert alone == pytest.approx(np.quantile(y, q))


@pytest.mark.parametrize("limit", [3, 40])
def test_percentiles_by_counting(spark, monkeypatch, limit):
    """Many keys and percentiles at once, with brackets of a few rows; equal to numpy."""
    rng = np.random.default_rng(5)
    parts = {"normal": rng.normal(0, 1, 3000), "wide": 10.0 ** rng.uniform(-300, 300, 2000), "ties": rng.integers(0, 4, 900) * 1.0,
             "one": np.full(500, 7.0), "hot end": np.concatenate([np.zeros(800), [1e9, -1e9]]), "few": np.array([2.0, 1.0])}
    g = np.concatenate([[k] * len(v) for k, v in parts.items()])
    df = from_arrays(spark, g, np.arange(len(g)), np.concatenate(list(parts.values())))
    df = df.unionByName(frame(spark, [("unknown", i, None) for i in range(60)]))
    sorted_sizes, inner = [], series._at_ranks

    def watched(counted, brackets, order):
        if order == "_v":
            sorted_sizes.extend(b.rows for b in brackets)
        return inner(counted, brackets, order)

    monkeypatch.setattr(series, "_at_ranks", watched)
    monkeypatch.setattr(series, "SPLITTERS", 9)
    qs = [0.0, 0.001, 0.01, 0.333, 0.5, 0.97, 1.0]
    hot = series.hot_series(df, SPEC, limit)
    got = {r["g"]: r["v"] for r in series.exact_percentiles(df, ["g"], "y", qs, "v", hot).collect()}
    assert got.pop("unknown") is None and set(got) == set(parts)
    for key, y in parts.items():
        assert np.allclose(got[key], np.quantile(y, qs), rtol=1e-12, atol=0), key
    assert sorted_sizes and max(sorted_sizes) <= limit


def test_percentile_of_a_hot_table_without_groups(spark, monkeypatch):
    monkeypatch.setattr(series, "ROWS_PER_BRACKET", 10)
    y = np.random.default_rng(1).normal(0, 1, 1001)
    df = from_arrays(spark, ["a"] * 1001, np.arange(1001), y)
    assert series.exact_percentile(df, [], "y", 0.25, "v").first()["v"] == pytest.approx(np.quantile(y, 0.25), abs=1e-12)
    unknown = df.withColumn("y", F.lit(None).cast("double"))
    assert series.exact_percentile(unknown, [], "y", 0.25, "v").collect() == [(None,)]


def test_statistics_without_groups(spark):
    df = frame(spark, [("a", 0, 1), ("b", 1, 3)])
    out = series.attach_stats(df, [], F.avg("y").alias("m"), F.count(F.lit(1)).alias("k"))
    assert [(r["m"], r["k"]) for r in out.collect()] == [(2.0, 2)] * 2


def test_lookback(spark):
    df = noisy(spark, 50)
    date = splits.split_date(df, "t", ratio=0.5)
    out = splits.with_lookback(df, SPEC, date, 4).toPandas()
    before = out[out.warmup == 1]
    assert before.groupby("g").size().to_dict() == {"a": 4, "b": 4}
    assert before.t.max() < pd.Timestamp(date) <= out[out.warmup == 0].t.min()


def test_order_and_partitions_do_not_matter(spark):
    one = by_id(clean.fill_previous(noisy(spark, 200, nulls=0.3, parts=1), SPEC), "y")
    many = by_id(clean.fill_previous(noisy(spark, 200, nulls=0.3, parts=7), SPEC), "y")
    pd.testing.assert_frame_equal(one, many)


def test_percentiles_of_hot_series_compute_the_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def value(number: pd.Series) -> pd.Series:
        seen.add(len(number))
        return number * 0.5

    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id")).withColumn("v", value("id"))
    spec = SeriesSpec("id", "v", "g")
    hot = HotSeries(spec, 100, spark.createDataFrame([(0, 1500), (1, 1500)], "g long, _rows long"))
    found = {r["g"]: r["q"] for r in series.exact_percentile(rows, ["g"], "v", 0.3, "q", hot).collect()}
    assert seen.value == 3000
    for g in (0, 1):
        assert found[g] == pytest.approx(float(np.quantile(np.arange(g, 3000, 2) * 0.5, 0.3)))
