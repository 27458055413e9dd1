from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.data import SPEC, START, frame, from_arrays
from tidemark.functions.dates import PARTS, date_part
from tidemark.functions.sampling import cap_sample
from tidemark.operators import splits, timeparts as tp

HOUR, DAY = 3600, 86400


def levelled(spark, seconds, level, seed=0):
    rng = np.random.default_rng(seed)
    return from_arrays(spark, "a", seconds, level + rng.normal(0, 1, len(seconds)))


def accepted(df, **kw):
    return tp.accepted_parts(tp.select_time_parts(df, SPEC, **kw))


def test_year_branch(spark):
    s = np.arange(0, 3 * 365 * DAY, 6 * HOUR)
    df = levelled(spark, s, 20.0 * (s // (365 * DAY)))
    found = tp.select_time_parts(df, SPEC)
    by_part = {d.part: d for d in found}
    assert tp.accepted_parts(found) == ["year"]
    assert by_part["year"].pairs == 3 and by_part["year"].differing == 3
    # An accepted year makes the quarter redundant; the others never pass in compat mode.
    assert not by_part["quarter"].tested and not by_part["week_day"].tested
    assert accepted(df, exact=True) == ["year"]


def test_quarter_branch(spark):
    s = np.arange(0, 400 * DAY, 3 * HOUR)
    df = levelled(spark, s, 10.0 * (s // (91 * DAY)))
    assert accepted(df) == ["quarter"]


def test_hour_branch(spark):
    s = np.arange(0, 2 * DAY, 7)
    df = levelled(spark, s, 5.0 * (s // HOUR % 24))
    assert accepted(df) == ["hour"]
    flat = levelled(spark, s, 0.0 * s)
    assert accepted(flat) == []
    # Without compat, the part of the day is tested first and then replaces the hour.
    assert "day_part" in accepted(df, compat=False) and "hour" not in accepted(df, compat=False)


def test_one_time_only(spark):
    df = frame(spark, [("a", 5, i) for i in range(10)])
    assert tp.finest_part(df, "t").first()["grain"] is None
    assert tp.select_time_parts(df, SPEC) == []


def test_daily_data_has_no_parts(spark):
    df = levelled(spark, np.arange(0, 900 * DAY, DAY), 0.0)
    assert tp.finest_part(df, "t").first()["grain"] == "week_day"
    assert not any(d.tested for d in tp.select_time_parts(df, SPEC))


def test_date_parts(spark):
    df = spark.createDataFrame([(datetime(2024, 12, 30, 21, 5, 7),), (datetime(2023, 1, 1, 6, 0, 0),)], "t timestamp")
    rows = df.select(*[date_part("t", p).alias(p) for p in PARTS]).collect()
    assert tuple(rows[0]) == (2024, "Q4_2024", 12, 1, 0, 1, "evening2", 21, 5, 7)
    assert tuple(rows[1]) == (2023, "Q1_2023", 1, 52, 1, 7, "night", 6, 0, 0)


def test_rounds(spark):
    sizes = [1, 2, 9, 10, 999, 1000, 1001, 9999, 10000, 100000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = [r[0] for r in df.select(tp.bootstrap_rounds(F.col("n"))).collect()]
    assert got == [1, 1, 1, 1, 99, 1, 10, 99, 1, 10] == [tp._rounds_of(n) for n in sizes]


def test_counts(spark):
    df = frame(spark, [("a", 0, 1), ("a", 1, 1), ("a", HOUR, 1)])
    assert not tp.part_counts_ok(df, "t", "hour").first()["ok"]
    more = df.union(df.withColumn("id", F.col("id") + 10))
    assert tp.part_counts_ok(more, "t", "hour").first()["ok"]
    assert not tp.part_counts_ok(df, "t", "year").first()["ok"]


def test_t_test(spark):
    df = spark.createDataFrame([(10.0, 8.0, 4.0, 9.0, 6, 6), (5.0, 5.0, 0.0, 0.0, 3, 3), (5.0, 4.0, 0.0, 0.0, 3, 3)],
                               "m1 double, m2 double, v1 double, v2 double, n1 long, n2 long")
    rows = tp.t_test(df, "m1", "m2", "v1", "v2", "n1", "n2").collect()
    assert rows[0]["t"] == pytest.approx(2 / np.sqrt(13 / 6)) and rows[0]["rejected"] == 0
    assert rows[0]["ci_high"] - rows[0]["ci_low"] == pytest.approx(2 * 2.228138851986303 * np.sqrt(13 / 6))
    assert rows[1]["rejected"] == 0 and rows[2]["rejected"] == 1


def test_bootstrap_by_brute_force(spark):
    """Every draw repeated in NumPy from the same hashes."""
    from tidemark.functions.sampling import add_hashes
    s = np.arange(0, 3 * HOUR, 60)
    df = levelled(spark, s, 0.8 * (s // HOUR))
    got = {(r.level_a, r.level_b): r for r in tp.bootstrap_t_test(df, date_part("t", "hour"), SPEC, seed=4).collect()}
    rows = add_hashes(df, ["id"], 5).withColumn("level", F.hour("t").cast("string")).toPandas()
    from tidemark.functions.kernels import t_ppf
    for (a, b), r in got.items():
        yes = 0
        for k in range(r.rounds):
            stats = []
            for level in (a, b):
                part = rows[rows.level == level].assign(d=lambda x: (x._h1 + (k + 1) * x._h2) % 2147483647)
                y = part.sort_values(["d", "id"]).head(r.m).y.to_numpy()
                stats.append((y.mean(), y.var()))
            t = abs(stats[0][0] - stats[1][0]) / np.sqrt((stats[0][1] + stats[1][1]) / r.m)
            yes += t <= t_ppf(np.array([1 - 0.0125]), np.array([2.0 * r.m - 2]))[0]
        assert r.m == 36 and r.rounds == 6 and r.h0_share == pytest.approx(yes / r.rounds)


def test_cap_sample(spark):
    df = from_arrays(spark, ["a"] * 3000 + ["b"] * 20, np.arange(3020), np.arange(3020))
    one = cap_sample(df, ["g"], ["id"], 100, 3).toPandas()
    assert one.groupby("g").size().to_dict() == {"a": 100, "b": 20}
    again = cap_sample(df.repartition(7), ["g"], ["id"], 100, 3).toPandas()
    assert set(one.id) == set(again.id) != set(cap_sample(df, ["g"], ["id"], 100, 4).toPandas().id)
    assert cap_sample(df, [], ["id"], 50).count() == 50


def test_apply_parts(spark):
    df, spec = tp.apply_time_parts(frame(spark, [("a", HOUR * 25, 1)]), SPEC, "hour*week_day")
    assert spec.groups == ("g", "hour", "week_day") and tuple(df.first()[p] for p in spec.groups) == ("a", 1, 6)
    same, spec = tp.apply_time_parts(df, SPEC, "")
    assert spec.groups == ("g",)


@pytest.mark.parametrize("compat,expected", [(False, datetime(2021, 1, 4, 10)), (True, datetime(2021, 1, 4, 10))])
def test_weekdays(spark, compat, expected):
    top = spark.createDataFrame([(datetime(2021, 1, 6, 10),)], "m timestamp")   # a Wednesday
    assert top.select(splits.period_split_date(F.col("m"), "Mondays", compat)).first()[0] == expected
    friday = top.select(splits.period_split_date(F.col("m"), "Fridays", compat)).first()[0]
    assert friday == (datetime(2021, 1, 8, 10) if compat else datetime(2021, 1, 1, 10))


def test_split_dates(spark):
    df = frame(spark, [("a", 0, 1), ("a", 1000.5, 2)])
    assert splits.split_date(df, "t", ratio=0.8) == datetime(2021, 1, 1, 0, 13, 20)
    assert splits.split_date(df, "t", "Only Once") == datetime(2021, 1, 1, 0, 13, 20)
    assert splits.split_date(df, "t", "hourly") == splits.split_date(df, "t", "Hourly") < START
    past, new = splits.split(df, "t", datetime(2021, 1, 1, 0, 13, 20))
    assert (past.count(), new.count()) == (1, 1)
    assert splits.query_date("train", START) is None and splits.query_date("prediction", START) == START
