import pytest
from pyspark.sql import functions as F

from tests.data import ALONE, SPEC, by_id, frame, noisy
from tidemark.operators import clean, filters
from tidemark.spec import SeriesSpec, parse_groups


def test_spec():
    assert parse_groups("store+city") == ("store", "city") and parse_groups("None") == ()
    spec = SeriesSpec("t", "y", "a+b", "id")
    assert spec.order == ["t", "id"] and spec.with_groups(["a"]).groups == ("a",)


def test_fill_previous(spark):
    y = [None, 1, 2, None, None, None, None, None, 9]
    out = by_id(clean.fill_previous(frame(spark, [("a", i, v) for i, v in enumerate(y)]), SPEC), "y")
    # Leading null and the null with no known value among the 3 before: series mean.
    assert out.y.tolist() == [4, 1, 2, 1.5, 1.5, 2, 4, 4, 9]


def test_known_values_stay(spark):
    df = noisy(spark, 100, nulls=0.4)
    before, after = by_id(df, "y"), by_id(clean.fill_previous(df, SPEC), "y")
    known = before.y.notna()
    assert (before.y[known] == after.y[known]).all() and after.y.notna().all()


def test_sparse_series_go(spark):
    rows = [("half", i, None if i % 2 else 1) for i in range(4)]
    rows += [("none", i, None) for i in range(3)] + [("most", i, None if i == 0 else 1) for i in range(3)]
    rows += [(None, 0, 1.0)]
    df = frame(spark, rows)
    assert {r.g for r in clean.drop_sparse_series(df, SPEC).where("g is not null").collect()} == {"most"}
    cleaned = clean.clean_series(df, SPEC).collect()
    assert {r.g for r in cleaned} == {"most"} and all(r.y == 1 for r in cleaned)
    assert clean.drop_sparse_series(df, ALONE).count() == 0
    assert clean.clean_series(frame(spark, [("a", 0, 1), ("b", 1, None), ("c", 2, 3)]), ALONE).count() == 3


def test_uniqueness(spark):
    df = frame(spark, [("a", 0, 1), ("a", 0, 3), ("a", 1, 5), ("b", 0, 1)])
    report = {r.g: (r.rows, r.distinct_times) for r in clean.uniqueness_report(df, SPEC).collect()}
    assert report == {"a": (3, 2), "b": (1, 1)}
    assert not clean.times_are_unique(df, SPEC)
    collapsed = clean.collapse_duplicates(df, SPEC)
    assert clean.times_are_unique(collapsed, SPEC)
    assert sorted(r.y for r in collapsed.collect()) == [1, 2, 5]


def test_filters(spark):
    df = frame(spark, [("a", 0, 1), ("b", 5, 2), (None, 9, 3)])
    assert filters.filter_levels(df, {"g": "a", "id": "ALL"}).count() == 1
    assert filters.filter_expr(df, "y >= 2 and g = 'b'").count() == 1
    assert filters.series_levels(df, ["g"]).count() == 2
    low, high = (F.lit(f"2021-01-01 00:00:0{s}").cast("timestamp") for s in (0, 5))
    assert filters.time_range(df, "t", low, high).count() == 2


def test_dense_levels(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", None, "z")], "g string, k int, h string")
    dense = filters.series_levels(df, ["g", "k", "h"], dense=True)
    assert dense.count() == dense.distinct().count() == 2 * 2 * 3


def test_product_is_made_by_as_many_tasks_as_it_needs(spark, monkeypatch):
    left = spark.range(300).select(F.col("id").alias("a"))
    right = spark.range(40).select(F.col("id").alias("b"))
    seen = {}
    for pairs in (10 ** 6, 1000, 50):
        monkeypatch.setattr(filters, "PAIRS_PER_TASK", pairs)
        made = filters.product(left, right)
        seen[pairs] = made.rdd.getNumPartitions()
        assert made.count() == made.distinct().count() == 300 * 40
    assert seen[10 ** 6] == 1 and 12 <= seen[1000] <= 18 and 240 <= seen[50] <= 300
    assert filters.product(left.where("a < 0"), right).count() == filters.product(left, right.where("b < 0")).count() == 0
    assert filters.product(left.where("a < 1"), right).count() == 40


def test_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = filters.filter_levels(df, {"l_returnflag": "R"}).select("l_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in text and "l_extendedprice" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("parts", [1, 6])
def test_empty_table(spark, parts):
    df = frame(spark, [("a", 0, 1)], parts).where("id < 0")
    assert clean.clean_series(df, SPEC).count() == 0
