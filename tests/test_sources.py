import json
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest

from tests.data import SPEC, frame
from tidemark.session import materialize, scratch_root
from tidemark.sources import readers, store


@pytest.mark.parametrize("sep", [",", ";", ":"])
def test_csv(spark, tmp_path, sep):
    lines = [["g", "y", "z"], ["caf\xe9", "1.5", "x"], ["short", "2"], ["long", "3", "x", "extra"],
             ["longer", "3", "x", "a", "b"], [f'"in{sep}side"', "4", "q"]]
    path = tmp_path / "in.csv"
    path.write_bytes("\n".join(sep.join(row) for row in lines).encode("latin-1"))
    rows = {r.g: (r.y, r.z) for r in readers.read_csv(spark, str(path), types={"y": "double"}).collect()}
    assert rows == {"caf\xe9": (1.5, "x"), "short": (2.0, None), f"in{sep}side": (4.0, "q")}


def test_json(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps([{"g": "a", "y": 1}, {"g": "b", "y": None}], indent=1))
    assert sorted(r.g for r in readers.read_json(spark, str(path)).collect()) == ["a", "b"]


@pytest.mark.parametrize("text,value", [
    (" 1.5 ", 1.5), ("1e3", 1000.0), ("abc", None), ("nan", None), ("inf", float("inf")), ("-Infinity", float("-inf")),
    ("", None), (None, None), ("1.5d", None), ("2F", None), ("1_000", 1000.0), ("7", 7.0)])
def test_coerce_feature(spark, text, value):
    df = spark.createDataFrame([(text,)], "y string")
    assert readers.coerce_feature(df, "y").first().y == value


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "y double")
    assert [r.y for r in readers.coerce_feature(df, "y").collect()] == [None, 2.0]


def test_coerce_time(spark):
    given = ["2024-01-02", "2024-01-02 03:04:05", "2024-01-02 03:04:05.123456", "2024-01-02T03:04:05", "2024-01-02T03:04:05Z",
             "01/02/2024", "20240102", "2024-01-02 03:04", "nonsense", None]
    df = spark.createDataFrame([(v,) for v in given], "t string")
    got = [r.t for r in readers.coerce_time(df, "t").collect()]
    day, second = datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5)
    assert got == [day, second, second.replace(microsecond=123456), second, second, day, day,
                   datetime(2024, 1, 2, 3, 4), None, None]
    row = readers.bad_times(df, "t").first()
    assert (row.given, row.unread) == (9, 1)


def test_coerce_time_further_formats(spark):
    second = datetime(2024, 1, 2, 3, 4, 5)
    given = {"2024-01-02T03:04:05.123Z": second.replace(microsecond=123000), "2024-01-02 03:04:05+00:00": second,
             "2024-01-02T03:04:05.5+02:00": datetime(2024, 1, 2, 1, 4, 5, 500000), "31/12/2024": datetime(2024, 12, 31),
             "2 Jan 2024": datetime(2024, 1, 2), "2 January 2024 03:04:05": second, "Jan 2, 2024": datetime(2024, 1, 2),
             "1/2/2024 03:04 PM": datetime(2024, 1, 2, 15, 4), "2024-01-02 03:04:05 AM": second, "20240102030405": second,
             "2024-01-02T03:04": datetime(2024, 1, 2, 3, 4), "2024-02-30": None, "13/13/2024": None}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert [r.t for r in readers.coerce_time(df, "t").collect()] == list(given.values())
    for kind in ("int", "long"):
        df = spark.createDataFrame([(20240102,), (86400,), (20241399,), (None,)], f"t {kind}")
        assert [r.t for r in readers.coerce_time(df, "t").collect()] == [
            datetime(2024, 1, 2), datetime(1970, 1, 2), datetime.fromtimestamp(20241399, timezone.utc).replace(tzinfo=None), None]


def test_no_local_scratch_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=context))


def test_database_options():
    q = "SELECT * FROM visits"
    plain = readers.jdbc_options("postgresql", q, "db", "shop", "u", "p", time="t", lower_bound="2024-01-01", limit=10)
    assert plain["url"] == "jdbc:postgresql://db:5432/shop"
    assert plain["query"] == "SELECT * FROM (SELECT * FROM visits) AS T WHERE T.t >= '2024-01-01' LIMIT 10"
    split = readers.jdbc_options("mysql", q, "db", "shop", "u", "p", port=1, partitions=("id", 0, 100, 4))
    assert split["dbtable"] == "(SELECT * FROM visits) AS source" and "query" not in split
    assert (split["numPartitions"], split["upperBound"]) == ("4", "100") and "mysql://db:1/" in split["url"]
    assert readers.jdbc_options("awsredshift", q, "db", "s", "u", "p")["url"].endswith(":5439/s")
    big = readers.bigquery_options(q, "key.json", time="t", lower_bound="2024-01-01", dataset="tmp")
    assert big["query"].endswith("WHERE T.t >= '2024-01-01'") and big["materializationDataset"] == "tmp"


def test_since_is_pushed_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = readers.since(df, "o_orderdate", datetime(1998, 1, 1))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in \
        plan._jdf.queryExecution().executedPlan().toString()
    assert readers.since(df, "o_orderdate", None) is df


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    df = frame(spark, [("a", i, i) for i in range(20)])
    store.write_results(df, path, "2024-01-01")
    store.write_results(df.where("id < 5"), path, "2024-01-02")
    store.write_results(df.where("id < 7"), path, "2024-01-01")
    back = store.read_results(spark, path, SPEC, last=None)
    assert {str(r[0]): r[1] for r in back.groupBy("run_date").count().collect()} == {"2024-01-01": 7, "2024-01-02": 5}
    assert [r.id for r in store.read_results(spark, path, SPEC, last=3).collect()] == [4, 5, 6]
    store.write_results(df, str(tmp_path / "csv"), "2024-01-01", "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 20


def test_models_and_metadata(spark, tmp_path):
    path = str(tmp_path / "models")
    store.save_models(spark.createDataFrame([("a", 1.0)], "g string, slope double"), path, "prophet")
    store.save_models(spark.createDataFrame([("b", [1.0])], "g string, knots array<double>"), path, "iso_f")
    store.save_models(spark.createDataFrame([("c", 2.0)], "g string, slope double"), path, "prophet")
    assert store.load_models(spark, path).count() == 2
    assert store.load_models(spark, path, "prophet").first().g == "c"
    df = frame(spark, [("a", 0, 1), ("c", 61.5, 1)])
    assert [r.g for r in store.has_model(df, store.load_models(spark, path, "prophet"), ["g"]).collect()] == ["c"]
    store.save_metadata(store.run_metadata(df, "t", ["year", "hour"]), str(tmp_path / "meta"))
    assert store.load_metadata(spark, str(tmp_path / "meta")) == {
        "min_date": "2021-01-01 00:00:00", "max_date": "2021-01-01 00:01:01", "time_groups": "year*hour"}


def test_scratch_follows_the_session(spark, tmp_path):
    settings = {"spark.checkpoint.dir": str(tmp_path) + "/"}
    named = SimpleNamespace(conf=settings, sparkContext=None)
    assert scratch_root(named) == str(tmp_path)
    # Not named in this session: one folder for all of it.
    assert scratch_root(spark) == scratch_root(spark)
    assert materialize(spark.range(5), "five").count() == 5
