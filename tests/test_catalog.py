"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    ours = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    ours, theirs = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=0, atol=1.1e-6)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "event_id" and "predicted_label" in out.columns


def test_every_operator_is_registered():
    """One query at least for each operator of the inventory that can run here."""
    wanted = [f"s{i}" for i in (1, 2, *range(5, 14))]
    for letter, n in (("f", 5), ("n", 4), ("t", 23), ("p", 5), ("l", 11), ("a", 10), ("i", 5), ("b", 6), ("g", 10),
                      ("e", 3), ("r", 7), ("x", 4), ("st", 5)):
        wanted += [f"{letter}{i}" for i in range(1, n + 1)]
    have = {q.split("_")[0] for q in entry.queries()}
    assert set(wanted) <= have
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_do_the_whole_job(spark, sf_dir, monkeypatch):
    """All combinations of the ranges are tried, and the sampled forest has 1000 trees."""
    from tidemark.operators import iforest, tuning

    grids, trees = [], []
    best, sample = tuning.best_params, iforest.iforest_sample
    monkeypatch.setattr(tuning, "best_params", lambda errors, grid, groups: grids.append(grid.count()) or best(errors, grid, groups))
    monkeypatch.setattr(iforest, "iforest_sample", lambda df, spec, n, *a: trees.append(n) or sample(df, spec, n, *a))
    entry.queries()["x3_tune"](spark, sf_dir)
    assert grids == [20]
    entry.queries()["i2_fit_iforest_sampled"](spark, sf_dir)
    assert trees == [1000]
    found = entry.queries()["g7_objective_piecewise"](spark, sf_dir)
    assert {r.combo_id for r in found.select("combo_id").distinct().collect()} == set(range(20))


def test_vote_of_two_detectors_where_times_repeat(spark, tmp_path):
    """Three rows of each time and type, told apart by their number."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i + 1000 * k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * i AS ts, i % 50 AS user_id,
     ['view', 'click'][1 + i % 2] AS event_type, 10 + 5 * sin(i + k)::DOUBLE AS value FROM range(90) r(i), range(3) c(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    name = "x4_detect_moving_average"
    ours, theirs = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    ours, theirs = (d[sorted(ours.columns)].sort_values("event_id").reset_index(drop=True) for d in (ours, theirs))
    assert len(ours) == 270
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=0, atol=1.1e-6)


def test_vote_of_two_detectors_where_rows_repeat_or_have_no_time(spark, tmp_path):
    """Copies under one id, and rows without a time, come back once each; a copy has the labels of its like."""
    duckdb.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i % 20 <> 3 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * i END AS ts, i % 50 AS user_id,
     ['view', 'click'][1 + i % 2] AS event_type, (10 + 5 * sin(i))::DOUBLE AS value FROM range(90) r(i), range(3) c(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    found = entry.queries()["x4_detect_moving_average"](spark, str(tmp_path)).toPandas()
    assert (found.groupby("event_id").size() == 3).all() and len(found) == 270
    assert found["ad_label_3"].groupby(found["event_id"]).nunique().max() == 1
    assert (found["predicted_label"] == found[["ad_label_1", "ad_label_3"]].max(axis=1)).all()
