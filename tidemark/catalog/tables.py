"""Sources, sinks, filters, null handling, splits, joins and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EVENTS, LINES, ORDERS, SQL_EVENTS, SQL_NULLS, events, events_nulls, lines, orders, query, r, sr, st,
    table, text)
from tidemark.operators import clean, ensemble, filters, reports, splits
from tidemark.operators.trend import fit_linear
from tidemark.session import scratch_path
from tidemark.sources import readers, store

# ---- sources and sinks


@query("s1_read_csv", "SELECT event_id, event_type, value FROM events")
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    events(spark, sf).select("event_id", "event_type", "value").write.option("header", "true").csv(path, sep=";")
    return readers.read_csv(spark, path, types={"event_id": "bigint", "value": "double"})


@query("s2_read_json", "SELECT event_id, event_type, value FROM events")
def s2(spark, sf):
    """Files with one array of up to 5000 records each."""
    path = scratch_path(spark, "json")
    records = (events(spark, sf).groupBy(F.floor(F.col("event_id") / 5000).alias("bucket"))
               .agg(F.to_json(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("value")))
    records.write.partitionBy("bucket").text(path)
    back = readers.read_json(spark, path, "event_id bigint, event_type string, value double")
    return back.drop("bucket")


@query("s5_since", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
def s5(spark, sf):
    date = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return readers.since(events(spark, sf), "ts", date).select("event_id", "value")


@query("s5_since_exclusive", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def s5x(spark, sf):
    date = F.lit("1998-01-01").cast("timestamp")
    return readers.since(orders(spark, sf), "o_orderdate", date, inclusive=False).select("o_orderkey")


@query("s6_preview", "SELECT event_id, event_type, value FROM events ORDER BY ts, event_id LIMIT 10")
def s6(spark, sf):
    return readers.preview(events(spark, sf), EVENTS).select("event_id", "event_type", "value")


def _time_text():
    k = F.col("event_id") % 4
    return (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(k == 1, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
            .when(k == 2, F.date_format("ts", "yyyyMMdd")).otherwise("not a time"))


@query("s7_coerce_time", f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {st('ts')} WHEN 1 THEN {st('ts')}
 WHEN 2 THEN {st("date_trunc('day', ts)")} END AS parsed FROM events""")
def s7(spark, sf):
    raw = events(spark, sf).withColumn("ts", _time_text())
    return readers.coerce_time(raw, "ts").select("event_id", text("ts").alias("parsed"))


@query("s7_bad_times", "SELECT count(*) AS given, count(*) FILTER (WHERE event_id % 4 = 3) AS unread FROM events")
def s7bad(spark, sf):
    return readers.bad_times(events(spark, sf).withColumn("ts", _time_text()), "ts")


@query("s8_coerce_feature", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value
 WHEN 5 THEN 1000.0 END AS value FROM events""")
def s8(spark, sf):
    k, v = F.col("event_id") % 6, F.col("value").cast("string")
    raw = (F.when(k == 0, v).when(k == 1, F.concat(F.lit("  "), v, F.lit(" "))).when(k == 2, "abc")
           .when(k == 3, "nan").when(k == 4, F.concat(v, F.lit("d"))).otherwise("1_000"))
    return readers.coerce_feature(events(spark, sf).withColumn("value", raw), "value").select("event_id", "value")


@query("s9_write_results", f"""SELECT run_date, count(*) AS n, {sr('sum(value)', 3)} AS total FROM (
 SELECT '2024-02-01' AS run_date, value FROM events WHERE event_type = 'click'
 UNION ALL SELECT '2024-02-02', value FROM events WHERE event_type IN ('view', 'error')) GROUP BY 1""")
def s9(spark, sf):
    """Three writes on two dates: the second write of a date replaces the first."""
    path, df = scratch_path(spark, "results"), events(spark, sf).select("event_id", "ts", "event_type", "value")
    store.write_results(df, path, "2024-02-01")
    store.write_results(df.where("event_type in ('view', 'error')"), path, "2024-02-02")
    store.write_results(df.where("event_type = 'click'"), path, "2024-02-01")
    back = store.read_results(spark, path, EVENTS, last=None)
    return back.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total"))


@query("s10_read_results", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def s10(spark, sf):
    path, df = scratch_path(spark, "results"), events(spark, sf)
    for k in range(3):
        store.write_results(df.where(F.col("event_id") % 3 == k), path, f"2024-02-0{k + 1}")
    return store.read_results(spark, path, EVENTS).select("event_id", "value")


SQL_LINE = """WITH e AS (SELECT event_type, value AS y, (epoch_us(date_trunc('second', ts)) -
  epoch_us(date_trunc('second', min(ts) OVER (PARTITION BY event_type)))) / 86400e6 AS t FROM {rows} WHERE value IS NOT NULL),
 m AS (SELECT event_type, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
  sqrt((regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t)) / count(*)) AS sigma FROM e GROUP BY 1)"""


@query("s11_models", SQL_LINE.format(rows=SQL_EVENTS) + f"""
 SELECT event_type, {sr('slope')} AS slope, {sr('intercept')} AS intercept, {sr('sigma')} AS sigma FROM m""")
def s11(spark, sf):
    path, models = scratch_path(spark, "models"), fit_linear(events(spark, sf), EVENTS)
    store.save_models(models, path, "prophet")
    store.save_models(models.select("event_type"), path, "iso_f")
    back = store.load_models(spark, path, "prophet")
    return back.select("event_type", r("slope").alias("slope"), r("intercept").alias("intercept"), r("sigma").alias("sigma"))


@query("s12_has_model", """SELECT event_id FROM events WHERE event_type IN
 (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > (SELECT avg(value) FROM events))""")
def s12(spark, sf):
    df = events(spark, sf)
    mean = df.agg(F.avg("value")).first()[0]
    models = df.groupBy("event_type").agg(F.avg("value").alias("m")).where(F.col("m") > mean)
    return store.has_model(df, models, ["event_type"]).select("event_id")


@query("s13_run_metadata", f"""SELECT {st('min(ts)')} AS min_date, {st('max(ts)')} AS max_date,
 'week_day*hour' AS time_groups FROM events""")
def s13(spark, sf):
    return store.run_metadata(events(spark, sf), "ts", ["week_day", "hour"])


# ---- filters


@query("f1_filter_levels", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def f1(spark, sf):
    return filters.filter_levels(lines(spark, sf), {"l_returnflag": "R", "l_linestatus": "ALL"}).select(
        "l_orderkey", "l_linenumber")


@query("f2_filter_expr", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value > 50")
def f2(spark, sf):
    return filters.filter_expr(events(spark, sf), "event_type in ('click', 'view') and value > 50").select("event_id")


@query("f3_series_levels", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def f3(spark, sf):
    return filters.series_levels(lines(spark, sf), LINES.groups)


@query("f3_series_levels_dense", """SELECT a.event_type, b.user_id FROM (SELECT DISTINCT event_type FROM events) a,
 (SELECT DISTINCT user_id FROM events) b""")
def f3d(spark, sf):
    return filters.series_levels(events(spark, sf), ["event_type", "user_id"], dense=True)


@query("f4_time_range", """SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def f4(spark, sf):
    low, high = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-20"))
    return filters.time_range(events(spark, sf), "ts", low, high).select("event_id")


@query("f5_non_null", f"SELECT event_id, value FROM {SQL_NULLS} WHERE value IS NOT NULL")
def f5(spark, sf):
    return filters.non_null(events_nulls(spark, sf), "value").select("event_id", "value")


# ---- null handling and uniqueness


@query("n1_drop_sparse_series", """SELECT event_id FROM (SELECT *, avg((v IS NULL)::INT) OVER (PARTITION BY event_type) AS share FROM
 (SELECT *, CASE WHEN event_type IN ('error', 'view') AND event_id % 3 <> 0 THEN NULL ELSE value END AS v FROM events)) WHERE share < 0.5""")
def n1(spark, sf):
    gone = F.col("event_type").isin("error", "view") & (F.col("event_id") % 3 != 0)
    df = events(spark, sf).withColumn("value", F.when(~gone, F.col("value")))
    return clean.drop_sparse_series(df, EVENTS).select("event_id")


SQL_FILLED = f"""(SELECT event_id, ts, event_type, coalesce(value,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  avg(value) OVER (PARTITION BY event_type)) AS value FROM {SQL_NULLS})"""


@query("n2_fill_previous", f"SELECT event_id, event_type, {sr('value')} AS value FROM {SQL_FILLED}")
def n2(spark, sf):
    return clean.fill_previous(events_nulls(spark, sf), EVENTS).select("event_id", "event_type", r("value").alias("value"))


@query("n3_uniqueness_report", """SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_orderdate) AS distinct_times
 FROM orders GROUP BY 1""")
def n3(spark, sf):
    return clean.uniqueness_report(orders(spark, sf), ORDERS)


@query("n4_collapse_duplicates", f"""SELECT o_orderstatus, {st('o_orderdate')} AS day, {sr('avg(o_totalprice)')} AS o_totalprice
 FROM orders GROUP BY 1, 2""")
def n4(spark, sf):
    return clean.collapse_duplicates(orders(spark, sf), ORDERS).select(
        "o_orderstatus", text("o_orderdate").alias("day"), r("o_totalprice").alias("o_totalprice"))


# ---- splits

SQL_SPLIT = """(SELECT min(ts) + to_microseconds((floor(((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)::DOUBLE * 0.8::DOUBLE)
 * 1000000)::BIGINT) FROM events)"""


@query("p1_ratio_split_date", f"SELECT {st(SQL_SPLIT)} AS split_date")
def p1(spark, sf):
    ends = events(spark, sf).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    return ends.select(text(splits.ratio_split_date(F.col("low"), F.col("high"), 0.8)).alias("split_date"))


_PERIODS = {"Daily": 86400, "Weekly": 7 * 86400, "Every 2 Weeks": 14 * 86400, "Monthly": 30 * 86400,
            "Hourly": 3600, "Every Min": 60, "Every Second": 1, "min": 60}


def _sql_periods():
    parts = [f"SELECT '{p}' AS period, {st(f'm - to_seconds({s})')} AS split_date FROM x" for p, s in _PERIODS.items()]
    for i, day in enumerate(splits.WEEKDAYS):
        back = f"(isodow(m) - 1 - {i})"
        parts.append(f"SELECT '{day}', {st(f'm - to_days(((({back} % 7) + 7) % 7)::INT)')} FROM x")
        parts.append(f"SELECT '{day} compat', {st(f'm - to_days({back}::INT)')} FROM x")
    return "WITH x AS (SELECT max(ts) AS m FROM events) " + " UNION ALL ".join(parts)


@query("p2_period_split_date", _sql_periods())
def p2(spark, sf):
    top = events(spark, sf).agg(F.max("ts").alias("m"))
    cells = {p: splits.period_split_date(F.col("m"), p) for p in (*_PERIODS, *splits.WEEKDAYS)}
    cells |= {f"{d} compat": splits.period_split_date(F.col("m"), d, compat=True) for d in splits.WEEKDAYS}
    wide = top.select(*[text(c).alias(p) for p, c in cells.items()])
    return wide.unpivot([], list(cells), "period", "split_date")


@query("p3_split", f"""SELECT event_id, CASE WHEN ts < {SQL_SPLIT} THEN 'train' ELSE 'predict' END AS side FROM events""")
def p3(spark, sf):
    df = events(spark, sf)
    past, new = splits.split(df, "ts", splits.split_date(df, "ts"))
    return (past.select("event_id", F.lit("train").alias("side"))
            .unionByName(new.select("event_id", F.lit("predict").alias("side"))))


@query("p4_query_date", f"""SELECT 'train' AS job, count(*) AS n FROM events UNION ALL
 SELECT 'prediction', count(*) FROM events WHERE ts >= {SQL_SPLIT} UNION ALL SELECT 'parameter_tuning', count(*) FROM events""")
def p4(spark, sf):
    df = events(spark, sf)
    date = splits.split_date(df, "ts")
    reads = [readers.since(df, "ts", splits.query_date(job, date)).select(F.lit(job).alias("job"))
             for job in ("train", "prediction", "parameter_tuning")]
    return ensemble.concat_series(reads).groupBy("job").agg(F.count(F.lit(1)).alias("n"))


@query("p5_with_lookback", f"""SELECT event_id, (ts < {SQL_SPLIT})::INT AS warmup FROM events
 QUALIFY ts >= {SQL_SPLIT} OR row_number() OVER (PARTITION BY event_type, ts < {SQL_SPLIT} ORDER BY ts DESC, event_id DESC) <= 5""")
def p5(spark, sf):
    df = events(spark, sf)
    return splits.with_lookback(df, EVENTS, splits.split_date(df, "ts"), 5).select("event_id", "warmup")


# ---- joins, vote, union


def _labelled(df, i, keep):
    return df.where(keep).select(
        "event_type", "ts", "event_id", (F.col("event_id") % (i + 2) == 0).cast("int").alias(f"ad_label_{i}"),
        (F.col("value") / i).alias(f"anomaly_score_{i}"), *([F.col("value").alias("predict")] if i == 1 else []))


@query("e1_join_models", f"""SELECT event_id, {sr('predict')} AS predict, coalesce(ad_label_1, 0) AS ad_label_1,
 {sr('coalesce(anomaly_score_1, 0)')} AS anomaly_score_1, coalesce(ad_label_2, 0) AS ad_label_2,
 {sr('coalesce(anomaly_score_2, 0)')} AS anomaly_score_2, coalesce(ad_label_3, 0) AS ad_label_3,
 {sr('coalesce(anomaly_score_3, 0)')} AS anomaly_score_3 FROM events
 LEFT JOIN (SELECT event_type, ts, (event_id % 3 = 0)::INT AS ad_label_1, value / 1 AS anomaly_score_1, value AS predict
  FROM events WHERE event_id % 2 = 0) m1 USING (event_type, ts)
 LEFT JOIN (SELECT event_type, ts, (event_id % 4 = 0)::INT AS ad_label_2, value / 2 AS anomaly_score_2
  FROM events WHERE event_id % 3 = 0) m2 USING (event_type, ts)
 LEFT JOIN (SELECT event_type, ts, (event_id % 5 = 0)::INT AS ad_label_3, value / 3 AS anomaly_score_3
  FROM events WHERE event_id % 5 <> 0) m3 USING (event_type, ts)""")
def e1(spark, sf):
    df, k = events(spark, sf), F.col("event_id")
    models = {1: _labelled(df, 1, k % 2 == 0), 2: _labelled(df, 2, k % 3 == 0), 3: _labelled(df, 3, k % 5 != 0)}
    out = ensemble.join_models(df, models, EVENTS)
    scores = [r(f"anomaly_score_{i}").alias(f"anomaly_score_{i}") for i in (1, 2, 3)]
    return out.select("event_id", r("predict").alias("predict"), *scores, "ad_label_1", "ad_label_2", "ad_label_3")


@query("e2_vote", """SELECT event_id, 2 AS vote_0, event_id % 2 AS vote_1, greatest(event_id % 2, event_id // 2 % 2) AS vote_2,
 CASE WHEN event_id % 2 + event_id // 2 % 2 + event_id // 4 % 2 >= 2 THEN 1 ELSE 0 END AS vote_3 FROM events""")
def e2(spark, sf):
    bits = [F.floor(F.col("event_id") / 2 ** i) % 2 for i in range(3)]
    df = events(spark, sf)
    return df.select("event_id", *[ensemble.vote(bits[:n]).alias(f"vote_{n}") for n in range(4)])


@query("e3_concat_series", """SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS value, event_type FROM events
 WHERE event_type IN ('click', 'view')""")
def e3(spark, sf):
    df = events(spark, sf)
    return ensemble.concat_series([df.where("event_type = 'click'").select("event_id", "event_type", "value"),
                                   df.where("event_type = 'view'").select("event_id", "event_type")])


# ---- reports


@query("r1_sort_by_time", f"SELECT event_id, {st('ts')} AS at, value FROM events ORDER BY ts, event_id")
def r1(spark, sf):
    return reports.sort_by_time(events(spark, sf), EVENTS).select("event_id", text("ts").alias("at"), "value")


@query("r2_timeline", f"""SELECT {st('l_shipdate')} AS day, {sr('avg(l_extendedprice)')} AS l_extendedprice FROM lineitem
 WHERE l_returnflag = 'N' AND l_linestatus = 'O' GROUP BY 1""")
def r2(spark, sf):
    out = reports.timeline(lines(spark, sf), LINES, {"l_returnflag": "N", "l_linestatus": "O"})
    return out.select(text("l_shipdate").alias("day"), r("l_extendedprice").alias("l_extendedprice"))


@query("r3_descriptives", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {sr(f'{f}(value)')} AS value FROM {SQL_NULLS}"
    for m, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("median", "median"))))
def r3(spark, sf):
    return reports.descriptives(events_nulls(spark, sf), "value").select("metric", r("value").alias("value"))


@query("r4_filter_options", " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c}::VARCHAR AS option FROM (SELECT DISTINCT {c} FROM lineitem) UNION ALL SELECT '{c}', 'ALL'"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def r4(spark, sf):
    return reports.filter_options(table(spark, sf, "lineitem"),
                                  ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])


@query("r5_anomaly_timeline", """SELECT event_id, value AS predict, (event_id % 5 = 0)::INT AS predicted_label FROM
 (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) WHERE event_type = 'click'""")
def r5(spark, sf):
    results = events(spark, sf).withColumns({
        "predict": F.col("value"), "predicted_label": (F.col("event_id") % 5 == 0).cast("int")})
    shown = reports.anomaly_timeline(results, EVENTS, {"event_type": "click"})
    return shown.select("event_id", "predict", "predicted_label")


@query("r6_anomaly_rate", f"""SELECT event_type, {sr('avg((event_id % 3 = 0)::INT)')} AS ad_label_1,
 {sr('avg((event_id % 4 = 0)::INT)')} AS ad_label_2 FROM events GROUP BY 1""")
def r6(spark, sf):
    results = events(spark, sf).withColumns({
        f"ad_label_{i}": (F.col("event_id") % (i + 2) == 0).cast("int") for i in (1, 2)})
    out = reports.anomaly_rate(results, "event_type")
    return out.select("event_type", r("ad_label_1").alias("ad_label_1"), r("ad_label_2").alias("ad_label_2"))


@query("r7_coverage", f"""WITH s AS (SELECT DISTINCT user_id FROM events),
 m AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'click' THEN 'iso_f' ELSE 'prophet' END AS model FROM events
  WHERE event_type IN ('click', 'view')),
 c AS (SELECT model, count(*) AS done, (SELECT count(*) FROM s) AS series FROM m GROUP BY 1)
 SELECT model, done, series, {sr('done / series')} AS share FROM c UNION ALL
 SELECT 'all', sum(done)::BIGINT, sum(series)::BIGINT, {sr('avg(done / series)')} FROM c""")
def r7(spark, sf):
    df = events(spark, sf)
    models = df.where("event_type in ('click', 'view')").withColumn(
        "model", F.when(F.col("event_type") == "click", "iso_f").otherwise("prophet"))
    out = reports.coverage(df, models, ["user_id"])
    return out.select("model", "done", "series", r("share").alias("share"))
