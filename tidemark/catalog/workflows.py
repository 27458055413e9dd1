"""The whole jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog.base import EVENTS, SQL_NULLS, events_nulls, query, r, sql_t_quantile, sr
from tidemark.catalog.detectors import sql_scores, sql_tree_scores
from tidemark.catalog.tables import SQL_FILLED, SQL_LINE, SQL_SPLIT
from tidemark.functions.kernels import z_quantile
from tidemark.operators.clean import fill_previous
from tidemark.operators.ensemble import join_models, vote_present
from tidemark.operators.forecast import predict_forecast, residuals
from tidemark.operators.iforest import SUBSAMPLES
from tidemark.operators.residual_score import label_two_tail, student_t_score
from tidemark.operators.trend import TrendParams, fit_trend, label_band, trend_band
from tidemark.operators.tuning import RANGES
from tidemark.plans import jobs
from tidemark.session import materialize, scratch_path
from tidemark.sources import store
from tidemark.spec import SeriesSpec

LABELS = ("ad_label_1", "ad_label_2", "ad_label_3", "predicted_label")


def _shown(out):
    return out.select("event_id", r("predict").alias("predict"),
                      *[r(f"anomaly_score_{i}").alias(f"anomaly_score_{i}") for i in (1, 2, 3)], *LABELS)


@query("x1_train")
def x1(spark, sf):
    """Model table of the three detectors, one row per series and detector."""
    path = scratch_path(spark, "run")
    jobs.train(events_nulls(spark, sf), EVENTS, path)
    models = store.load_models(spark, f"{path}/models")
    return models.select("event_type", F.col("model").cast("string").alias("model"), r("intercept").alias("intercept"),
                         r("sigma").alias("sigma"), r("threshold").alias("threshold"))


@query("x2_predict")
def x2(spark, sf):
    path, df = scratch_path(spark, "run"), events_nulls(spark, sf)
    jobs.train(df, EVENTS, path)
    return _shown(jobs.predict(df, EVENTS, path, run_date="2024-02-01"))


@query("x3_tune")
def x3(spark, sf):
    out = jobs.tune(events_nulls(spark, sf), EVENTS, "iso_f", ranges=RANGES["iso_f"])
    return out.select("event_type", "combo_id", r("error").alias("error"), r("contamination").alias("contamination"),
                      "num_of_trees")


@query("x4_detect")
def x4(spark, sf):
    return _shown(jobs.detect(events_nulls(spark, sf), EVENTS))


# The jobs with those settings of which every label can be said in SQL: a straight
# trend, p-values for the residuals, no time parts, and a forest as small as that of the SQL.
LINEAR = jobs.JobSettings(trees=SUBSAMPLES, trend=TrendParams(kind="linear"), score_method="student_t", time_parts=False)

_CUT = f"""{SQL_LINE.format(rows=SQL_FILLED)}, filled AS (SELECT * FROM {SQL_FILLED}),
 past AS (SELECT * FROM filled WHERE ts < {SQL_SPLIT}), {sql_scores(SUBSAMPLES, 'past', 'filled')},
 limits AS (SELECT event_type, quantile_cont(score, 0.01) AS threshold FROM scores SEMI JOIN past USING (event_id) GROUP BY 1)"""

_LABELLED = _CUT + f""",
 predicted AS (SELECT *, CASE WHEN row_number() OVER w >= 2 THEN avg(value) OVER
   (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS predict
  FROM filled WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
 res AS (SELECT event_id, event_type, predict, CASE WHEN value = 0 THEN 1000000.0::DOUBLE ELSE abs(value - predict) END AS res
  FROM predicted WHERE ts >= {SQL_SPLIT} AND predict IS NOT NULL),
 tv AS (SELECT event_id, predict, abs(res - avg(res) OVER w) / sqrt(var_pop(res) OVER w / count(*) OVER w) AS t, count(*) OVER w - 1 AS dof
  FROM res WINDOW w AS (PARTITION BY event_type)),
 one AS (SELECT event_id, predict, (t > {sql_t_quantile(0.975, 'dof')} OR t < {sql_t_quantile(0.525, 'dof')})::INT AS label FROM tv),
 two AS (SELECT event_id, score, (score < threshold)::INT AS label FROM scores JOIN limits USING (event_type)),
 line AS (SELECT event_id, ts, value, intercept + slope * (epoch_us(date_trunc('second', ts)) -
  epoch_us(date_trunc('second', min(ts) OVER (PARTITION BY event_type)))) / 86400e6 AS yhat, {z_quantile(0.975)!r}::DOUBLE * sigma AS half
  FROM filled JOIN m USING (event_type)),
 three AS (SELECT event_id, (value > yhat + half OR value < yhat - half)::INT AS label FROM line WHERE ts >= {SQL_SPLIT})
 SELECT event_id, {sr('predict')} AS predict, {sr('score')} AS anomaly_score_2, coalesce(one.label, 0) AS ad_label_1,
  two.label AS ad_label_2, three.label AS ad_label_3, (coalesce(one.label, 0) + two.label + three.label >= 2)::INT AS predicted_label
 FROM three JOIN two USING (event_id) LEFT JOIN one USING (event_id)"""


def _labels(out):
    return out.select("event_id", r("predict").alias("predict"), r("anomaly_score_2").alias("anomaly_score_2"), *LABELS)


@query("x1_train_linear", _CUT + f""" SELECT event_type, 'lstm' AS model, 0.0::DOUBLE AS intercept, NULL::DOUBLE AS sigma, NULL::DOUBLE AS threshold FROM m
 UNION ALL SELECT event_type, 'iso_f', NULL, NULL, {sr('threshold')} FROM limits
 UNION ALL SELECT event_type, 'prophet', {sr('intercept')}, {sr('sigma')}, NULL FROM m""")
def x1l(spark, sf):
    path = scratch_path(spark, "run")
    jobs.train(events_nulls(spark, sf), EVENTS, path, LINEAR)
    models = store.load_models(spark, f"{path}/models")
    return models.select("event_type", F.col("model").cast("string").alias("model"), r("intercept").alias("intercept"),
                         r("sigma").alias("sigma"), r("threshold").alias("threshold"))


@query("x1_train_tuned", f"""{SQL_LINE.format(rows=SQL_FILLED)}, filled AS (SELECT * FROM {SQL_FILLED}),
 past AS (SELECT * FROM filled WHERE ts < {SQL_SPLIT}), {sql_tree_scores(SUBSAMPLES, 'past', 'filled')},
 params AS (SELECT event_type, count(*) % 5 AS k, count(*) % 2 AS odd FROM events GROUP BY 1),
 mean_height AS (SELECT event_id, event_type, k, avg(height) AS height FROM per_tree JOIN params USING (event_type) WHERE tree < 4 + k GROUP BY ALL),
 scores AS (SELECT event_id, event_type, k, -pow(2.0, -height / c) AS score FROM mean_height JOIN norm USING (event_type)),
 limits AS (SELECT event_type, quantile_cont(score, [0.01, 0.02, 0.03, 0.04, 0.05])[1 + k] AS threshold FROM scores SEMI JOIN past USING (event_id) GROUP BY event_type, k)
 SELECT event_type, 'iso_f' AS model, NULL::DOUBLE AS sigma, {sr('threshold')} AS threshold, NULL::DOUBLE AS interval_width FROM limits
 UNION ALL SELECT event_type, 'prophet', {sr('sigma')}, NULL, CASE WHEN odd = 1 THEN 0.9 ELSE 0.95 END FROM m JOIN params USING (event_type)""")
def x1t(spark, sf):
    """Each series is fitted with parameters of its own: contamination, number of trees and width of the band."""
    path, df = scratch_path(spark, "run"), events_nulls(spark, sf)
    rows = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    forest = rows.select("event_type", F.round((F.col("n") % 5 + 1) * 0.01, 9).alias("contamination"), (F.col("n") % 5 + 4).cast("int").alias("num_of_trees"),
                         F.lit(0.8).alias("split_ratio"))
    band = rows.select("event_type", F.when(F.col("n") % 2 == 1, 0.9).otherwise(0.95).alias("interval_width"), F.lit(0.1).alias("changepoint_range"),
                       F.lit(50).alias("n_changepoints"))
    store.save_models(forest, f"{path}/params", "iso_f")
    store.save_models(band, f"{path}/params", "prophet")
    jobs.train(df, EVENTS, path, LINEAR)
    models = store.load_models(spark, f"{path}/models").where("model <> 'lstm'")
    return models.select("event_type", F.col("model").cast("string").alias("model"), r("sigma").alias("sigma"), r("threshold").alias("threshold"),
                         r("interval_width").alias("interval_width"))


@query("x2_predict_linear", _LABELLED)
def x2l(spark, sf):
    path, df = scratch_path(spark, "run"), events_nulls(spark, sf)
    jobs.train(df, EVENTS, path, LINEAR)
    return _labels(jobs.predict(df, EVENTS, path, LINEAR, run_date="2024-02-01"))


@query("x4_detect_linear", _LABELLED)
def x4l(spark, sf):
    return _labels(jobs.detect(events_nulls(spark, sf), EVENTS, LINEAR))


_SOME_WITHOUT_TYPE = "(SELECT * REPLACE (CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type) FROM " + SQL_NULLS + ")"


def _rows(out):
    """The raw columns of every row, and whether the forest scored it."""
    return out.select("event_id", "user_id", "event_type", r("value").alias("value"),
                      F.col("anomaly_score_2").isNotNull().cast("int").alias("scored"),
                      F.col("predicted_label").isNotNull().cast("int").alias("predicted_label"))


@query("x4_detect_all_rows", f"""WITH e AS (SELECT * FROM {_SOME_WITHOUT_TYPE})
 SELECT event_id, user_id, event_type, {sr('value')} AS value, (event_type IS NOT NULL)::INT AS scored, 1 AS predicted_label
 FROM e WHERE ts >= {SQL_SPLIT.replace('FROM events', 'FROM e WHERE event_type IS NOT NULL')}""")
def x4a(spark, sf):
    """Null features, null groups and further columns: every row from the split date on comes back as it was."""
    some = F.when(F.col("event_id") % 13 != 0, F.col("event_type"))
    return _rows(jobs.detect(events_nulls(spark, sf).withColumn("event_type", some), EVENTS, LINEAR))


@query("x4_detect_repeated_rows", f"""SELECT event_id, user_id, event_type, {sr('value')} AS value, 1 AS scored, 1 AS predicted_label
 FROM (SELECT *, unnest(range(CASE WHEN event_id % 10 = 0 THEN 3 ELSE 1 END)) AS time FROM {SQL_NULLS}) WHERE ts >= {SQL_SPLIT}""")
def x4d(spark, sf):
    """Rows that are there three times come back three times."""
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("event_id") % 10 == 0, 3).otherwise(1)))
    return _rows(jobs.detect(events_nulls(spark, sf).withColumn("_time", times).drop("_time"), EVENTS, LINEAR))


@query("x2_predict_new_rows", f"""SELECT event_id, user_id, event_type, {sr('value')} AS value, 1 AS scored, 1 AS predicted_label
 FROM {SQL_NULLS}""")
def x2n(spark, sf):
    """Rows that all come after the training's: each of them comes back scored."""
    path, df = scratch_path(spark, "run"), events_nulls(spark, sf)
    jobs.train(df, EVENTS, path, LINEAR)
    later = df.withColumn("ts", F.col("ts") + F.expr("interval 1000 days"))
    return _rows(jobs.predict(later, EVENTS, path, LINEAR))


_PREDICTED = """(SELECT *, CASE WHEN row_number() OVER w >= 2 THEN avg(value) OVER
 (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS predict
 FROM {rows} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


@query("x4_detect_moving_average", SQL_LINE.format(rows=SQL_FILLED) + f""",
 res AS (SELECT event_id, event_type, predict, CASE WHEN value = 0 THEN 1000000.0::DOUBLE ELSE abs(value - predict) END AS res
  FROM {_PREDICTED.format(rows=SQL_FILLED)} WHERE predict IS NOT NULL),
 tv AS (SELECT event_id, predict, abs(res - avg(res) OVER w) / sqrt(var_pop(res) OVER w / count(*) OVER w) AS t, count(*) OVER w - 1 AS dof
  FROM res WINDOW w AS (PARTITION BY event_type)),
 l1 AS (SELECT event_id, predict, (t > {sql_t_quantile(0.975, 'dof')} OR t < {sql_t_quantile(0.525, 'dof')})::INT AS label FROM tv),
 band AS (SELECT event_id, value, intercept + slope * (epoch_us(date_trunc('second', ts)) -
  epoch_us(date_trunc('second', min(ts) OVER (PARTITION BY event_type)))) / 86400e6 AS yhat, {z_quantile(0.975)!r}::DOUBLE * sigma AS half
  FROM {SQL_FILLED} JOIN m USING (event_type)),
 l3 AS (SELECT event_id, (value > yhat + half OR value < yhat - half)::INT AS label FROM band)
 SELECT event_id, {sr('predict')} AS predict, coalesce(l1.label, 0) AS ad_label_1, l3.label AS ad_label_3,
  greatest(coalesce(l1.label, 0), l3.label) AS predicted_label FROM l3 LEFT JOIN l1 USING (event_id)""")
def x4m(spark, sf):
    """Two detectors without random draws or saved models, joined and voted. Rows are joined by a number, so none is refused
    where ids repeat or times are missing."""
    rows = materialize(events_nulls(spark, sf).withColumn(jobs.ROW, F.monotonically_increasing_id()), "raw")
    spec = replace(EVENTS, tie=(*EVENTS.tie, jobs.ROW))
    df = materialize(fill_previous(rows, spec), "filled")
    one = predict_forecast(df, None, spec, baseline="moving_average").where("predict is not null")
    one = student_t_score(one.withColumn("residuals", residuals(F.col("value"), F.col("predict"))), spec)
    one = one.withColumn("ad_label_1", label_two_tail(F.col("anomaly_score_1")))
    three = label_band(trend_band(df, fit_trend(df, spec), spec), spec)
    out = vote_present(join_models(df, {1: one, 3: three}, SeriesSpec(jobs.ROW, "value")))
    return out.select("event_id", r("predict").alias("predict"), "ad_label_1", "ad_label_3", "predicted_label")
