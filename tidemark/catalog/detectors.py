"""Isolation forest and trend band."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EVENTS, SQL_EVENTS, SQL_ZEROS, events, events_zeros, query, r, sql_draw, sql_hash, sr, st, text)
from tidemark.catalog.tables import SQL_LINE
from tidemark.functions.kernels import z_quantile
from tidemark.operators import iforest, trend

TREES = 2
SEED = 42

_C = """(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649::DOUBLE) - 2 * ({n} - 1) / {n}::DOUBLE END)"""


def sql_heights(trees: int, rows: str = "events") -> str:
    """CTEs ``sample`` and ``heights``: the closed form at each sampled value."""
    return f"""h AS (SELECT event_type, event_id, value, {sql_hash('event_id', SEED)}, unnest(range({trees})) AS tree FROM {rows}),
 sample AS (SELECT event_type, tree, value FROM h
  QUALIFY row_number() OVER (PARTITION BY event_type, tree ORDER BY {sql_draw('tree')}, event_id) <= 256),
 d AS (SELECT event_type, tree, value AS x, count(*) AS c FROM sample GROUP BY ALL),
 v AS (SELECT *, lead(x) OVER (PARTITION BY event_type, tree ORDER BY x) AS nx FROM d),
 heights AS (SELECT i.event_type, i.tree, i.x, coalesce(sum(CASE WHEN g.x >= i.x THEN (g.nx - g.x) / (g.nx - i.x)
   ELSE (g.nx - g.x) / (i.x - g.x) END), 0) + any_value({_C.format(n='i.c')}) AS height
  FROM v i LEFT JOIN v g ON i.event_type = g.event_type AND i.tree = g.tree AND g.nx IS NOT NULL GROUP BY ALL)"""


def sql_tree_scores(trees: int, rows: str = "events", scored: str | None = None) -> str:
    """Also ``norm`` and ``per_tree``: the height of each row of ``scored`` by each tree."""
    return f"""{sql_heights(trees, rows)},
 norm AS (SELECT event_type, {_C.format(n='count(*)')} AS c FROM sample WHERE tree = 0 GROUP BY 1),
 q AS (SELECT event_id, event_type, value, unnest(range({trees})) AS tree FROM {scored or rows}),
 below AS (SELECT q.*, h.x AS lx, h.height AS lh FROM q ASOF LEFT JOIN heights h
  ON q.event_type = h.event_type AND q.tree = h.tree AND q.value >= h.x),
 around AS (SELECT below.*, h.x AS hx, h.height AS hh FROM below ASOF LEFT JOIN heights h
  ON below.event_type = h.event_type AND below.tree = h.tree AND below.value <= h.x),
 per_tree AS (SELECT event_id, event_type, tree, CASE WHEN lx IS NULL THEN hh WHEN hx IS NULL OR lx = hx THEN lh
   ELSE lh + (hh - lh) * (value - lx) / (hx - lx) END AS height FROM around)"""


def sql_scores(trees: int, rows: str = "events", scored: str | None = None) -> str:
    """Also ``scores``: each row's score by the forest."""
    return f"""{sql_tree_scores(trees, rows, scored)},
 mean_height AS (SELECT event_id, event_type, avg(height) AS height FROM per_tree GROUP BY 1, 2),
 scores AS (SELECT event_id, event_type, -pow(2.0, -height / c) AS score FROM mean_height JOIN norm USING (event_type))"""


_HEIGHTS, _SCORES = sql_heights(TREES), sql_scores(TREES)


@query("i1_iforest_sample", f"WITH {_HEIGHTS} SELECT event_type, tree::INT AS tree, value FROM sample")
def i1(spark, sf):
    return iforest.iforest_sample(events(spark, sf), EVENTS, TREES, seed=SEED)


@query("i2_tree_heights", f"WITH {_HEIGHTS} SELECT event_type, tree::INT AS tree, x AS value, {sr('height')} AS height FROM heights")
def i2(spark, sf):
    sample = iforest.iforest_sample(events(spark, sf), EVENTS, TREES, seed=SEED)
    return iforest.tree_heights(sample, EVENTS).withColumn("height", r("height"))


def _scored(spark, sf):
    df = events(spark, sf).select("event_id", "ts", "event_type", "value")
    sample = iforest.iforest_sample(df, EVENTS, TREES, seed=SEED)
    return iforest.score_iforest(df, iforest.fit_curves(sample, EVENTS), EVENTS)


@query("i2_fit_iforest_sampled")
def i2s(spark, sf):
    """Real random trees, 1000 per series."""
    models = iforest.fit_iforest(events(spark, sf), EVENTS, 0.01, mode="sampled")
    return models.select("event_type", F.size("knots").alias("cuts"), r("path_norm").alias("path_norm"),
                         r("threshold").alias("threshold"))


@query("i3_score_iforest", f"WITH {_SCORES} SELECT event_id, {sr('score')} AS score FROM scores")
def i3(spark, sf):
    return _scored(spark, sf).select("event_id", r("anomaly_score_2").alias("score"))


@query("i4_contamination_threshold", f"WITH {_SCORES} SELECT event_type, {sr('quantile_cont(score, 0.01)')} AS threshold FROM scores GROUP BY 1")
def i4(spark, sf):
    return iforest.contamination_threshold(_scored(spark, sf), EVENTS, 0.01).withColumn("threshold", r("threshold"))


@query("i5_label_iforest", f"""WITH {_SCORES}, l AS (SELECT event_type, quantile_cont(score, 0.05) AS threshold FROM scores GROUP BY 1)
 SELECT event_id, {sr('score')} AS score, (score < threshold)::INT AS ad_label_2 FROM scores JOIN l USING (event_type)""")
def i5(spark, sf):
    df = events(spark, sf).select("event_id", "ts", "event_type", "value")
    models = iforest.fit_iforest(df, EVENTS, 0.05, TREES, seed=SEED)
    out = iforest.predict_iforest(df, models, EVENTS)
    return out.select("event_id", r("anomaly_score_2").alias("score"), "ad_label_2")


# ---- trend


@query("b1_to_ds_y", f"SELECT event_id, {st('ts')} AS ds, value AS y FROM events")
def b1(spark, sf):
    return trend.to_ds_y(events(spark, sf), EVENTS).select("event_id", text("ds").alias("ds"), "y")


_GRID = f"""p AS (SELECT event_type, date_trunc('second', ts) AS ds, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos,
  count(*) OVER (PARTITION BY event_type) AS n FROM {SQL_EVENTS}),
 c AS (SELECT DISTINCT event_type, floor(n * 0.1::DOUBLE)::BIGINT AS early, CASE WHEN floor(n * 0.1::DOUBLE) <= 50
  THEN floor(n * 0.1::DOUBLE)::BIGINT - 1 ELSE 50 END AS k FROM p),
 j AS (SELECT event_type, early, k, unnest(range(1, k + 1)) AS knot FROM c),
 grid AS (SELECT j.event_type, knot, ds FROM j JOIN p ON p.event_type = j.event_type
  AND p.pos = round_even((knot * ((early - 1) / k::DOUBLE)), 0)::BIGINT + 1)"""


@query("b2_changepoint_grid", f"WITH {_GRID} SELECT event_type, knot::INT AS knot, {st('ds')} AS ds FROM grid")
def b2(spark, sf):
    return trend.changepoint_grid(events(spark, sf), EVENTS).withColumn("ds", text("ds"))


@query("b3_fit_linear", SQL_LINE.format(rows=SQL_EVENTS) + f""" SELECT event_type, {sr('slope')} AS slope,
 {sr('intercept')} AS intercept, {sr('sigma')} AS sigma FROM m""")
def b3(spark, sf):
    out = trend.fit_linear(events(spark, sf), EVENTS)
    return out.select("event_type", *[r(c).alias(c) for c in ("slope", "intercept", "sigma")])


@query("b3_segment_sums", f"""WITH {_GRID}, s0 AS (SELECT event_type, date_trunc('second', min(ts)) AS start FROM events GROUP BY 1),
 e AS (SELECT event_type, value AS y, date_trunc('second', ts) AS ds, (epoch_us(date_trunc('second', ts)) - epoch_us(start)) / 86400e6 AS t
  FROM events JOIN s0 USING (event_type)),
 g AS (SELECT DISTINCT event_type, ds FROM grid), a AS (SELECT event_type, list(ds) AS knots FROM g GROUP BY 1),
 x AS (SELECT e.*, len(list_filter(knots, lambda k: k <= ds)) AS segment FROM e JOIN a USING (event_type))
 SELECT event_type, segment::INT AS segment, count(*) AS rows, {sr('sum(t)')} AS sum_t, {sr('sum(t * t)', 3)} AS sum_tt,
  {sr('sum(y)', 3)} AS sum_y, {sr('sum(t * y)', 3)} AS sum_ty, {sr('sum(y * y)', 3)} AS sum_yy FROM x GROUP BY 1, 2""")
def b3s(spark, sf):
    df = events(spark, sf)
    models = trend.fit_piecewise(df, EVENTS).select("event_type", "start", "knot_days")
    out = trend.segment_sums(df, models, EVENTS)
    return out.select("event_type", "segment", "rows", r("sum_t").alias("sum_t"),
                      *[r(c, 3).alias(c) for c in ("sum_tt", "sum_y", "sum_ty", "sum_yy")])


@query("b3_fit_piecewise")
def b3p(spark, sf):
    out = trend.fit_piecewise(events(spark, sf), EVENTS)
    return out.select("event_type", F.size("knot_days").alias("knots"), r(F.col("slopes")[0]).alias("slope"),
                      r("intercept").alias("intercept"), r("sigma").alias("sigma"))


def sql_band(rows: str) -> str:
    z = z_quantile(0.975)
    return SQL_LINE.format(rows=rows) + f""", b AS (SELECT event_id, value, yhat, yhat - {z!r}::DOUBLE * sigma AS lower,
  yhat + {z!r}::DOUBLE * sigma AS upper FROM (SELECT event_id, value, sigma, intercept + slope * (epoch_us(date_trunc('second', ts)) -
  epoch_us(date_trunc('second', min(ts) OVER (PARTITION BY event_type)))) / 86400e6 AS yhat FROM {rows} JOIN m USING (event_type)))"""


def _banded(df):
    return trend.trend_band(df, trend.fit_trend(df, EVENTS), EVENTS)


@query("b4_trend_band", sql_band(SQL_EVENTS) + f""" SELECT event_id, {sr('yhat')} AS yhat, {sr('lower')} AS yhat_lower,
 {sr('upper')} AS yhat_upper FROM b""")
def b4(spark, sf):
    return _banded(events(spark, sf)).select("event_id", *[r(c).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


@query("b5_label_band", sql_band(SQL_ZEROS) + f""" SELECT event_id, (value > upper OR value < lower)::INT AS ad_label_3,
 {sr('''CASE WHEN value > upper THEN abs((value - upper) / nullif(value, 0)) WHEN value < lower THEN abs((value - lower) / nullif(value, 0))
  ELSE 0 END''')} AS anomaly_score_3 FROM b""")
def b5(spark, sf):
    out = trend.label_band(_banded(events_zeros(spark, sf)), EVENTS)
    return out.select("event_id", "ad_label_3", r("anomaly_score_3").alias("anomaly_score_3"))


@query("b6_mape", sql_band(SQL_ZEROS) + f""" SELECT event_type, {sr('avg(abs((e.value - yhat) / nullif(e.value, 0))) * 100')} AS mape
 FROM b JOIN (SELECT event_id, event_type, value FROM {SQL_ZEROS}) e USING (event_id) GROUP BY 1""")
def b6(spark, sf):
    out = _banded(events_zeros(spark, sf))
    return out.groupBy("event_type").agg(r(trend.mape(F.col("value"), F.col("yhat"))).alias("mape"))
