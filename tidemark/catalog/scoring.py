"""Forecaster features, fits and residual scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EVENTS, SQL_EVENTS, SQL_NULLS, SQL_ZEROS, USERS, events, events_nulls, events_zeros, query, r,
    sql_beta_quantile, sql_draw, sql_hash, sql_t_confidence, sql_t_quantile, sr)
from tidemark.operators import forecast as fc
from tidemark.operators import residual_score as rs

P = fc.ForecastParams()
_OVER = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"


@query("l1_is_normalized", """SELECT 'raw' AS source, (min(value) >= 0 AND min(value) < 1 AND max(value) > 0 AND max(value) <= 1)::INT
 AS normalized FROM events UNION ALL SELECT 'scaled', 1""")
def l1(spark, sf):
    df = events(spark, sf)
    scaled = fc.minmax_scale(df, EVENTS)
    both = fc.is_normalized(df, "value").withColumn("source", F.lit("raw")).unionByName(
        fc.is_normalized(scaled, "value_norm").withColumn("source", F.lit("scaled")))
    return both.select("source", F.col("normalized").cast("int").alias("normalized"))


@query("l2_minmax_scale", f"""SELECT event_id, {sr('''(value - min(value) OVER (PARTITION BY event_type)) /
 (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type))''', 9)} AS scaled,
 {sr('value', 9)} AS back FROM events""")
def l2(spark, sf):
    df = events(spark, sf)
    out = fc.scale(df, fc.scale_bounds(df, EVENTS), EVENTS, "scaled")
    return out.select("event_id", r("scaled", 9).alias("scaled"), r(fc.unscaled(F.col("scaled")), 9).alias("back"))


def _sql_average(n: int) -> str:
    frame = f"(PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN row_number() {_OVER} >= {n} THEN avg(value) OVER {frame} END)"


@query("l3_moving_average", f"SELECT event_id, {sr(_sql_average(3))} AS moving_average FROM {SQL_EVENTS}")
def l3(spark, sf):
    return fc.moving_average(events(spark, sf), EVENTS, 3).select("event_id", r("moving_average").alias("moving_average"))


@query("l4_lag_matrix", f"SELECT event_id, value AS x0, lag(value, 2) {_OVER} AS x1, lag(value, 4) {_OVER} AS x2 FROM events")
def l4(spark, sf):
    out = fc.lag_matrix(events(spark, sf), EVENTS, fc.ForecastParams(lag=3, lahead=6))
    return out.select("event_id", *[F.col("lags")[i].alias(f"x{i}") for i in range(3)])


_PLACED = f"""(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos,
 count(*) OVER (PARTITION BY event_type) AS n FROM {SQL_EVENTS})"""
_P4 = fc.ForecastParams(tsteps=4, lahead=3, batch_size=16)


@query("l5_trim_warmup", f"""SELECT event_id, pos, 0 AS is_prediction FROM {_PLACED} WHERE pos > 3 AND pos <= n - (n - 3) % 16
 UNION ALL SELECT event_id, pos, 1 FROM {_PLACED} WHERE pos > 3""")
def l5(spark, sf):
    df = events(spark, sf)
    kept = [fc.trim_warmup(df, EVENTS, _P4, bool(f)).select("event_id", F.col("pos").cast("bigint").alias("pos"),
                                                             F.lit(f).alias("is_prediction")) for f in (0, 1)]
    return kept[0].unionByName(kept[1])


_SQL_PLAN = """greatest(n // 16, 1) AS batches, CASE WHEN n < 16 THEN n // 2 ELSE 16 END AS batch_size,
 (CASE WHEN n // 16 <= 10 THEN 1 WHEN n // 16 <= 20 THEN 2 WHEN n // 16 <= 30 THEN 3
  ELSE n // 16 - floor((n // 16) * 0.8::DOUBLE) END * CASE WHEN n < 16 THEN n // 2 ELSE 16 END)::BIGINT AS holdout_rows"""


@query("l6_batch_plan", f"""SELECT level, batches, batch_size::BIGINT AS batch_size, holdout_rows FROM (SELECT *, {_SQL_PLAN} FROM (
 SELECT user_id::VARCHAR AS level, count(*) AS n FROM events GROUP BY 1 UNION ALL
 SELECT event_type, count(*) FROM events GROUP BY 1 UNION ALL
 SELECT 'day ' || day(ts), count(*) FROM events GROUP BY 1))""")
def l6(spark, sf):
    df = events(spark, sf)
    levels = [F.col("user_id").cast("string"), F.col("event_type"), F.concat(F.lit("day "), F.dayofmonth("ts"))]
    out = None
    for level in levels:
        part = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.withColumns(fc.batch_plan(F.col("n"), P)).drop("n")


@query("l7_holdout_split", f"""WITH k AS (SELECT * FROM {_PLACED} WHERE pos > 1 AND pos <= n - (n - 1) % 16),
 b AS (SELECT event_id, pos, n - (n - 1) % 16 AS last, n - 1 AS n FROM k)
 SELECT event_id, (last - pos < holdout_rows)::INT AS is_holdout FROM (SELECT *, {_SQL_PLAN} FROM b)""")
def l7(spark, sf):
    return fc.holdout_split(events(spark, sf), EVENTS, P).select("event_id", "is_holdout")


@query("l8_min_rows_gate", "SELECT event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 8")
def l8(spark, sf):
    return fc.min_rows_gate(events(spark, sf), USERS, 4).select("event_id")


_FRAME = f"""WITH s AS (SELECT event_id, ts, event_type, (value - min(value) OVER (PARTITION BY event_type)) /
  (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type)) AS value FROM events),
 f AS (SELECT event_type, value AS x0, lag(value) {_OVER} AS x1, {_sql_average(2)} AS y FROM s)"""


@query("l9_normal_sums", _FRAME + f""" SELECT event_type, count(*) AS rows, {sr('sum(y)')} AS sum_y, {sr('sum(x0)')} AS sum_0,
 {sr('sum(x1)')} AS sum_1, {sr('sum(x0 * y)')} AS sum_0_y, {sr('sum(x1 * y)')} AS sum_1_y, {sr('sum(x0 * x0)')} AS sum_0_0,
 {sr('sum(x0 * x1)')} AS sum_0_1, {sr('sum(x1 * x1)')} AS sum_1_1 FROM f WHERE x1 IS NOT NULL GROUP BY 1""")
def l9s(spark, sf):
    df = events(spark, sf)
    frame = fc.lag_frame(fc.minmax_scale(df, EVENTS, "_s"), EVENTS, "_s", P)
    out = fc.normal_sums(frame, EVENTS.groups, 2)
    return out.select("event_type", "rows", *[r(c).alias(c) for c in out.columns if c.startswith("sum")])


@query("l9_fit_forecaster", "SELECT DISTINCT event_type, 0.0::DOUBLE AS intercept, 0.5::DOUBLE AS c0, 0.5::DOUBLE AS c1 FROM events")
def l9(spark, sf):
    """At the defaults the target is the mean of the two features."""
    out = fc.fit_forecaster(events(spark, sf), EVENTS, P)
    return out.select("event_type", r("intercept").alias("intercept"),
                      *[r(F.col("coefficients")[i]).alias(f"c{i}") for i in range(2)])


_P1 = fc.ForecastParams(lag=1, lahead=1, horizon=1)
_AHEAD = f"""WITH s AS (SELECT event_id, ts, event_type, value, min(value) OVER (PARTITION BY event_type) AS lo,
  max(value) OVER (PARTITION BY event_type) AS hi FROM events),
 f AS (SELECT *, (value - lo) / (hi - lo) AS y, (lag(value) {_OVER} - lo) / (hi - lo) AS x FROM s),
 m AS (SELECT event_type, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM f WHERE x IS NOT NULL GROUP BY 1)"""


@query("l9_fit_horizon", _AHEAD + f" SELECT event_type, {sr('slope')} AS slope, {sr('intercept')} AS intercept FROM m")
def l9h(spark, sf):
    out = fc.fit_forecaster(events(spark, sf), EVENTS, _P1)
    return out.select("event_type", r(F.col("coefficients")[0]).alias("slope"), r("intercept").alias("intercept"))


@query("l10_predict_moving_average", f"SELECT event_id, {sr(_sql_average(2))} AS predict FROM {SQL_EVENTS}")
def l10m(spark, sf):
    out = fc.predict_forecast(events(spark, sf), None, EVENTS, P, baseline="moving_average")
    return out.select("event_id", r("predict").alias("predict"))


@query("l10_predict_forecast", _AHEAD + f""" SELECT event_id, {sr('(intercept + slope * x) * (hi - lo) + lo')} AS predict
 FROM f JOIN m USING (event_type)""")
def l10(spark, sf):
    df = events(spark, sf)
    models = fc.fit_forecaster(df, EVENTS, _P1)
    return fc.predict_forecast(df, models, EVENTS, _P1).select("event_id", r("predict").alias("predict"))


_SQL_RESIDUAL = f"""(SELECT event_id, ts, event_type, value, CASE WHEN value = 0 THEN 1000000.0::DOUBLE ELSE abs(value - predict) END AS residuals
 FROM (SELECT *, {_sql_average(2)} AS predict FROM {{rows}}) WHERE predict IS NOT NULL)"""


def _residual_frame(df, zero=fc.ZERO_ACTUAL):
    out = fc.predict_forecast(df, None, EVENTS, P, baseline="moving_average").where("predict is not null")
    return out.withColumn("residuals", fc.residuals(F.col("value"), F.col("predict"), zero))


@query("l11_residuals", f"SELECT event_id, {sr('residuals')} AS residuals FROM {_SQL_RESIDUAL.format(rows=SQL_ZEROS)}")
def l11(spark, sf):
    return _residual_frame(events_zeros(spark, sf)).select("event_id", r("residuals").alias("residuals"))


# ---- scores

_SIZES = """(SELECT *, greatest(CASE WHEN known > s THEN s ELSE known - 2 END, 1)::BIGINT AS sample_size FROM
 (SELECT *, CASE WHEN rows >= 2000 THEN 1000 WHEN rows > 30 THEN floor(rows * 0.5::DOUBLE) ELSE 5 END AS s FROM {counts}))"""


@query("a1_sample_size", "SELECT level, rows, known, sample_size FROM " + _SIZES.format(counts=f"""(
 SELECT user_id::VARCHAR AS level, count(*) AS rows, count(value) AS known FROM {SQL_NULLS} GROUP BY 1 UNION ALL
 SELECT event_type, count(*), count(value) FROM {SQL_NULLS} GROUP BY 1)"""))
def a1(spark, sf):
    df = events_nulls(spark, sf)
    users = rs.sample_sizes(df, USERS).withColumn("level", F.col("user_id").cast("string")).drop("user_id")
    types = rs.sample_sizes(df, EVENTS).withColumnRenamed("event_type", "level")
    return users.unionByName(types)


_RES = _SQL_RESIDUAL.format(rows=SQL_EVENTS)
_SCALED = f"""s AS (SELECT *, (residuals - lo) / (hi - lo) AS scaled, avg((residuals - lo) / (hi - lo)) OVER (PARTITION BY event_type) AS mean_scaled
 FROM (SELECT *, min(residuals) OVER (PARTITION BY event_type) AS lo, max(residuals) OVER (PARTITION BY event_type) AS hi FROM {_RES}))"""


@query("a2_scaled_residual", f"WITH {_SCALED} SELECT event_id, {sr('scaled', 9)} AS scaled, {sr('mean_scaled', 9)} AS mean_scaled FROM s")
def a2(spark, sf):
    out = rs.scaled_residual(_residual_frame(events(spark, sf)), EVENTS)
    return out.select("event_id", r("scaled", 9).alias("scaled"), r("mean_scaled", 9).alias("mean_scaled"))


def _sql_rounds(rows: str, rounds: int, seed: int) -> str:
    counts = f"(SELECT event_type, count(*) AS rows, count(value) AS known FROM {rows} GROUP BY 1)"
    return f"""z AS (SELECT event_type, sample_size FROM {_SIZES.format(counts=counts)}),
 hashed AS (SELECT event_type, event_id, residuals, {sql_hash('event_id', seed)}, unnest(range({rounds})) AS round FROM {rows}),
 drawn AS (SELECT event_type, round, residuals, sample_size FROM hashed JOIN z USING (event_type)
  QUALIFY row_number() OVER (PARTITION BY event_type, round ORDER BY {sql_draw('round')}, event_id) <= sample_size),
 rd AS (SELECT event_type, round, min(residuals) AS lo, max(residuals) AS hi, max(residuals) - min(residuals) AS width,
  (avg(residuals) - min(residuals)) / (max(residuals) - min(residuals)) AS mean FROM drawn GROUP BY 1, 2)"""


@query("a3_residual_rounds", f"""WITH {_sql_rounds(_RES, 30, 3)} SELECT event_type, round::INT AS round, {sr('lo')} AS round_min,
 {sr('hi')} AS round_max, {sr('width')} AS round_range, {sr('mean')} AS round_mean FROM rd""")
def a3(spark, sf):
    out = rs.residual_rounds(_residual_frame(events(spark, sf)), EVENTS, seed=3)
    return out.select("event_type", "round", *[r(c).alias(c) for c in ("round_min", "round_max", "round_range", "round_mean")])


_BETA = f"""{_SCALED}, {_sql_rounds(_RES, 30, 3)},
 x AS (SELECT s.event_id, s.event_type, s.scaled + CASE WHEN s.residuals < s.mean_scaled THEN 0.5 ELSE 0 END AS p, round, sample_size,
  CASE WHEN s.residuals > rd.lo AND s.residuals < rd.hi THEN (s.residuals - rd.lo) / width +
   CASE WHEN (s.residuals - rd.lo) / width < mean THEN 0.5 ELSE 0 END END AS inside
  FROM s JOIN rd USING (event_type) JOIN z USING (event_type)),
 c AS (SELECT *, coalesce(last_value(inside IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY round), 1.0) AS p2 FROM x),
 par AS (SELECT event_id, any_value(p) AS p, (1 + sum(trunc(sample_size * (1 - p2))))::BIGINT AS a,
  (1 + sum(trunc(sample_size * p2)))::BIGINT AS b FROM c GROUP BY event_id)"""


@query("a4_beta_params", f"WITH {_BETA} SELECT event_id, {sr('p')} AS p, a, b FROM par")
def a4(spark, sf):
    df = _residual_frame(events(spark, sf))
    sizes = rs.sample_sizes(df, EVENTS)
    rounds = rs.residual_rounds(df, EVENTS, seed=3, sizes=sizes)
    return rs.beta_params(df, rounds, sizes, EVENTS).select("event_id", r("p").alias("p"), "a", "b")


@query("a5_beta_score", f"""WITH RECURSIVE {_BETA}, {sql_beta_quantile('par')}
 SELECT event_id, {sr('score')} AS anomaly_score_1, coalesce((score < 0.05 OR score > 0.95)::INT, 0) AS ad_label_1 FROM quantile""")
def a5(spark, sf):
    out = rs.beta_score(_residual_frame(events(spark, sf)), EVENTS, seed=3)
    return out.select("event_id", r("anomaly_score_1").alias("anomaly_score_1"), "ad_label_1")


@query("a6_label_two_tail", f"""WITH {_SCALED} SELECT event_id, (scaled < 0.05 OR scaled > 0.95)::INT AS label FROM s
 WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, 0 FROM s WHERE event_id % 7 = 0""")
def a6(spark, sf):
    out = rs.scaled_residual(_residual_frame(events(spark, sf)), EVENTS)
    score = F.when(F.col("event_id") % 7 != 0, F.col("scaled"))
    return out.select("event_id", rs.label_two_tail(score).alias("label"))


@query("a7_student_t_value", f"""SELECT event_id, {sr('''abs(residuals - avg(residuals) OVER (PARTITION BY event_type)) /
 sqrt(var_pop(residuals) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type))''')} AS t_value FROM {_RES}""")
def a7t(spark, sf):
    return rs.student_t_score(_residual_frame(events(spark, sf)), EVENTS).select("event_id", r("t_value").alias("t_value"))


@query("a7_student_t_score", f"""WITH t AS (SELECT event_id, residuals, avg(residuals) OVER w AS m, var_pop(residuals) OVER w AS v,
  count(*) OVER w AS n FROM {_RES} WINDOW w AS (PARTITION BY event_type)),
 x AS (SELECT event_id, abs(residuals - m) / sqrt(v / n) AS t, n - 1 AS dof FROM t)
 SELECT event_id, {sr('1 - ' + sql_t_confidence('t', 'dof'))} AS anomaly_score_1 FROM x""")
def a7(spark, sf):
    out = rs.student_t_score(_residual_frame(events(spark, sf)), EVENTS)
    return out.select("event_id", r("anomaly_score_1").alias("anomaly_score_1"))


def _even_odd(df):
    """Events with even numbers are the sample, the others are scored against it."""
    even = F.col("event_id") % 2 == 0
    return df.where(even), df.where(~even)


_EVEN = "(SELECT event_id, event_type, value AS residuals, value FROM events WHERE event_id % 2 = 0)"


_VALUE_BETA = f"""{_sql_rounds(_EVEN, 30, 0)},
 k AS (SELECT event_type, min(value) AS low, max(value) AS high, avg(value) AS mean FROM {_EVEN} GROUP BY 1),
 v AS (SELECT event_id, event_type, value, (value - low) / (high - low) + CASE WHEN value < (k.mean - low) / (high - low) THEN 0.5 ELSE 0 END AS p
  FROM events JOIN k USING (event_type) WHERE event_id % 2 = 1),
 x AS (SELECT event_id, p, sample_size, CASE WHEN value > lo AND value < hi THEN (value - lo) / width +
   CASE WHEN (value - lo) / width < mean THEN 0.5 ELSE 0 END ELSE 1.0 END AS p2
  FROM v JOIN rd USING (event_type) JOIN z USING (event_type)),
 par AS (SELECT event_id, any_value(p) AS p, (1 + sum(trunc(sample_size * (1 - p2))))::BIGINT AS a,
  (1 + sum(trunc(sample_size * p2)))::BIGINT AS b FROM x GROUP BY event_id)"""


@query("a8_bayes_value_params", f"WITH {_VALUE_BETA} SELECT event_id, {sr('p')} AS p, a, b FROM par")
def a8p(spark, sf):
    sample, values = _even_odd(events(spark, sf))
    return rs.bayes_value_params(sample, values, EVENTS, "value").select("event_id", r("p").alias("p"), "a", "b")


@query("a8_bayes_score_value", f"""WITH RECURSIVE {_VALUE_BETA}, {sql_beta_quantile('par')}
 SELECT event_id, {sr('score')} AS score FROM quantile""")
def a8(spark, sf):
    sample, values = _even_odd(events(spark, sf))
    return rs.bayes_score_value(sample, values, EVENTS, "value").select("event_id", r("score").alias("score"))


@query("a9_mean_ci_inlier", f"""SELECT event_id, (abs(value - m) < {sql_t_quantile(0.995, 'n - 1')} * sqrt(v / n))::INT AS inlier FROM
 (SELECT event_id, value, avg(value) OVER w AS m, var_pop(value) OVER w AS v, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type))""")
def a9(spark, sf):
    return rs.mean_ci_inlier(events(spark, sf), EVENTS).select("event_id", "inlier")


@query("a10_residual_pool", f"""SELECT event_id FROM (SELECT event_id, event_type, {sql_hash('event_id', 5)},
 count(*) OVER (PARTITION BY event_type) AS n FROM events) QUALIFY row_number() OVER (PARTITION BY event_type
 ORDER BY {sql_draw()}, event_id) <= CASE WHEN n > 10000 THEN 10000 ELSE floor(n * 0.25::DOUBLE) END""")
def a10(spark, sf):
    return rs.residual_pool(events(spark, sf), EVENTS, 0.25, seed=5).select("event_id")
