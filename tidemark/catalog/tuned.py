"""Parameter grids and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EVENTS, USERS, events, query, r, sql_draw, sql_hash, sql_t_quantile, sr)
from tidemark.catalog.detectors import sql_tree_scores
from tidemark.catalog.tables import SQL_LINE
from tidemark.operators import tuning as tu
from tidemark.operators.residual_score import mean_ci_inlier
from tidemark.operators.series import join_on


def _cells(grid, detector):
    """Rows (detector, combo, parameter, value) of a grid."""
    names = [n for n, d in tu.DEFAULTS[detector].items() if not isinstance(d, str)]
    wide = grid.select("combo_id", *[F.col(n).cast("double").alias(n) for n in names])
    long = wide.unpivot(["combo_id"], names, "parameter", "value")
    return long.select(F.lit(detector).alias("detector"), "combo_id", "parameter", r("value").alias("value"))



def _sql_ranges(name, start, last):
    """One column with start, 2 * start, ... last."""
    return f"(SELECT i * {start}::DOUBLE AS {name} FROM range(1, {last} + 1) t(i))"


_SQL_GRIDS = {
    "iso_f": (f"{_sql_ranges('contamination', 0.1, 4)} CROSS JOIN {_sql_ranges('num_of_trees', 200, 5)}",
              "contamination, num_of_trees", {"split_ratio": 0.8}),
    "lstm": (f"{_sql_ranges('batch_size', 8, 2)} CROSS JOIN {_sql_ranges('epochs', 5, 3)} CROSS JOIN"
             f" {_sql_ranges('lr', 0.01, 4)} CROSS JOIN {_sql_ranges('units', 4, 2)}",
             "batch_size, epochs, lr, units",
             {"batch_count": 8, "l1": 0.01, "l2": 0.01, "lag": 2, "lahead": 2, "split_ratio": 0.8, "tsteps": 2}),
    "prophet": (f"{_sql_ranges('changepoint_range', 0.1, 4)} CROSS JOIN {_sql_ranges('n_changepoints', 50, 5)}",
                "changepoint_range, n_changepoints",
                {"contamination": 0.3, "interval_width": 0.9, "num_of_trees": 200, "split_ratio": 0.8}),
}


def _sql_cells(detector):
    product, moving, fixed = _SQL_GRIDS[detector]
    columns = [*moving.split(", "), *fixed]
    constants = "".join(f", {v}::DOUBLE AS {k}" for k, v in fixed.items())
    grid = f"(SELECT row_number() OVER (ORDER BY {moving}) - 1 AS combo_id, {moving}{constants} FROM {product})"
    cells = ", ".join(f"{{'parameter': '{c}', 'value': {c}::DOUBLE}}" for c in columns)
    return (f"SELECT '{detector}' AS detector, combo_id, c.parameter, {sr('c.value')} AS value FROM"
            f" (SELECT combo_id, unnest([{cells}]) AS c FROM {grid})")


_USERS_OF = "(SELECT DISTINCT event_type FROM events)"


@query("g1_param_grid", f"SELECT event_type, g.* FROM {_USERS_OF}, (" + " UNION ALL ".join(_sql_cells(d) for d in _SQL_GRIDS) + ") g")
def g1(spark, sf):
    """The grids of the three detectors (20, 48 and 20 combinations) for each series."""
    parts = [_cells(tu.param_grid(spark, tu.DEFAULTS[d], tu.RANGES[d]), d) for d in _SQL_GRIDS]
    grids = parts[0].unionByName(parts[1]).unionByName(parts[2])
    series = events(spark, sf).select("event_type").distinct()
    # The grids have 88 combinations in all, whatever the data.
    return join_on(series, grids, [])


@query("g2_half_grid", f"""WITH g AS (SELECT user_id AS combo_id, {sql_hash('user_id', 9)} FROM (SELECT DISTINCT user_id FROM events))
 SELECT combo_id FROM g QUALIFY row_number() OVER (ORDER BY {sql_draw()}, combo_id) <= (SELECT count(*) FROM g) // 2""")
def g2(spark, sf):
    """A random half of numbered combinations, here one per user."""
    return tu.half_grid(events(spark, sf).select(F.col("user_id").alias("combo_id")).distinct(), seed=9)


@query("g3_typed_params", """SELECT event_id, trunc(value)::INT AS batch_size, round(value / 1000, 9) AS lr, value::DOUBLE AS split_ratio FROM events""")
def g3(spark, sf):
    defaults = tu.DEFAULTS["lstm"]
    v = F.col("value")
    return events(spark, sf).select(
        "event_id", tu.typed(v, defaults["batch_size"]).alias("batch_size"),
        tu.typed(v / 1000, defaults["lr"]).alias("lr"), tu.typed(v, defaults["split_ratio"]).alias("split_ratio"))


def _sql_tail(share):
    return f"""(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)
 <= floor(count(*) OVER (PARTITION BY event_type) * {share}::DOUBLE))"""


@query("g4_tail_window", f"SELECT event_id, 'iso_f' AS detector FROM {_sql_tail(0.3)} UNION ALL SELECT event_id, 'prophet' FROM {_sql_tail(0.1)}")
def g4(spark, sf):
    df = events(spark, sf)
    parts = [tu.tail_window(df, EVENTS, tu.TAIL_SHARE[d]).select("event_id", F.lit(d).alias("detector"))
             for d in ("iso_f", "prophet")]
    return parts[0].unionByName(parts[1])


@query("g5_objective_forecast", f"SELECT event_type, combo_id, 0.0::DOUBLE AS error FROM {_USERS_OF}, range(48) t(combo_id)")
def g5(spark, sf):
    """With tsteps = lag = 2 the target is a mean of the features: every combination fits exactly."""
    grid = tu.param_grid(spark, tu.DEFAULTS["lstm"], tu.RANGES["lstm"])
    out = tu.objective_forecast(events(spark, sf), EVENTS, grid)
    return out.select("event_type", "combo_id", r("error").alias("error"))


_ROLLING = """WITH e AS (SELECT event_type, ts, event_id, (value - min(value) OVER s) / (max(value) OVER s - min(value) OVER s) AS y,
  count(*) OVER s AS n, row_number() OVER (s ORDER BY ts, event_id) AS pos FROM events WINDOW s AS (PARTITION BY event_type)),
 x AS (SELECT event_type, y, (pos - 1) * 5 // n AS block, lag(y, 1) OVER w AS x1, lag(y, 2) OVER w AS x2, lag(y, 3) OVER w AS x3
  FROM e WINDOW w AS (PARTITION BY event_type ORDER BY pos)),
 k AS (SELECT unnest(range(1, 5)) AS k),
 one AS (SELECT event_type, k, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM x JOIN k ON block < k WHERE x1 IS NOT NULL GROUP BY ALL),
 pairs AS (SELECT event_type, block, y, x1, x2 AS z, 2 AS gap FROM x UNION ALL SELECT event_type, block, y, x1, x3, 3 FROM x),
 s AS (SELECT event_type, gap, k, avg(y) AS my, avg(x1) AS mx, avg(z) AS mz, var_pop(x1) AS vx, var_pop(z) AS vz, covar_pop(x1, z) AS c,
  covar_pop(y, x1) AS cx, covar_pop(y, z) AS cz FROM pairs JOIN k ON block < k WHERE x1 IS NOT NULL AND z IS NOT NULL GROUP BY ALL),
 two AS (SELECT *, (cx * vz - cz * c) / (vx * vz - c * c) AS bx, (cz * vx - cx * c) / (vx * vz - c * c) AS bz FROM s),
 err AS (SELECT event_type, 1 AS lag, 1 AS gap, avg(abs(a + b * x1 - y)) AS error FROM x JOIN one USING (event_type) WHERE block = k AND x1 IS NOT NULL GROUP BY 1
  UNION ALL SELECT event_type, 2, gap, avg(abs(my + bx * (x1 - mx) + bz * (z - mz) - y)) FROM pairs JOIN two USING (event_type, gap)
  WHERE block = k AND x1 IS NOT NULL AND z IS NOT NULL GROUP BY event_type, gap)"""


@query("g5_objective_rolling", f"""{_ROLLING} SELECT event_type, combo_id, {sr('error')} AS error
 FROM err JOIN (VALUES (0, 1, 1), (1, 1, 1), (2, 2, 2), (3, 2, 3)) c(combo_id, lag, gap) USING (lag, gap)""")
def g5r(spark, sf):
    """Errors on rows that were not fitted on, for one and two lags and two distances between them."""
    grid = tu.param_grid(spark, tu.DEFAULTS["lstm"], {"lag": "1*3", "lahead": "2*6"})
    out = tu.objective_rolling(events(spark, sf), EVENTS, grid)
    return out.select("event_type", "combo_id", r("error").alias("error"))


_OUTLIER = f"""(SELECT event_type, (abs(value - m) >= {sql_t_quantile(0.995, 'n - 1')} * sqrt(v / n))::INT AS actual,
 (value > 60)::INT AS label FROM (SELECT event_type, value, avg(value) OVER w AS m, var_pop(value) OVER w AS v, count(*) OVER w AS n
 FROM events WINDOW w AS (PARTITION BY event_type)))"""


@query("g6_macro_f1", f"""SELECT event_type, tp, fp, fn, tn, {sr('(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2')}
 AS macro_f1 FROM (SELECT event_type, count(*) FILTER (WHERE actual = 1 AND label = 1) AS tp, count(*) FILTER (WHERE actual = 0 AND label = 1) AS fp,
 count(*) FILTER (WHERE actual = 1 AND label = 0) AS fn, count(*) FILTER (WHERE actual = 0 AND label = 0) AS tn FROM {_OUTLIER} GROUP BY 1)""")
def g6f(spark, sf):
    df = mean_ci_inlier(events(spark, sf), EVENTS)
    counts = tu.macro_f1(1 - F.col("inlier"), (F.col("value") > 60).cast("int"))
    out = df.groupBy("event_type").agg(*[c.alias(n) for n, c in counts.items()])
    return out.withColumn("macro_f1", r("macro_f1"))


@query("g6_objective_iforest", f"""WITH {sql_tree_scores(5, _sql_tail(0.3))},
 by_size AS (SELECT event_id, event_type, k, avg(height) AS height FROM per_tree, range(1, 6) t(k) WHERE tree < k GROUP BY ALL),
 scores AS (SELECT event_id, event_type, k, -pow(2.0, -height / c) AS score FROM by_size JOIN norm USING (event_type)),
 quantiles AS (SELECT event_type, k, quantile_cont(score, [0.1, 0.2, 0.3, 0.4]) AS qs FROM scores GROUP BY ALL),
 limits AS (SELECT event_type, k, i, qs[i + 1] AS threshold FROM quantiles, range(4) t(i)),
 truth AS (SELECT event_id, (abs(value - m) >= {sql_t_quantile(0.995, 'n - 1')} * sqrt(v / n))::INT AS actual FROM (SELECT event_id, value,
  avg(value) OVER w AS m, var_pop(value) OVER w AS v, count(*) OVER w AS n FROM {_sql_tail(0.3)} WINDOW w AS (PARTITION BY event_type))),
 judged AS (SELECT event_type, k, i, actual, (score < threshold)::INT AS label FROM scores JOIN limits USING (event_type, k) JOIN truth USING (event_id)),
 counts AS (SELECT event_type, k, i, count(*) FILTER (WHERE actual = 1 AND label = 1) AS tp, count(*) FILTER (WHERE actual <> label) AS wrong,
  count(*) FILTER (WHERE actual = 0 AND label = 0) AS tn FROM judged GROUP BY ALL)
 SELECT event_type, i * 5 + k - 1 AS combo_id, {sr("""1 - (coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0)
  + coalesce(2 * tn / nullif(2 * tn + wrong, 0), 0)) / 2""")} AS error FROM counts""")
def g6(spark, sf):
    grid = tu.param_grid(spark, tu.DEFAULTS["iso_f"], tu.RANGES["iso_f"])
    tail = tu.tail_window(events(spark, sf), EVENTS, tu.TAIL_SHARE["iso_f"])
    # The SQL has one subsample for 200 trees.
    out = tu.objective_iforest(tail.select("event_id", "ts", "event_type", "value"), EVENTS, grid, trees_per_subsample=200)
    return out.select("event_type", "combo_id", r("error").alias("error"))


@query("g7_objective_trend", SQL_LINE.format(rows=_sql_tail(0.1)) + f""", fitted AS (SELECT event_type, value, intercept + slope *
  (epoch_us(date_trunc('second', ts)) - epoch_us(date_trunc('second', min(ts) OVER (PARTITION BY event_type)))) / 86400e6 AS yhat
  FROM {_sql_tail(0.1)} JOIN m USING (event_type)),
 errors AS (SELECT event_type, avg(abs((value - abs(yhat)) / nullif(value, 0))) * 100 AS error FROM fitted GROUP BY 1)
 SELECT event_type, combo_id, {sr('error')} AS error FROM errors, range(20) t(combo_id)""")
def g7(spark, sf):
    grid = tu.param_grid(spark, tu.DEFAULTS["prophet"], tu.RANGES["prophet"])
    tail = tu.tail_window(events(spark, sf), EVENTS, tu.TAIL_SHARE["prophet"])
    out = tu.objective_trend(tail, EVENTS, grid, kind="linear")
    return out.select("event_type", "combo_id", r("error").alias("error"))


@query("g7_objective_piecewise")
def g7p(spark, sf):
    grid = tu.param_grid(spark, tu.DEFAULTS["prophet"], tu.RANGES["prophet"])
    tail = tu.tail_window(events(spark, sf), EVENTS, tu.TAIL_SHARE["prophet"])
    out = tu.objective_trend(tail, EVENTS, grid)
    return out.select("event_type", "combo_id", r("error").alias("error"))


_SQL_ERRORS = "(SELECT user_id, (event_id % 20)::BIGINT AS combo_id, min(round(value, 0)) AS error FROM events GROUP BY 1, 2)"


@query("g8_best_params", f"""SELECT user_id, b.combo_id AS combo_id, b.error AS error, {sr('0.1 * (b.combo_id // 5 + 1)')} AS contamination,
 (200 * (b.combo_id % 5 + 1))::BIGINT AS num_of_trees FROM
 (SELECT user_id, min({{'error': error, 'combo_id': combo_id}}) AS b FROM {_SQL_ERRORS} GROUP BY 1)""")
def g8(spark, sf):
    errors = events(spark, sf).groupBy("user_id", (F.col("event_id") % 20).alias("combo_id")).agg(
        F.min(F.round("value", 0)).alias("error"))
    grid = tu.param_grid(spark, tu.DEFAULTS["iso_f"], tu.RANGES["iso_f"])
    out = tu.best_params(errors, grid, USERS.groups)
    return out.select("user_id", "combo_id", "error", r("contamination").alias("contamination"),
                      F.col("num_of_trees").cast("bigint").alias("num_of_trees"))


def _tuned(spark, sf):
    """Parameters exist for the users that signed up."""
    return events(spark, sf).where("event_type = 'signup'").groupBy("user_id").agg(
        F.max(F.col("event_id") % 5 * 0.1 + 0.1).alias("contamination"))


_SQL_TUNED = "(SELECT user_id, max(event_id % 5 * 0.1::DOUBLE + 0.1::DOUBLE) AS contamination FROM events WHERE event_type = 'signup' GROUP BY 1)"


@query("g9_params_for", f"""SELECT user_id, {sr('coalesce(contamination, 0.01)')} AS contamination FROM (SELECT DISTINCT user_id FROM events)
 LEFT JOIN {_SQL_TUNED} USING (user_id)""")
def g9(spark, sf):
    series = events(spark, sf).select("user_id").distinct()
    out = tu.params_for(series, _tuned(spark, sf), tu.DEFAULTS["iso_f"], ["user_id"])
    return out.select("user_id", r("contamination").alias("contamination"))


@query("g10_tune_if_needed", """SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) FILTER (event_id % 5 = 0) = 0""")
def g10(spark, sf):
    """Series are the users' event types; those with an event whose number is a multiple of 5 have parameters."""
    df = events(spark, sf)
    tuned = df.where("event_id % 5 = 0").select("user_id", "event_type").distinct()
    return tu.tune_if_needed(df.select("user_id", "event_type").distinct(), tuned, ["user_id", "event_type"])
