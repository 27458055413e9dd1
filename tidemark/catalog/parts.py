"""Calendar parts and their selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EVENTS, SQL_EVENTS, events, lines, orders, query, r, sql_draw, sql_hash, sql_t_confidence,
    sql_t_quantile, sr)
from tidemark.functions.dates import PARTS, date_part
from tidemark.functions.sampling import cap_sample
from tidemark.operators import timeparts as tp

SQL_PARTS = {
    "year": "year({t})", "quarter": "'Q' || quarter({t}) || '_' || year({t})", "month": "month({t})",
    "week": "weekofyear({t})", "week_part": "CASE WHEN isodow({t}) >= 6 THEN 1 ELSE 0 END",
    "week_day": "isodow({t})",
    "day_part": "CASE WHEN hour({t}) < 7 THEN 'night' WHEN hour({t}) < 12 THEN 'morning' WHEN hour({t}) < 17"
                " THEN 'afternoon' WHEN hour({t}) < 21 THEN 'evening1' ELSE 'evening2' END",
    "hour": "hour({t})", "min": "minute({t})", "second": "second({t})",
}
_TEXT = ("quarter", "day_part")


def _register(number: int, part: str):
    kind = ("string", "VARCHAR") if part in _TEXT else ("bigint", "BIGINT")
    on_orders = part in ("year", "quarter", "month", "week", "week_part", "week_day")
    key, time, name = ("o_orderkey", "o_orderdate", "orders") if on_orders else ("event_id", "ts", "events")
    load = orders if on_orders else events

    @query(f"t{number}_{part}", f"SELECT {key}, ({SQL_PARTS[part].format(t=time)})::{kind[1]} AS part FROM {name}")
    def run(spark, sf):
        return load(spark, sf).select(key, date_part(time, part).cast(kind[0]).alias("part"))


for _i, _part in enumerate(PARTS, 1):
    _register(_i, _part)


@query("t11_span_seconds", f"""SELECT {sr('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS span_seconds FROM events""")
def t11(spark, sf):
    return tp.span_seconds(events(spark, sf), "ts").select(r("span_seconds").alias("span_seconds"))


def _sql_grain(time: str, name: str) -> str:
    order = list(reversed(PARTS))
    def case(value):
        return "CASE " + " ".join(
            f"WHEN count(DISTINCT {SQL_PARTS[p].format(t=time)}) >= 2 THEN '{value(p)}'" for p in order) + " END"
    return (f"SELECT '{name}' AS source, {case(lambda p: p)} AS grain,"
            f" {case(lambda p: '*'.join(PARTS[:PARTS.index(p)]))} AS candidates FROM {name}")


SQL_GRAINS = " UNION ALL ".join(_sql_grain(t, n) for t, n in (("ts", "events"), ("o_orderdate", "orders"), ("l_shipdate", "lineitem")))


def _grains(spark, sf):
    found = [tp.finest_part(load(spark, sf), time).withColumn("source", F.lit(name))
             for load, time, name in ((events, "ts", "events"), (orders, "o_orderdate", "orders"), (lines, "l_shipdate", "lineitem"))]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("t12_finest_part", SQL_GRAINS)
def t12(spark, sf):
    return _grains(spark, sf).select("source", "grain", "candidates")


_ACCEPTED = ("", "year", "quarter", "day_part", "week_part")
_SQL_RULE = """CASE part WHEN 'year' THEN coarse_ok WHEN 'quarter' THEN coarse_ok AND accepted <> 'year'
 WHEN 'month' THEN coarse_ok AND accepted <> 'quarter'
 WHEN 'week' THEN grain IN ('hour', 'min', 'second') AND accepted NOT IN ('year', 'quarter', 'month')
 WHEN 'week_part' THEN grain IN ('day', 'hour') WHEN 'week_day' THEN grain IN ('hour', 'min', 'second') AND accepted <> 'week_part'
 WHEN 'day_part' THEN grain IN ('min', 'second') WHEN 'hour' THEN grain = 'second' AND accepted <> 'day_part' ELSE false END"""


@query("t13_part_candidates", f"""WITH g AS ({SQL_GRAINS}),
 c AS (SELECT source, grain, part, accepted, grain NOT IN ('week', 'week_part', 'week_day', 'day') AS coarse_ok FROM g,
  unnest([{', '.join(f"'{p}'" for p in PARTS)}]) p(part), unnest([{', '.join(f"'{a}'" for a in _ACCEPTED)}]) a(accepted))
 SELECT source, part, accepted, ({_SQL_RULE})::INT AS allowed FROM c""")
def t13(spark, sf):
    cells = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(a).alias("accepted"),
                               tp.part_allowed(p, F.col("grain"), F.array(F.lit(a))).cast("int").alias("allowed"))
                      for p in PARTS for a in _ACCEPTED])
    return _grains(spark, sf).select("source", F.explode(cells).alias("c")).select("source", "c.*")


@query("t14_span_gate", " UNION ALL ".join(
    f"""SELECT '{n}' AS source, part, compat, (CASE part WHEN 'year' THEN d >= 732 WHEN 'quarter' THEN d >= 366
 WHEN 'hour' THEN true ELSE compat = 0 END)::INT AS passes FROM
 (SELECT floor((epoch_us(max({t})) - epoch_us(min({t}))) / 86400e6) AS d FROM {n}),
 unnest([{', '.join(f"'{p}'" for p in PARTS)}]) p(part), unnest([0, 1]) c(compat)"""
    for t, n in (("ts", "events"), ("l_shipdate", "lineitem"))))
def t14(spark, sf):
    def gates(load, time, name):
        cells = F.array(*[F.struct(
            F.lit(p).alias("part"), F.lit(c).alias("compat"),
            tp.span_gate(p, F.col("span_seconds"), bool(c)).cast("int").alias("passes")) for p in PARTS for c in (0, 1)])
        span = tp.span_seconds(load(spark, sf), time)
        return span.select(F.lit(name).alias("source"), F.explode(cells).alias("c")).select("source", "c.*")

    return gates(events, "ts", "events").unionByName(gates(lines, "l_shipdate", "lineitem"))


@query("t15_part_counts_ok", " UNION ALL ".join(
    f"""SELECT '{p}' AS part, (count(*) >= 2 AND min(n) > 1)::INT AS ok FROM
 (SELECT count(*) AS n FROM orders GROUP BY {SQL_PARTS[p].format(t='o_orderdate')})""" for p in PARTS))
def t15(spark, sf):
    df = orders(spark, sf)
    checks = [tp.part_counts_ok(df, "o_orderdate", p).select(F.lit(p).alias("part"), F.col("ok").cast("int").alias("ok"))
              for p in PARTS]
    return reduce(lambda a, b: a.unionByName(b), checks)


def _sql_test(part: str, rows: str) -> str:
    return f"""WITH m AS (SELECT ({SQL_PARTS[part].format(t='ts')})::VARCHAR AS level, avg(value) AS mean, var_pop(value) AS var,
  count(*) AS n FROM {rows} WHERE value IS NOT NULL GROUP BY 1),
 p AS (SELECT a.level AS level_a, b.level AS level_b, a.n + b.n - 2 AS dof, a.mean - b.mean AS gap,
  sqrt(a.var / a.n + b.var / b.n) AS se FROM m a JOIN m b ON a.level < b.level),
 c AS (SELECT *, gap / se AS t, {sql_t_quantile(0.975, 'dof')} AS cv FROM p),
 x AS (SELECT *, {sql_t_confidence('t', 'dof')} AS confidence FROM c)
 SELECT level_a, level_b, dof, {sr('t')} AS t, {sr('confidence')} AS confidence, {sr('abs(gap) - cv * se', 4)} AS ci_low,
  {sr('abs(gap) + cv * se', 4)} AS ci_high, (confidence > 0.975)::INT AS rejected FROM x"""


def _tested(out):
    return out.select("level_a", "level_b", "dof", r("t").alias("t"), r("confidence").alias("confidence"),
                      r("ci_low", 4).alias("ci_low"), r("ci_high", 4).alias("ci_high"), "rejected")


@query("t16_t_test", _sql_test("week_part", SQL_EVENTS))
def t16(spark, sf):
    return _tested(tp.t_test_exact(events(spark, sf), date_part("ts", "week_part"), EVENTS))


@query("t17_cap_sample", f"""SELECT event_type, event_id FROM (SELECT event_type, event_id, {sql_hash('event_id', 7)} FROM events)
 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {sql_draw()}, event_id) <= 150""")
def t17(spark, sf):
    return cap_sample(events(spark, sf), ["event_type"], ["event_id"], 150, seed=7).select("event_type", "event_id")


_SQL_ROUNDS = """greatest(1, floor({n} * (CASE WHEN {n} < 1000 THEN 0.1 WHEN {n} > 1000 AND {n} < 10000 THEN 0.01
 ELSE 0.0001 END)::DOUBLE))::BIGINT"""


@query("t18_bootstrap_rounds", f"""SELECT source, level, {_SQL_ROUNDS.format(n='n')} AS rounds FROM (
 SELECT 'user' AS source, user_id::VARCHAR AS level, count(*) AS n FROM events GROUP BY ALL UNION ALL
 SELECT 'type', event_type, count(*) FROM events GROUP BY ALL UNION ALL
 SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL UNION ALL
 SELECT 'flag', l_returnflag, count(*) FROM lineitem GROUP BY ALL)""")
def t18(spark, sf):
    def sizes(df, column, source):
        return df.groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn(
            "source", F.lit(source))

    every = [sizes(events(spark, sf), "user_id", "user"), sizes(events(spark, sf), "event_type", "type"),
             sizes(orders(spark, sf), "o_orderstatus", "status"), sizes(lines(spark, sf), "l_returnflag", "flag")]
    every = reduce(lambda a, b: a.unionByName(b), every)
    return every.select("source", "level", tp.bootstrap_rounds(F.col("n")).alias("rounds"))


def _sql_bootstrap(part: str, seed: int = 0) -> str:
    """CTEs; the last one, ``h0``, has the share of accepted tests per pair."""
    return f"""WITH raw AS (SELECT ({SQL_PARTS[part].format(t='ts')})::VARCHAR AS level, event_id, value,
  {sql_hash('event_id', seed)} FROM events),
 capped AS (SELECT level, event_id, value FROM raw
  QUALIFY row_number() OVER (PARTITION BY level ORDER BY {sql_draw()}, event_id) <= 100000),
 h AS (SELECT level, event_id, value, {sql_hash('event_id', seed + 1)} FROM capped),
 n AS (SELECT level, count(*) AS n FROM h GROUP BY 1),
 p AS (SELECT a.level AS level_a, b.level AS level_b, least(a.n, b.n) AS s FROM n a JOIN n b ON a.level < b.level),
 p2 AS (SELECT level_a, level_b, floor(s * 0.6::DOUBLE)::BIGINT AS m, {_SQL_ROUNDS.format(n='s')} AS rounds FROM p),
 side AS (SELECT level_a AS level, m, rounds FROM p2 UNION SELECT level_b, m, rounds FROM p2),
 mr AS (SELECT level, max(rounds) AS mr FROM side GROUP BY 1),
 d AS (SELECT level, event_id, value, h1, h2, unnest(range(mr)) AS round FROM h JOIN mr USING (level)),
 k AS (SELECT level, round, value, row_number() OVER (PARTITION BY level, round ORDER BY {sql_draw('round')}, event_id) AS rk FROM d),
 mo AS (SELECT k.level, k.round, z.m, avg(value) AS mean, var_pop(value) AS var FROM k
  JOIN (SELECT DISTINCT level, m FROM side) z ON k.level = z.level AND rk <= z.m GROUP BY ALL),
 runs AS (SELECT level_a, level_b, m, rounds, unnest(range(rounds)) AS round FROM p2),
 tests AS (SELECT runs.*, abs(a.mean - b.mean) / sqrt(a.var / runs.m + b.var / runs.m) AS t FROM runs
  JOIN mo a ON a.level = level_a AND a.round = runs.round AND a.m = runs.m
  JOIN mo b ON b.level = level_b AND b.round = runs.round AND b.m = runs.m),
 h0 AS (SELECT level_a, level_b, m, rounds, avg((t <= {sql_t_quantile(0.9875, '2 * m - 2')})::INT) AS h0_share FROM tests GROUP BY ALL)"""


@query("t19_bootstrap_t_test", _sql_bootstrap("hour") + f" SELECT level_a, level_b, m, rounds, {sr('h0_share')} AS h0_share FROM h0")
def t19(spark, sf):
    out = tp.bootstrap_t_test(events(spark, sf), date_part("ts", "hour"), EVENTS)
    return out.withColumn("h0_share", r("h0_share"))


@query("t20_part_is_significant", _sql_bootstrap("week_day") + """ SELECT count(*) AS pairs, count(*) FILTER (WHERE h0_share < 0.9) AS differing,
 (count(*) FILTER (WHERE h0_share < 0.9) > count(*) * 0.5)::INT AS significant FROM h0""")
def t20(spark, sf):
    return tp.part_is_significant(tp.bootstrap_t_test(events(spark, sf), date_part("ts", "week_day"), EVENTS))


def _decision_rows(spark, decisions):
    rows = [(d.part, int(d.tested), d.pairs, d.differing, int(d.accepted)) for d in decisions]
    return spark.createDataFrame(rows, "part string, tested int, pairs bigint, differing bigint, accepted int")


@query("t21_select_time_parts", _sql_bootstrap("hour") + f""" SELECT 'hour' AS part, 1 AS tested, count(*) AS pairs,
 count(*) FILTER (WHERE h0_share < 0.9) AS differing, (count(*) FILTER (WHERE h0_share < 0.9) > count(*) * 0.5)::INT AS accepted FROM h0
 UNION ALL SELECT part, 0, 0, 0, 0 FROM unnest([{', '.join(f"'{p}'" for p in PARTS if p not in ('hour', 'second'))}]) p(part)""")
def t21(spark, sf):
    """A month of events by the second: of all parts only the hour is testable."""
    return _decision_rows(spark, tp.select_time_parts(events(spark, sf), EVENTS))


@query("t21_select_time_parts_years")
def t21y(spark, sf):
    """The events stretched over three years, with a level per year."""
    df = events(spark, sf)
    first = df.agg(F.min("ts")).first()[0]
    since = F.unix_micros("ts") - F.unix_micros(F.lit(first))
    df = df.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(first)) + since * 40))
    df = df.withColumn("value", F.col("value") + 100 * F.year("ts"))
    return _decision_rows(spark, tp.select_time_parts(df, EVENTS))


@query("t22_apply_time_parts", f"""SELECT event_id, {SQL_PARTS['week_day'].format(t='ts')}::BIGINT AS week_day,
 {SQL_PARTS['day_part'].format(t='ts')} AS day_part FROM events""")
def t22(spark, sf):
    df, spec = tp.apply_time_parts(events(spark, sf), EVENTS, "week_day*day_part")
    return df.select("event_id", *[F.col(p).cast("bigint").alias(p) if p == "week_day" else p
                                   for p in spec.groups if p != "event_type"])


@query("t23_t_test_exact", _sql_test("hour", SQL_EVENTS))
def t23(spark, sf):
    return _tested(tp.t_test_exact(events(spark, sf), date_part("ts", "hour"), EVENTS))
