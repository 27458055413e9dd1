"""Input frames, SQL fragments and the registry."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.spec import SeriesSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS = SeriesSpec("ts", "value", "event_type", "event_id")
USERS = SeriesSpec("ts", "value", "user_id", "event_id")
ORDERS = SeriesSpec("o_orderdate", "o_totalprice", "o_orderstatus", "o_orderkey")
LINES = SeriesSpec("l_shipdate", "l_extendedprice", "l_returnflag+l_linestatus",
                   ("l_orderkey", "l_linenumber"))

# The same inputs as SQL.
SQL_EVENTS = "(SELECT event_id, ts, event_type, user_id, value FROM events)"
SQL_NULLS = ("(SELECT event_id, ts, event_type, user_id,"
             " CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)")
SQL_ZEROS = ("(SELECT event_id, ts, event_type, user_id,"
             " CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS value FROM events)")


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")


def events_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def events_zeros(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.when(F.col("event_id") % 11 == 0, F.lit(0.0))
    return events(spark, sf).withColumn("value", zero.otherwise(F.col("value")))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))


def r(column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def text(time) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def sr(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def st(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def sql_hash(ids: str, seed: int) -> str:
    """Columns h1 and h2 of the row draw."""
    digest = f"md5(concat_ws('|', {ids}, '{seed}'))"
    return (f"('0x' || substr({digest}, 1, 8))::BIGINT AS h1,"
            f" ('0x' || substr({digest}, 9, 8))::BIGINT AS h2")


def sql_draw(round_: str = "0") -> str:
    return f"((h1 + ({round_} + 1) * h2) % 2147483647)"


def sql_t_quantile(q: float, dof: str) -> str:
    """Quantile of Student's t by the expansion in 1 / dof around the normal quantile."""
    z = NormalDist().inv_cdf(q)
    terms = [
        (z ** 3 + z) / 4,
        (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
        (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
        (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160,
    ]
    v = f"({dof})::DOUBLE"
    return f"({z!r}::DOUBLE" + "".join(
        f" + {c!r}::DOUBLE / pow({v}, {i + 1})" for i, c in enumerate(terms)) + ")"


def sql_t_confidence(t: str, dof: str) -> str:
    """P(|T| < t) by the finite sums in the angle atan(t / sqrt(dof))."""
    angle = f"atan(abs({t}) / sqrt(({dof})::DOUBLE))"
    even = (f"sin({angle}) * list_sum(list_transform(range(0, (({dof}) // 2)::BIGINT), lambda j:"
            f" exp(lgamma(2.0 * j + 1) - 2 * lgamma(j + 1.0) - 2 * j * ln(2.0) + 2 * j * ln(cos({angle})))::DOUBLE))")
    odd = (f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform("
           f"range(0, ((({dof}) - 1) // 2)::BIGINT), lambda j:"
           f" exp(2 * j * ln(2.0) + 2 * lgamma(j + 1.0) - lgamma(2.0 * j + 2) + (2 * j + 1) * ln(cos({angle})))::DOUBLE)), 0))")
    return f"(CASE WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"


def sql_beta_quantile(params: str) -> str:
    """Tables ``beta`` and ``quantile`` (event_id, score) for ``params`` (event_id, p, a, b), a and b whole numbers.

    The distribution function is a finite binomial sum, of which the terms within some deviations of the centre count.
    Newton steps from the mode come down on the quantile from one side. Needs WITH RECURSIVE.
    """
    n = "(a + b - 1)"
    reach = f"(9 * sqrt({n} * x * (1 - x)) + 40)"
    terms = f"range(greatest(a, floor({n} * x - {reach}))::BIGINT, least({n}, ceil({n} * x + {reach}))::BIGINT + 1)"
    total = (f"coalesce(list_sum(list_transform({terms}, lambda j: exp(lgamma({n} + 1.0) - lgamma(j + 1.0) - lgamma({n} - j + 1.0)"
             f" + j * ln(x) + ({n} - j) * ln(1 - x))::DOUBLE)), 0)")
    density = f"exp(lgamma({n} + 1.0) - lgamma(a::DOUBLE) - lgamma(b::DOUBLE) + (a - 1) * ln(x) + (b - 1) * ln(1 - x))"
    return f"""beta AS (
  SELECT event_id, p, a, b, (a - 1)::DOUBLE / (a + b - 2) AS x, 1.0::DOUBLE AS moved, 0 AS step FROM {params} WHERE p > 0 AND p < 1 AND a > 1 AND b > 1
  UNION ALL SELECT event_id, p, a, b, x - moved, moved, step + 1 FROM
   (SELECT event_id, p, a, b, x, ({total} - p) / {density} AS moved, step FROM beta WHERE abs(moved) > 1e-10 AND step < 200)),
 quantile AS (SELECT event_id, arg_max(x, step) AS score FROM beta GROUP BY event_id
  UNION ALL SELECT event_id, CASE WHEN p < 0 OR p > 1 THEN NULL WHEN p IN (0, 1) THEN p WHEN a = 1 THEN 1 - pow(1 - p, 1.0 / b)
   ELSE pow(p, 1.0 / a) END FROM {params} WHERE p <= 0 OR p >= 1 OR a = 1 OR b = 1)"""
