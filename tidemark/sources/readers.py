"""Reading tables and bringing time and feature into shape."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import SeriesSpec

# Separators tried in order, and text encoding of CSV files.
SEPARATORS = (",", ";", ":")
ENCODING = "ISO-8859-1"

# Time formats tried in order; the first that parses a cell wins. Where day and month could be either, the month comes first.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm[XXX]", "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd hh:mm[:ss] a", "yyyy-MM-dd", "yyyy/MM/dd HH:mm[:ss]", "yyyy/MM/dd",
    "M/d/yyyy HH:mm[:ss]", "M/d/yyyy hh:mm[:ss] a", "M/d/yyyy", "d/M/yyyy HH:mm[:ss]", "d/M/yyyy hh:mm[:ss] a", "d/M/yyyy",
    "d MMM yyyy[ HH:mm][:ss]", "d MMMM yyyy[ HH:mm][:ss]", "MMM d, yyyy[ HH:mm][:ss]", "MMMM d, yyyy[ HH:mm][:ss]",
    "yyyyMMdd", "yyyyMMddHHmmss",
)
# Whole numbers in this range are dates written as yyyyMMdd; all others are seconds since 1970.
DATE_NUMBERS = (19000101, 29991231)

JDBC = {
    # kind: (URL prefix, default port, driver class); Redshift speaks the PostgreSQL protocol.
    "mysql": ("jdbc:mysql", 3306, "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("jdbc:postgresql", 5432, "org.postgresql.Driver"),
    "awsredshift": ("jdbc:postgresql", 5439, "org.postgresql.Driver"),
}


def _header(spark: SparkSession, path: str) -> str:
    lines = spark.read.option("encoding", ENCODING).text(path).limit(1).collect()
    return lines[0][0] if lines else ""


def _columns(line: str, sep: str) -> list[str]:
    """Column names on the header line."""
    names = next(csv.reader([line], delimiter=sep), [])
    return [name if name else f"_c{i}" for i, name in enumerate(names)]


def read_csv(spark: SparkSession, path: str, seps=SEPARATORS, types: dict | None = None) -> DataFrame:
    """A CSV file or folder with a header, all columns text unless ``types`` says more.

    The first separator that gives several columns is used. Rows with too many
    fields are skipped, short rows padded with NULL.
    """
    line = _header(spark, path)
    names, used = [], seps[-1]
    for sep in seps:
        names, used = _columns(line, sep), sep
        if len(names) > 1:
            break
    # One column more than the header: only rows that are too long fill it.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_too_long"]])
    rows = (spark.read.schema(schema).option("header", "true").option("enforceSchema", "true")
            .option("sep", used).option("encoding", ENCODING).option("mode", "PERMISSIVE").csv(path))
    rows = rows.where(F.col("_too_long").isNull()).drop("_too_long")
    casts = {c: F.col(c).try_cast(t) for c, t in (types or {}).items()}
    return rows.withColumns(casts) if casts else rows


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An array of records, or several such files."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def bounded_query(query: str, time: str | None = None, lower_bound=None, limit: int | None = None) -> str:
    """The user's SELECT, restricted to times from ``lower_bound`` on inside the database."""
    if lower_bound is not None:
        query = f"SELECT * FROM ({query}) AS T WHERE T.{time} >= '{lower_bound}'"
    return f"{query} LIMIT {int(limit)}" if limit else query


def jdbc_options(kind: str, query: str, server: str, database: str, user: str, password: str,
                 port: int | None = None, time: str | None = None, lower_bound=None,
                 limit: int | None = None, partitions: tuple | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source.

    ``partitions`` is (column, lower, upper, number): the read is then split into
    that many range queries instead of one.
    """
    prefix, default_port, driver = JDBC[kind]
    sql = bounded_query(query, time, lower_bound, limit)
    options = {"url": f"{prefix}://{server}:{port or default_port}/{database}", "driver": driver,
               "user": user, "password": password}
    if partitions is None:
        return options | {"query": sql}
    column, low, high, number = partitions
    return options | {"dbtable": f"({sql}) AS source", "partitionColumn": column,
                      "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(number)}


def read_jdbc(spark: SparkSession, kind: str, query: str, **connection) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, query, **connection)).load()


def bigquery_options(query: str, credentials: str, time: str | None = None, lower_bound=None,
                     limit: int | None = None, dataset: str | None = None) -> dict[str, str]:
    """Options of the BigQuery connector, which has to be on the class path."""
    options = {"query": bounded_query(query, time, lower_bound, limit),
               "credentialsFile": credentials, "viewsEnabled": "true"}
    return options | ({"materializationDataset": dataset} if dataset else {})


def read_bigquery(spark: SparkSession, query: str, credentials: str, **kw) -> DataFrame:
    return spark.read.format("bigquery").options(**bigquery_options(query, credentials, **kw)).load()


def since(df: DataFrame, time: str, date, inclusive: bool = True) -> DataFrame:
    """Rows from ``date`` on (``inclusive``) or after it; pushed down to the source."""
    if date is None:
        return df
    bound = F.lit(date)
    return df.where(F.col(time) >= bound if inclusive else F.col(time) > bound)


def preview(df: DataFrame, spec: SeriesSpec, n: int = 10) -> DataFrame:
    """The first ``n`` rows by time."""
    return df.orderBy(*spec.order).limit(n)


def coerce_time(df: DataFrame, time: str, formats=TIME_FORMATS) -> DataFrame:
    """Time as timestamp; text goes through the formats, a cell none fits is NULL.

    Whole numbers are dates (``20240102``) where they can be one, else seconds since 1970.
    """
    if isinstance(df.schema[time].dataType, T.StringType):
        text = F.trim(time)
        parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
        return df.withColumn(time, parsed)
    if isinstance(df.schema[time].dataType, (T.IntegerType, T.LongType)):
        date = F.try_to_timestamp(F.col(time).cast("string"), F.lit("yyyyMMdd"))
        seconds = F.col(time).cast("timestamp")
        return df.withColumn(time, F.when(F.col(time).between(*DATE_NUMBERS), F.coalesce(date, seconds)).otherwise(seconds))
    return df.withColumn(time, F.col(time).cast("timestamp"))


def bad_times(raw: DataFrame, time: str, formats=TIME_FORMATS) -> DataFrame:
    """One row: how many times were given and how many of them could not be read."""
    both = coerce_time(raw.select(F.col(time).alias("_given"), F.col(time)), time, formats)
    unread = (F.col("_given").isNotNull() & F.col(time).isNull()).cast("long")
    return both.agg(F.count("_given").alias("given"), F.coalesce(F.sum(unread), F.lit(0)).alias("unread"))


def coerce_feature(df: DataFrame, feature: str) -> DataFrame:
    """Feature as double; text that is no number and NaN become NULL."""
    value = F.col(feature)
    if isinstance(df.schema[feature].dataType, T.StringType):
        digits = F.regexp_replace(value, "(?<=[0-9])_(?=[0-9])", "")
        value = F.when(~digits.rlike(r"[0-9.][dDfF]\s*$"), digits)
    number = value.try_cast("double")
    return df.withColumn(feature, F.when(~F.isnan(number), number))
