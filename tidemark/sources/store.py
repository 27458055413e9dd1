"""Results, models and run metadata as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reports import LATEST, latest
from tidemark.spec import SeriesSpec


def write_results(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """One partition per run date; the same date again replaces its partition only."""
    writer = df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_date").save(path)


def read_results(spark: SparkSession, path: str, spec: SeriesSpec, last: int | None = LATEST) -> DataFrame:
    """All runs together; the latest ``last`` rows by time, ascending."""
    rows = spark.read.parquet(path)
    return rows if last is None else latest(rows, spec, last)


def save_models(models: DataFrame, path: str, model: str) -> None:
    """The rows of one detector; other detectors' partitions are left alone."""
    (models.withColumn("model", F.lit(model)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path))


def load_models(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Models of all detectors, or the columns and rows of one."""
    if model is None:
        return spark.read.option("mergeSchema", "true").parquet(path)
    return spark.read.parquet(f"{path}/model={model}")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under ``path``, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def has_model(df: DataFrame, models: DataFrame, groups) -> DataFrame:
    """Rows of the series that have a model."""
    groups = list(groups)
    if not groups:
        return df if not models.isEmpty() else df.limit(0)
    return df.join(models.select(*groups).distinct(), groups, "left_semi")


def run_metadata(df: DataFrame, time: str, parts) -> DataFrame:
    """One row: first and last time as text to the second, and the accepted parts."""
    def text(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    return df.agg(text(F.min(time)).alias("min_date"), text(F.max(time)).alias("max_date")).withColumn(
        "time_groups", F.lit("*".join(parts)))


def save_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    """The saved row's values as a dict; ``split_date`` and ``read_from`` as times."""
    schema = "min_date string, max_date string, time_groups string, split_date string, read_from string"
    rows = spark.read.schema(schema).json(path)
    row = rows.withColumns({c: F.to_timestamp(c) for c in ("split_date", "read_from")}).first()
    return {k: v for k, v in row.asDict().items() if v is not None}
