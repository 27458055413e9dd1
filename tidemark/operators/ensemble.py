"""Joining the detectors' outputs and voting."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import rows_are_unique
from tidemark.spec import SeriesSpec


class DuplicateTimes(ValueError):
    """A detector's output has several rows for one row of the series, or one without a time."""


def vote(labels: list[Column]) -> Column:
    """2 without models; the label of one; either of two; the majority of three."""
    if not labels:
        return F.lit(2)
    total = reduce(lambda a, b: a + b, labels)
    needed = 2 if len(labels) == 3 else 1
    return F.when(total >= needed, 1).otherwise(0)


def vote_present(df: DataFrame) -> DataFrame:
    """Add ``predicted_label`` from the label columns that exist."""
    present = [F.col(f"ad_label_{i}") for i in (1, 2, 3) if f"ad_label_{i}" in df.columns]
    return df.withColumn("predicted_label", vote(present))


def join_models(raw: DataFrame, models: dict[int, DataFrame | None], spec: SeriesSpec,
                fill_raw: bool = False, check: bool = True) -> DataFrame:
    """Left join each detector's rows on groups, time and, where both sides have its columns, ``tie``.

    Missing labels and scores become 0; ``predict`` stays NULL where nothing was
    predicted. ``fill_raw`` turns every missing number, also in the raw columns,
    into 0. Repeated keys would multiply rows, so they are refused unless
    ``check`` is off.
    """
    out = raw
    added: list[str] = []
    for number, model in sorted(models.items()):
        if model is None:
            continue
        own = spec if set(spec.tie) <= set(raw.columns) & set(model.columns) else replace(spec, tie=())
        if check and not rows_are_unique(model, own):
            raise DuplicateTimes(f"detector {number}: rows repeat within a series, or have no time")
        on = list(dict.fromkeys([*own.groups, *own.order]))
        names = [f"ad_label_{number}", f"anomaly_score_{number}"]
        extra = ["predict"] if "predict" in model.columns else []
        out = out.join(model.select(*on, *names, *extra), on, "left")
        added += names
    if fill_raw:
        return out.fillna(0)
    return out.fillna(0, subset=added) if added else out


def concat_series(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; a column missing in a part is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
