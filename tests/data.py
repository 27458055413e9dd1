"""Small series for the tests: columns g, t, y, id."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from tidemark.spec import SeriesSpec

SPEC = SeriesSpec("t", "y", "g", "id")
ALONE = SeriesSpec("t", "y", (), "id")
START = datetime(2021, 1, 1)


def frame(spark, rows, parts=3):
    """Rows (g, seconds since START, y); ids count up."""
    data = [(g, START + timedelta(seconds=float(s)), None if y is None else float(y), i)
            for i, (g, s, y) in enumerate(rows)]
    return spark.createDataFrame(data, "g string, t timestamp, y double, id long").repartition(parts)


def from_arrays(spark, g, seconds, y, parts=3):
    pdf = pd.DataFrame({"g": g, "t": pd.Timestamp(START) + pd.to_timedelta(seconds, unit="s"),
                        "y": np.asarray(y, float), "id": np.arange(len(y))})
    return spark.createDataFrame(pdf, "g string, t timestamp, y double, id long").repartition(parts)


def noisy(spark, n=400, seed=0, series=("a", "b"), gap=60, nulls=0.0, parts=3):
    rng = np.random.default_rng(seed)
    out = []
    for g in series:
        y = 50 + rng.normal(0, 5, n)
        y[rng.random(n) < nulls] = np.nan
        out += [(g, i * gap, None if np.isnan(v) else v) for i, v in enumerate(y)]
    return frame(spark, out, parts)


def by_id(df, *columns):
    return df.select("id", *columns).toPandas().sort_values("id").reset_index(drop=True)
