"""Calendar parts of a time column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar parts from coarse to fine.
PARTS = ("year", "quarter", "month", "week", "week_part", "week_day", "day_part",
         "hour", "min", "second")

# First hour after each part of the day, and its name.
DAY_PARTS = ((7, "night"), (12, "morning"), (17, "afternoon"), (21, "evening1"), (24, "evening2"))


def date_part(time: Column | str, part: str) -> Column:
    """Calendar part ``part`` of a time; text for ``quarter`` and ``day_part``."""
    t = F.col(time) if isinstance(time, str) else time
    if part == "quarter":
        return F.concat(F.lit("Q"), F.quarter(t), F.lit("_"), F.year(t))
    if part == "day_part":
        names = F.lit(None)
        for end, name in reversed(DAY_PARTS):
            names = F.when(F.hour(t) < end, name).otherwise(names)
        return names
    if part == "week_part":
        return F.when(F.weekday(t) >= 5, 1).otherwise(0)
    if part == "week_day":
        return F.weekday(t) + 1
    simple = {"year": F.year, "month": F.month, "week": F.weekofyear, "hour": F.hour,
              "min": F.minute, "second": F.second}
    return simple[part](t)
