"""Text helpers made of built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does just that where every character is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def without_blanks(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank))
    return text


def word_runs(df: DataFrame, word_list: str, lengths: list[int], *keep: str) -> DataFrame:
    """One row for every run of ``lengths`` consecutive words: ``keep``, the word list, pos (from 0), length and hash.

    ``posexplode_outer`` is used as Spark adds a filter on the array's size to the inner form, in which the splitting
    into words is written out and run once more.
    """
    placed = df.select(*keep, word_list, F.posexplode_outer(word_list).alias("pos", "_word")).filter("_word IS NOT NULL")
    run = [F.struct(F.lit(n).alias("length"), F.xxhash64(F.slice(word_list, F.col("pos") + 1, F.lit(n))).alias("hash"))
           for n in lengths]
    placed = placed.select(*keep, word_list, "pos", F.explode(F.array(*run)).alias("_run")) if len(run) > 1 else \
        placed.withColumn("_run", run[0])
    return placed.select(*keep, word_list, "pos", "_run.length", "_run.hash").filter(F.col("pos") + F.col("length") <= F.size(word_list))
