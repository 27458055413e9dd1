"""License texts by diagonal voting of word k-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.native import word_runs, words

# The phrases that must be found, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices in their usual wording; found also where some words differ.
NOTICES = {
    "mit-notice": "Released under the MIT License.",
    **{f"apache-{v}-notice": f"Licensed under the Apache License, Version {v}." for v in ("1.0", "1.1", "2.0")},
    **{f"gpl-{v}.0-notice": f"This work is licensed under the GNU General Public License, version {v}." for v in "123"},
    **{f"lgpl-{v}-notice": f"This work is licensed under the GNU Lesser General Public License, version {v}." for v in ("2.1", "3.0")},
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    **{f"cc-by-nc-{v}-notice": f"Licensed under CC BY-NC {v}." for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files, to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or any later version",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                 "that the following conditions are met",
}


def _named(name: str, version: str, other: str = "") -> str:
    """Pattern: the name, then as the first version or number after it, at most three words on, ``version``. ``other`` words make it another license."""
    major, _, minor = version.partition(".")
    rest = f" {minor}" if minor not in ("", "0") else "(?! [1-9] )"
    return f" {name}(?: (?!(?:{other}version|v?[0-9]+) )[^ ]+){{0,3}} (?:version |v ?)?{major}{rest} "


# What the words of a place must show besides their share, as the share cannot tell versions and relatives apart.
MUST = {
    "mit-notice": " mit (?:expat |x11 |open |source |software )*license ",
    **{f"apache-{v}-notice": _named("apache license", v) for v in ("1.0", "1.1", "2.0")},
    **{f"gpl-{v}.0-notice": _named("gnu general public license", v) for v in "123"},
    **{f"lgpl-{v}-notice": _named("gnu lesser general public license", v) for v in ("2.1", "3.0")},
    "agpl-3.0-notice": _named("gnu affero general public license", "3"),
    **{f"cc-by-nc-{v}-notice": _named("cc by nc", v, "sa|nd|") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    # Other licenses have the same sentence; the name stands before it, or in the address after it.
    "apache-2.0-grant": " apache (?:license|org)(?: (?![0-9]+ )[^ ]+){0,3} 2(?! [1-9] ) ",
    "gpl-grant": " gnu general public license ",
}
#: Words of a k-gram; a shorter template is one k-gram.
GRAM = 4
#: Diagonals at most so far apart are one place: so many words more or less between two matching runs.
SLACK = 3
#: Share of a notice's words that must match.
SHARE = 0.7
#: Words before and after a place that are looked at for what it must show.
AROUND = 8


def templates(spark: SparkSession, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, gram: int = GRAM,
              must: dict[str, str] | None = None) -> DataFrame:
    """One row per k-gram of a template: hash, length (k), gram, template, label, base, must, at, size."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    must = MUST if must is None else must
    rows = [(label, text, True, None) for text, label in phrases.items()] + [(label, text, False, must.get(label)) for label, text in notices.items()]
    df = spark.createDataFrame(rows, "label string, text string, base boolean, must string")
    df = df.select("label", F.col("text").alias("template"), "base", "must", words(F.col("text")).alias("_words"))
    df = df.withColumn("size", F.size("_words")).filter("size > 0")
    runs = word_runs(df, "_words", list(range(1, gram + 1)), "label", "template", "base", "must", "size").filter(
        F.col("length") == F.least("size", F.lit(gram)))
    return runs.select("hash", "length", F.expr("slice(_words, pos + 1, length)").alias("gram"), "template", "label", "base",
                       "must", F.col("pos").alias("at"), "size")


def license_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
                   notices: dict[str, str] | None = None, gram: int = GRAM, slack: int = SLACK, share: float = SHARE,
                   must: dict[str, str] | None = None) -> DataFrame:
    """Verified places: id, text_key, label, base, start, end (words from 0, end excluded), score.

    Every k-gram of every document is joined to the templates' k-grams by hash and compared word for word. Matches
    are counted by (template, document position - template position); diagonals within ``slack`` merge. A phrase must
    match whole on one diagonal; of a notice, the share of matched words is the score, and the words at and around the place must
    match the label's pattern in ``must`` (such as its version), if it has one. The templates are a parameter
    of fixed size and are broadcast; the votes of one document meet in one group, which the document bounds.
    """
    grams = templates(docs.sparkSession, phrases, notices, gram, must)
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # at most `gram` rows
    grams = F.broadcast(grams)
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), words(F.col(text)).alias("_words"))
    places = word_runs(base, "_words", lengths, "id", "text_key")
    same = (places.hash == grams.hash) & (places.length == grams.length)
    verified = F.slice(places["_words"], places.pos + F.lit(1), places.length) == grams.gram
    begin = F.greatest(F.col("pos") - F.col("at") - AROUND, F.lit(0))
    around = F.slice(places["_words"], begin + 1, F.col("pos") - F.col("at") + F.col("size") + AROUND - begin)
    shown = F.when(F.col("must").isNotNull(), F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" ")))
    votes = places.join(grams, same & verified).groupBy(
        "id", "text_key", "template", "label", "base", "must", "size", grams.length, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.min(shown).alias("shown"))
    along = Window.partitionBy("id", "text_key", "template").orderBy("diagonal")
    near = ~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(along) <= slack)
    bands = votes.withColumn("band", F.sum(F.when(near, 0).otherwise(1)).over(along)).groupBy(
        "id", "text_key", "template", "label", "base", "must", "size", "length", "band").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.min("first").alias("start"), F.max(F.col("last") + F.col("length")).alias("end"),
        F.collect_list("shown").alias("shown"))
    matched = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("length") - 1)))))
    enough = F.when(F.col("base"), F.col("score") == 1.0).otherwise(
        (F.col("score") >= share) & (F.col("must").isNull() | F.exists("shown", lambda t: F.rlike(t, F.col("must")))))
    return bands.withColumn("score", matched / F.col("size")).filter(enough).select(
        "id", "text_key", "label", "base", "start", "end", "score")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns count the phrases' places; first and last are their smallest and largest start, null without one.
    The labels are distinct, sorted and joined by commas, empty if there are none. score is the best place's share of matched words, 0 without
    one. A null or empty text has no words. Rows that repeat an id and text get equal rows; other columns are ignored.
    """
    found = license_places(docs, doc_id, text, **settings)
    base = F.col("base")
    per = found.groupBy("id", "text_key").agg(
        F.count_distinct(F.when(base, F.struct("label", "start"))).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    every = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"),
                        F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = every.alias("b").join(per.alias("p"), F.col("b.id").eqNullSafe(F.col("p.id")) & (F.col("b.text_key") == F.col("p.text_key")), "left")
    none = F.lit("")
    return joined.select(F.col("b.id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                         "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"),
                         F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
