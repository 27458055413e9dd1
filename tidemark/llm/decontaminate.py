"""Benchmark passages in training text: a broadcast hash set of test n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import word_runs, words

WINDOW = 13
#: A document is contaminated from this share of hit words on: one in so many.
ONE_IN = 20
#: So many windows (of a few hundred bytes) are broadcast; more of them are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The windows of the test items: hash, length, gram, item_id. An item with fewer words is one window; one without words, none."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("_words"))
    items = items.filter(F.size("_words") > 0).withColumn("_length", F.least(F.size("_words"), F.lit(window)))
    runs = word_runs(items, "_words", list(range(1, window + 1)), "item_id", "_length").filter("length = _length")
    return runs.select("hash", "length", F.expr("slice(_words, pos + 1, length)").alias("gram"), "item_id").distinct()


def _hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """Per document with a hit: id, text_key, spans (sorted, distinct), items (distinct)."""
    grams = item_windows(benchmark, item_id, item_text, window)
    found = grams.groupBy("length").count().collect()  # at most `window` rows
    lengths = sorted(r["length"] for r in found) or [window]
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), words(F.col(text)).alias("_words"))
    places = word_runs(base, "_words", lengths, "id", "text_key")
    same = (places.hash == grams.hash) & (places.length == grams.length)
    verified = F.slice("_words", F.col("pos") + F.lit(1), F.col("span_length")) == F.col("gram")
    places = places.withColumn("span_length", F.col("length"))
    if sum(r["count"] for r in found) <= BROADCAST_WINDOWS:
        hit = places.join(F.broadcast(grams), same & verified)
    else:  # only ids and hashes are shuffled; the few that meet are verified in their documents
        met = places.drop("_words").join(grams.hint("merge"), same).select("id", "text_key", "pos", "span_length", "gram", "item_id")
        texts = base.select(F.col("id").alias("own_id"), F.col("text_key").alias("own_key"), "_words")
        hit = met.join(texts, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).filter(verified)
    hit = hit.select("id", "text_key", F.struct("pos", F.col("span_length").alias("length")).alias("span"), "item_id")
    return hit.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a.end, s.pos + s.length).alias("end"),
        (a.covered + F.greatest(F.lit(0), s.pos + s.length - F.greatest(a.end, s.pos))).alias("covered")),
        lambda a: a.covered.cast("long"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Every window of ``window`` words of every document is looked up in the broadcast windows of the test items;
    a hash that is met is verified word for word. A word inside any hit is hit; a document is
    contaminated when it has one and at least one word in ``one_in`` is hit. A null text has no words. Rows that repeat
    an id and text get equal rows. Without items or documents nothing is hit. Other columns are ignored.
    """
    hits = _hits(docs, benchmark, doc_id, text, item_id, item_text, window)
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"),
                       F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = base.alias("b").join(hits.alias("h"), F.col("b.id").eqNullSafe(F.col("h.id")) & (F.col("b.text_key") == F.col("h.text_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.select(F.col("b.id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The documents without the contaminated ones (``mode="documents"``), or all of them with the hit words taken
    out (``mode="spans"``: a document with a hit becomes its other words in lower case, joined by blanks). All columns stay.
    """
    hits, rows = _hits(docs, benchmark, doc_id, text, item_id, item_text, window), docs.alias("d")
    own, said = F.col(f"d.{doc_id}"), F.col(f"d.{text}")
    met = own.eqNullSafe(F.col("h.id")) & (F.xxhash64(said) == F.col("h.text_key"))
    if mode == "spans":
        inside = F.flatten(F.transform("h.spans", lambda s: F.sequence(s.pos, s.pos + s.length - 1)))
        rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(words(said)) - 1), inside), lambda i: F.get(words(said), i))
        cut = F.when(F.col("h.spans").isNull(), said).otherwise(F.array_join(rest, " "))
        return rows.join(hits.alias("h"), met, "left").select(*[(cut if c == text else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
    n = F.size(words(said))
    bad = hits.withColumn("covered", _covered(F.col("spans"))).drop("spans")
    # Only documents with a hit are judged, so the word count is taken from the few that meet one.
    return rows.join(bad.alias("h"), met & (F.lit(one_in) * F.col("h.covered") >= n), "left_anti")
