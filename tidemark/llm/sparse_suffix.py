"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import passages


def _sorted_contexts(words: np.ndarray, place: np.ndarray, room: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse suffix array over ``place``: order of the contexts (``depth`` words on by ``step``), and how many words
    neighbours in that order agree on. Past ``room`` words a context ends with a number of its own.
    """
    reach = np.arange(depth)
    at = np.clip(place[:, None] + step * reach, 0, len(words) - 1)
    own = len(words) + np.arange(len(place))
    context = np.where(reach < room[:, None], words[at], own[:, None]).astype(">u4")
    order = np.argsort(context.view(np.dtype((np.void, 4 * depth))).ravel(), kind="stable")
    differ = context[order][1:] != context[order][:-1]
    agree = np.where(differ.any(1), differ.argmax(1), depth) if depth else np.zeros(max(0, len(place) - 1), np.int64)
    return order, agree


def smallest_holders(hashed: np.ndarray, bounds: np.ndarray, ids: np.ndarray, places: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment and each of its windows, the smallest document among the shard's segments that hold it.

    Only the suffix at each segment's anchor is kept. The suffixes are sorted to the right and, read backwards, to the left; comparing
    neighbours gives the words that they agree on. A window with its anchor ``a`` words in is held by the
    suffixes that agree with it on ``window - a`` words to the right and on ``a`` words to the left.
    """
    _, words = np.unique(hashed, return_inverse=True)
    n, sizes, anchor = len(ids), np.diff(bounds), bounds[:-1] + places
    right, right_agree = _sorted_contexts(words, anchor, sizes - places, 1, window)
    left, left_agree = _sorted_contexts(words, anchor - 1, places, -1, window - 1)
    out = [np.full(max(0, size - window + 1), np.iinfo(np.int64).max) for size in sizes]
    right_group, left_group = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(places.max(initial=-1)) + 1):
        # the window that starts a words left of the anchor, where the segment has it
        some = np.flatnonzero((places >= a) & (places - a + window <= sizes))
        if not len(some):
            continue
        right_group[right] = np.concatenate([[0], np.cumsum(right_agree < window - a)])
        left_group[left] = np.concatenate([[0], np.cumsum(left_agree < a)])
        _, which = np.unique(right_group[some] * n + left_group[some], return_inverse=True)
        least = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[some])
        for k, value in zip(some.tolist(), least[which].tolist(), strict=True):
            out[k][places[k] - a] = value
    return out


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = passages.WINDOW, **settings) -> DataFrame:
    """One row per repeated passage: doc_id, first_word, n_words, other_doc_id.

    Words are separated by white space and unchanged. A passage is a longest run of words, each in a window of ``window`` words that a
    document with a smaller doc_id (such as other_doc_id) has too; the smallest document's own copy gives no
    row, nor do clean documents, null and short texts. A null doc_id is smaller than any other; rows that repeat a doc_id are one document. Other columns are
    ignored; an empty table gives no row.
    """
    spans = passages.shared_spans(docs, smallest_holders, doc_id, text, window, **settings)
    along = Window.partitionBy("id", "key").orderBy("first", "last")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.groupBy("id", "key", "first", "last").agg(F.min("by").alias("by"))
    runs = runs.withColumn("run", F.sum(F.when(F.col("first") <= reach, 0).otherwise(1)).over(along))
    merged = runs.groupBy("id", "key", "run").agg(F.min("first").alias("first_word"), F.max("last").alias("last"), F.min("by").alias("by"))
    none = passages.NO_ID
    return merged.select(F.expr(f"nullif(id, {none})").alias("doc_id"), "first_word", (F.col("last") - F.col("first_word")).alias("n_words"),
                         F.expr(f"nullif(by, {none})").alias("other_doc_id")).distinct()
