"""Repeated passages by a compressed FM-index for each shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import passages


class WaveletMatrix:
    """A sequence of small integers as packed bit levels with running counts; answers rank for many places at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n, self.levels = bits, len(values), []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -self.n % 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, ones, self.n - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places of the sequence put their occurrences of ``symbol`` in the last level."""
        for k, (packed, ones, zeros) in enumerate(self.levels):
            word = at >> 6
            low = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            rank = ones[word] + np.bitwise_count(low)
            at = np.where(symbol >> (self.bits - 1 - k) & 1 == 1, zeros + rank, at - rank)
        return at


class FMIndex:
    """Backward search over the words of a shard; the suffix array is not kept, only group borders at the asked length.

    ``below[g]`` is what a caller laid over the suffixes: see ``group_minimum``.
    """

    def __init__(self, text: np.ndarray, window: int):
        n, half = len(text), 1 << (window.bit_length() - 1)
        rank, step, ranks = text.astype(np.int64), 1, None
        while True:
            if step == half:
                ranks = rank
            if step >= window:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            rank, step = np.unique(key, return_inverse=True)[1], step * 2
        order = np.argsort(rank, kind="stable")
        # Two suffixes agree on `length` words when they agree on both halves' ranks, which overlap.
        def borders(length: int) -> np.ndarray:
            tail = np.minimum(order + length - half, n - 1)
            a, b = ranks[order], ranks[tail]
            return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])

        before = text[order - 1]
        self.n, self.bits = n, max(1, int(text.max(initial=0)).bit_length())
        self.bwt = WaveletMatrix(before, self.bits)
        symbols = np.arange(int(text.max(initial=0)) + 1)
        self.smaller = np.searchsorted(np.sort(text), symbols)
        self.origin = self.bwt.place(symbols, np.zeros(len(symbols), np.int64))
        start = np.flatnonzero(borders(window - 1))
        self.group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        self.start = np.append(start, n)
        whole = np.flatnonzero(borders(window))
        self.whole = np.repeat(np.arange(len(whole)), np.diff(np.append(whole, n)))
        self._whole_start, self._order = whole, order

    def group_minimum(self, values: np.ndarray) -> np.ndarray:
        """The least of ``values`` (one per place of the text) in each group of suffixes that agree on a window."""
        least = np.minimum.reduceat(values[self._order], self._whole_start)
        del self._order
        return least

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with ``symbol`` and go on as those in [lo, hi)."""
        base = self.smaller[symbol] - self.origin[symbol]
        return base + self.bwt.place(symbol, lo), base + self.bwt.place(symbol, hi)

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a whole window to its words but the last."""
        return self.start[self.group[lo]], self.start[self.group[hi - 1] + 1]


def smallest_holders(hashed: np.ndarray, bounds: np.ndarray, ids: np.ndarray, places: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment and each of its windows, the smallest document among the shard's segments that hold it.

    All segments are streamed through the index side by side, each from its last word to its first: one backward step a word. The
    matching statistic reaches ``window``, the suffixes found are looked at, and the last word is dropped again.
    """
    own, words = np.unique(hashed, return_inverse=True)
    sizes = np.diff(bounds)
    text = np.insert(words + 1, bounds[1:], 0)  # 0 ends a segment
    begin = bounds[:-1] + np.arange(len(sizes))
    index = FMIndex(text, window)
    least = index.group_minimum(np.repeat(ids, sizes + 1))
    out = [np.empty(max(0, size - window + 1), np.int64) for size in sizes]
    flat_at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    flat = np.empty(flat_at[-1], np.int64)
    live = np.arange(len(sizes))
    at, lo, hi, matched = begin + sizes - 1, np.zeros(len(sizes), np.int64), np.full(len(sizes), index.n), 0
    while len(live):
        lo, hi = index.step(text[at], lo, hi)
        matched += 1
        if matched == window:
            flat[flat_at[live] + at - begin[live]] = least[index.whole[lo]]
            lo, hi = index.shorten(lo, hi)
            matched -= 1
        going = at > begin[live]
        live, at, lo, hi = live[going], at[going] - 1, lo[going], hi[going]
    return np.split(flat, flat_at[1:-1])


def removal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = passages.WINDOW, **settings) -> DataFrame:
    """Spans of repeated windows: id, key, first, last, by. See ``passages.shared_spans``."""
    return passages.shared_spans(docs, smallest_holders, doc_id, text, window, **settings)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = passages.WINDOW, with_text: bool = False, **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text.

    Words are separated by white space and unchanged. A word goes when a window of ``window`` words around it also starts in a document
    with a smaller doc_id; what is left is joined by one blank. The smallest document keeps a passage, and
    windows are judged on the input. Null and short texts lose nothing. A null doc_id is smaller than any other; rows that repeat a
    doc_id are one document and do not remove each other's words. Other columns are ignored; an empty table gives no row.
    """
    spans = removal_spans(docs, doc_id, text, window, **settings).distinct().groupBy("id", "key").agg(
        F.collect_list(F.struct("first", "last")).alias("spans"))
    lists = spans.groupBy("id").agg(F.collect_list(F.struct("key", "spans")).alias("by_text"))  # a list for each text of the document

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for key, text, lists in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                words, gone = (text or "").encode().split(), 0
                mine = [x["spans"] for x in lists or [] if x["key"] == passages._text_key(text)] if lists else []
                kept = words
                if mine:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for span in mine[0]:
                        edge[span["first"]] += 1
                        edge[span["last"]] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    gone, kept = int(covered.sum()), [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                body = b" ".join(kept)
                rows.append((key, len(words), gone, hashlib.sha256(body).hexdigest(), body.decode())[: 4 + with_text])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + with_text]
            names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(passages.NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    out = rows.join(lists, "id", "left").select("id", "text", "by_text").mapInArrow(
        run, "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
    return out.withColumn("doc_id", F.expr(f"nullif(id, {passages.NO_ID})")).select("doc_id", *[c for c in out.columns if c != "id"])
