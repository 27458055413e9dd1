"""Passages that documents share: anchored segments, met in bounded shards.

A window is ``window`` consecutive words. Its anchor is the run of ``ANCHOR`` words with the smallest hash inside it, so equal windows have
equal anchors; the consecutive windows of a document with one anchor make a segment. Segments meet by the
anchor's hash. Segments with one hash are grouped first (with partial aggregation, so a passage in any number of documents sends one
row a task). Of each group the words of its smallest and of its largest document go to the operator's own index, with all other groups of the anchor,
and what the index finds for them decides: for the smallest document its own runs, for the others those of the largest. An anchor with more
words in such holders than a shard may hold is taken apart into its windows; those meet by anchor and own hash, and the index
compares the words of two holders of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.session import materialize

WINDOW = 50
ANCHOR = 16
#: An index takes anchors until it has so many words.
SHARD_WORDS = 400_000
#: Stands for a null doc_id: smaller than any other.
NO_ID = -(1 << 63)

SEGMENTS = "m long, s long, id long, spot long, length int"
#: words of the shard, segment starts (and the end), document of each segment, anchor place of each segment, window ->
#: for every window of every segment the smallest document that has it
Shard = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]]


def _segments(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """text number, first word (of the text), length in words, anchor hash and own hash of each segment."""
    starts, ends, words = bt.spans(data, offsets, bt.BLANK)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none.view(bt.U), none.view(bt.U)
    hashed = bt.hashes(data, starts, ends)
    grams = bt.run_hashes(hashed, anchor)
    spread = window - anchor + 1
    at = sliding_window_view(grams, spread).argmin(1) + np.arange(len(grams) - spread + 1)
    text = np.searchsorted(words, np.arange(len(at)), "right") - 1
    inside = np.flatnonzero(np.arange(len(at)) + window <= words[text + 1])
    if not len(inside):
        return none, none, none, none.view(bt.U), none.view(bt.U)
    at, text = at[inside], text[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    begin, length = inside[first], inside[last] + window - inside[first]
    prefix = np.zeros(len(hashed) + 1, bt.U)
    np.cumsum(bt.mix(hashed + bt.U(11)) * bt._power("up", bt._BASE, len(hashed)), out=prefix[1:])
    own = bt.mix((prefix[begin + length] - prefix[begin]) * bt._power("down", bt._UNBASE, len(hashed))[begin] + length.astype(bt.U))
    return text[first], begin - words[text[first]], length, grams[at[first]], own


def _text_key(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def anchored_segments(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """All segments of (id, text): anchor hash m, own hash s, id, spot (text key and first word) and length."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in bt.pieces(part.column(1)):
                text, begin, length, m, s = _segments(data, offsets, window, anchor)
                raw = data.tobytes()
                keys = np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(s.view(np.int64)), pa.array(ids[row + text].astype(np.int64)),
                     pa.array((keys[text] << 31) + begin), pa.array(length.astype(np.int32))], names=["m", "s", "id", "spot", "length"])

    return rows.mapInArrow(run, SEGMENTS)


def anchored_windows(rows: DataFrame, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """Every window of the segments whose anchor is in ``hot`` (sorted): m, own hash s, id, spot and length, as a segment of its own."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in bt.pieces(part.column(1)):
                text, begin, length, m, _ = _segments(data, offsets, window, anchor)
                some = np.flatnonzero(np.isin(m.view(np.int64), hot))
                if not len(some):
                    continue
                starts, ends, words = bt.spans(data, offsets, bt.BLANK)
                own = bt.run_hashes(bt.hashes(data, starts, ends), window).view(np.int64)
                raw = data.tobytes()
                keys = np.zeros(len(offsets) - 1, np.int64)
                for k in np.unique(text[some]):
                    keys[k] = zlib.crc32(raw[offsets[k] : offsets[k + 1]])
                count = length[some] - window + 1
                which = np.repeat(some, count)
                first = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[which].view(np.int64)), pa.array(own[words[text[which]] + first]), pa.array(ids[row + text[which]].astype(np.int64)),
                     pa.array((keys[text[which]] << 31) + first), pa.array(np.full(len(which), window, np.int32))], names=["m", "s", "id", "spot", "length"])

    return rows.mapInArrow(run, SEGMENTS)


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of the wanted segments, one row each: m, s, id, text."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("m", "s", "spot", "length")).alias("segments"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for key, text, segments in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                own, words = _text_key(text), (text or "").encode().split()
                out += [(x["m"], x["s"], key, b" ".join(words[(x["spot"] & 0x7FFFFFFF) : (x["spot"] & 0x7FFFFFFF) + x["length"]]).decode())
                        for x in segments if x["spot"] >> 31 == own]
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["m", "s", "id", "text"])

    return rows.join(lists, "id").select("id", "text", "segments").mapInArrow(run, "m long, s long, id long, text string")


def _compared(fetched: DataFrame, shard: Shard, window: int, anchor: int, shard_words: int, by: tuple[str, ...] = ("m",)) -> DataFrame:
    """For every segment the runs of windows that a smaller document has: m, s, id, runs of (from, to, by) in words of the segment.

    Segments that agree on ``by`` meet in one index.
    """
    runs = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("by", pa.int64())]))

    def solve(held: list) -> pa.RecordBatch:
        hashed = np.concatenate([h for _, _, _, h in held])
        bounds = np.concatenate([[0], np.cumsum([len(h) for _, _, _, h in held])])
        ids = np.array([x[2] for x in held], np.int64)
        grams = bt.run_hashes(hashed, anchor).view(np.int64)
        places = np.array([int((grams[a : b - anchor + 1] == m).argmax()) for (m, _, _, _), a, b in zip(held, bounds[:-1], bounds[1:], strict=True)])
        rows = []
        for (m, s, own, _), least in zip(held, shard(hashed, bounds, ids, places, window), strict=True):
            some = np.flatnonzero(least < own)
            if len(some):
                cut = np.flatnonzero(np.diff(some) > 1) + 1
                rows.append((m, s, own, [{"from": int(x[0]), "to": int(x[-1]) + window, "by": int(least[x].min())} for x in np.split(some, cut)]))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], runs)], names=["m", "s", "id", "runs"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, now = [], 0, None
        for part in parts:
            keys = [part.column(k).to_pylist() for k in range(3)]
            for row, data, offsets in bt.pieces(part.column(3)):
                starts, ends, counts = bt.spans(data, offsets, bt.BLANK)
                hashed = bt.hashes(data, starts, ends)
                for k in range(len(offsets) - 1):
                    m, s, own = (x[row + k] for x in keys)
                    key = (m, s)[: len(by)]
                    if key != now and words >= shard_words:
                        yield solve(held)
                        held, words = [], 0
                    now = key
                    held.append((m, s, own, hashed[counts[k] : counts[k + 1]]))
                    words += counts[k + 1] - counts[k]
        if held:
            yield solve(held)

    dealt = fetched.repartition(*by).sortWithinPartitions("m", "s", "id")
    return dealt.mapInArrow(run, "m long, s long, id long, runs array<struct<`from`:int,`to`:int,by:long>>")


def shared_spans(docs: DataFrame, shard: Shard, doc_id: str, text: str, window: int = WINDOW, anchor: int = ANCHOR,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """Spans of words in windows that a smaller document has too: id, key (of the text), first, last (excluded), by (a smaller document)."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    segments = anchored_segments(rows, window, anchor)
    distinct = segments.groupBy("m", "s").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("spot", "id").alias("spot"),
                                              F.max_by("spot", "id").alias("last_spot"), F.max("length").alias("length"))
    met = Window.partitionBy("m")
    several = F.min("first").over(met) < F.max("first").over(met)
    held = F.sum(F.col("length") * F.when(F.col("first") < F.col("last"), 2).otherwise(1)).over(met)
    found = distinct.withColumns({"several": several, "words": held}).filter("several OR first < last").drop("several")
    found = materialize(found, "segments")
    large = found.groupBy("m").agg(F.max("words").alias("words")).filter(F.col("words") > shard_words)
    # At most one anchor for every `shard_words` words of segments.
    hot = np.sort(np.array([r.m for r in large.select("m").collect()], np.int64))
    if len(hot):
        found = found.join(F.broadcast(large.select("m")), "m", "left_anti")
    holder = F.struct(F.col("first").alias("id"), F.col("spot").alias("at"))
    other = F.struct(F.col("last").alias("id"), F.col("last_spot").alias("at"))
    holders = found.select("m", "s", "length", F.inline(F.when(F.col("first") < F.col("last"), F.array(holder, other)).otherwise(F.array(holder))))
    compared = _compared(_fetched(rows, holders.withColumnRenamed("at", "spot")), shard, window, anchor, shard_words)
    compared = materialize(compared, "compared")
    named = compared.join(found.select("m", "s", "first"), ["m", "s"])
    told = named.groupBy("m", "s", "first").agg(F.first(F.when(F.col("id") == F.col("first"), F.col("runs")), True).alias("runs"),
                                                F.first(F.when(F.col("id") > F.col("first"), F.col("runs")), True).alias("copied"))
    own = F.when(F.col("id") > F.col("first"), F.col("copied")).otherwise(F.col("runs"))
    hit = segments.join(told, ["m", "s"]).select("id", "spot", F.explode(own).alias("r"))
    if len(hot):
        hit = hit.unionByName(_hot_hits(rows, hot, shard, window, anchor, shard_words))
    begin = F.col("spot").bitwiseAND(F.lit(0x7FFFFFFF))
    return hit.select("id", F.shiftright("spot", 31).alias("key"), (begin + F.col("r.from")).alias("first"), (begin + F.col("r.to")).alias("last"), F.col("r.by").alias("by"))


def _hot_hits(rows: DataFrame, hot: np.ndarray, shard: Shard, window: int, anchor: int, shard_words: int) -> DataFrame:
    """The windows at the ``hot`` anchors that a smaller document has: id, spot, r (from, to, by).

    Of each window that several documents have, its smallest and its largest document send their words to the index, which decides.
    """
    windows = anchored_windows(rows, window, anchor, hot)
    shared = windows.groupBy("m", "s").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("spot", "id").alias("spot"),
                                           F.max_by("spot", "id").alias("last_spot")).filter("first < last")
    shared = materialize(shared, "windows")
    ends = F.inline(F.array(F.struct(F.col("first").alias("id"), "spot"), F.struct(F.col("last").alias("id"), F.col("last_spot").alias("spot"))))
    wanted = shared.select("m", "s", F.lit(window).alias("length"), ends)
    compared = materialize(_compared(_fetched(rows, wanted), shard, window, anchor, shard_words, ("m", "s")), "compared")
    told = compared.select("m", "s", F.col("runs")[0]["by"].alias("by")).distinct()
    r = F.struct(F.lit(0).alias("from"), F.col("length").alias("to"), "by")
    return windows.join(told, ["m", "s"]).filter("id > by").select("id", "spot", r.alias("r"))
