"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes (a space and the text). Every token points to the farthest-right token that it overlaps, or to itself
where that one ends at the same byte; following pointers, all tokens between two common ends reach the same last token. Pointers of
a whole batch are doubled at once (succ = succ[succ]) until nothing changes; the token reached labels the group.

Neither tokenizer merges across a single space between two other characters, so a text is the chain of its words, each with the space before it,
and each distinct word is tokenized and aligned once in a worker and kept. Texts with any other use of spaces are aligned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import byte_characters
from tidemark.session import materialize

#: Words kept by each Python worker (some 300 bytes each), and the bytes that their group texts may take.
KEPT_WORDS, KEPT_BYTES = 400_000, 64 << 20
#: Texts are worked on in pieces of about so many characters.
PIECE = 4 << 20
#: Words are handed to the tokenizers in texts of about so many characters.
JOINED = 4096
#: So many of the most frequent pairs are broadcast (some 64 bytes each); rarer ones are joined by a shuffle.
BROADCAST_PAIRS = 500_000

TOKENS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokenizer:
    """A byte-level vocabulary of the ``tokenizers`` library; special tokens in a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_characters().items()}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for token, at in entries.items():
            self.bytes[at] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTokenizer:
    """A ``sentencepiece`` model that puts a space before the text and writes what it does not know as bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(self.model.id_to_piece(k)[1:-1], 16)]) if self.model.is_byte(k) else
                      self.model.id_to_piece(k).replace("▁", " ").encode() for k in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def successors(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The farthest-right token that each token overlaps, or itself where none reaches farther; A's tokens come first, then B's."""
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    here = np.arange(len(a_ends))
    return np.concatenate([np.where(b_ends[to_b] > a_ends, len(a_ends) + to_b, here), to_a]) if len(here) else here


def jump(succ: np.ndarray) -> np.ndarray:
    """Where each pointer ends, by doubling."""
    while True:
        twice = succ[succ]
        if np.array_equal(twice, succ):
            return succ
        succ = twice


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) whose bytes overlap, in order."""
    starts = np.concatenate([[0], a_ends[:-1]]) if len(a_ends) else a_ends
    first = np.searchsorted(b_ends, starts, "right")
    n = np.searchsorted(b_ends, a_ends) - first + 1
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + first[a]


def _grown(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.concatenate([old, new.astype(old.dtype)])


class Aligned:
    """Aligned strings: counts, group texts and linked pairs of each, the pairs as runs of one array."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        size = max(len(a.bytes), len(b.bytes))
        self.size, self.wide = len(b.bytes), size
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        self.written = [f"{k}{end}" for end in (",", "|", ";") for k in range(size)]
        self.digits = np.array([len(str(k)) + 1 for k in range(size)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.whole = np.zeros(0, bool)  # not aligned on its own
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.ends, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keeps the older half of a full store: common words come early."""
        if len(self.at) > KEPT_WORDS or sum(map(len, self.groups)) > KEPT_BYTES:
            n = len(self.at) // 2
            if sum(map(len, self.groups[:n])) > KEPT_BYTES // 2:
                return self.clear()
            self.at, self.groups = dict(islice(self.at.items(), n)), self.groups[:n]
            self.whole, self.counts, self.ends = self.whole[:n], self.counts[:n], self.ends[: n + 1]
            self.pairs = self.pairs[: self.ends[-1]]

    def add(self, words: list[str], joined: bool) -> None:
        """Aligns ``words``; with ``joined`` many are tokenized as one text, without, each is a text."""
        if joined:
            fit = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and "▁" not in w]
            texts, now, size = [], [], 0
            for w in fit:
                now.append(w)
                size += len(w) + 1
                if size >= JOINED:
                    texts.append(now)
                    now, size = [], 0
            texts += [now] if now else []
        else:
            texts = [[w] for w in words]
        good, a_ids, b_ids = self._tokenize(texts)
        if joined:  # words of a text that did not come out are tried alone
            alone = [[w] for k, t in enumerate(texts) if not good[k] and len(t) > 1 for w in t]
            more = self._tokenize(alone)
            texts, good, a_ids, b_ids = texts + alone, good + more[0], a_ids + more[1], b_ids + more[2]
        chosen = [k for k, ok in enumerate(good) if ok]
        done = [w for k in chosen for w in texts[k]]
        self._align(done, [a_ids[k] for k in chosen], [b_ids[k] for k in chosen])
        bad = [w for w in words if w not in self.at]
        for w in bad:
            self.at[w] = len(self.at)
        self.groups += [""] * len(bad)
        self.whole = _grown(self.whole, np.ones(len(bad), bool))
        self.counts = np.concatenate([self.counts, np.zeros((len(bad), 4), np.int64)])
        self.ends = _grown(self.ends, np.full(len(bad), self.ends[-1]))

    def _tokenize(self, texts: list[list[str]]) -> tuple[list[bool], list, list]:
        """For each text of words whether both tokenizers give its bytes, and cut at each word's end; and the ids."""
        plain = [" ".join(t) for t in texts]
        a_ids, b_ids, good = self.a.encode(plain), self.b.encode(plain), []
        for words, text, a, b in zip(texts, plain, a_ids, b_ids, strict=True):
            want = b" " + text.encode()
            same = b"".join(map(self.a.bytes.__getitem__, a)) == want and b"".join(map(self.b.bytes.__getitem__, b)) == want
            if same and len(words) > 1:
                ends = np.cumsum([len(w.encode()) + 1 for w in words])
                same = all(np.isin(ends, np.cumsum(n[ids])).all() for n, ids in ((self.a_len, a), (self.b_len, b)))
            good.append(same)
        return good, a_ids, b_ids

    def _align(self, words: list[str], a_ids: list, b_ids: list) -> None:
        if not words:
            return
        n_a, n_b = sum(map(len, a_ids)), sum(map(len, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        stops = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        label = jump(successors(a_ends, b_ends))
        # Tokens by group, A's before B's; the last one of a side or group is written with another mark.
        order = np.lexsort((np.arange(n_a + n_b) >= n_a, label))
        side, grouped, ids = order >= n_a, label[order], np.concatenate([a, b])[order]
        last = np.ones(len(order), bool)
        last[:-1] = (grouped[1:] != grouped[:-1]) | (side[1:] != side[:-1])
        text = "".join(map(self.written.__getitem__, (ids + self.wide * np.where(last, 1 + side, 0)).tolist()))
        terminal = np.flatnonzero(last & side)
        word_of_group = np.searchsorted(stops, a_ends[grouped[terminal]])
        cut = np.cumsum(self.digits[ids])[terminal]
        groups = np.bincount(word_of_group, minlength=len(words))
        cut = np.concatenate([[0], cut[np.cumsum(groups) - 1]]).tolist()
        link_a, link_b = overlaps(a_ends, b_ends)
        links = np.bincount(np.searchsorted(stops, a_ends)[link_a], minlength=len(words))
        tokens = [np.bincount(np.searchsorted(stops, e), minlength=len(words)) for e in (a_ends, b_ends)]
        for w in words:
            self.at[w] = len(self.at)
        self.groups += [text[x : y - 1] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        self.whole = _grown(self.whole, np.zeros(len(words), bool))
        self.counts = np.concatenate([self.counts, np.stack([*tokens, groups, links], 1)])
        self.pairs = _grown(self.pairs, a[link_a] * self.size + b[link_b])
        self.ends = _grown(self.ends, self.ends[-1] + np.cumsum(links))

    def documents(self, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For texts that are not empty: whether one must be aligned whole, counts, groups; and (ends of runs, pairs, times)."""
        words = [t.split(" ") if joined else [t] for t in texts]
        flat = list(chain.from_iterable(words))
        if missing := [w for w in dict.fromkeys(flat) if w not in self.at]:
            self.add(missing, joined)
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        n = np.fromiter(map(len, words), np.int64, len(words))
        doc, starts = np.repeat(np.arange(len(words)), n), np.cumsum(n) - n
        if not len(words):
            return np.zeros(0, bool), np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 2
        whole = np.logical_or.reduceat(self.whole[at], starts)
        counts = np.add.reduceat(self.counts[at], starts)
        groups = [";".join(map(self.groups.__getitem__, at[s : s + k].tolist())) for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
        key, often = np.unique(doc * len(self.at) + at, return_counts=True)
        owner, word = np.divmod(key, len(self.at))
        size = self.ends[word + 1] - self.ends[word]
        source = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[word], size)
        span = len(self.a.bytes) * self.size
        linked = np.repeat(owner, size) * span + self.pairs[source]
        key, inverse = np.unique(linked, return_inverse=True)
        times = np.bincount(inverse, np.repeat(often, size), len(key)).astype(np.int64)
        owner, pairs = np.divmod(key, span)
        ends = np.searchsorted(owner, np.arange(len(words) + 1))
        return whole, counts, groups, ends, pairs, times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligned:
    """One store for each worker process and pair of files."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligned(ByteTokenizer(path_a), PieceTokenizer(path_b))


def _rows(store: Aligned, texts: list[str | None]) -> tuple[np.ndarray, list[str], pa.Array, pa.Array]:
    """Counts, group texts, pairs and times of one piece of rows."""
    own = [k for k, t in enumerate(texts) if t]
    counts, groups = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    parts: list = [None] * len(texts)
    store.trim()
    for joined in (True, False):
        some = store if joined else Aligned.__new__(Aligned)
        if not joined:  # texts aligned whole are not kept
            some.__dict__.update(store.__dict__)
            some.clear()
        whole, n, written, ends, pairs, times = some.documents([texts[k] for k in own], joined)
        for j, k in enumerate(own):
            if not whole[j]:
                counts[k], groups[k] = n[j], written[j]
                parts[k] = (pairs[ends[j] : ends[j + 1]], times[ends[j] : ends[j + 1]])
        own = [k for j, k in enumerate(own) if whole[j]]
    empty = np.zeros(0, np.int64)
    sizes = np.array([0 if p is None else len(p[0]) for p in parts], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([empty, *[p[x] for p in parts if p is not None]]))) for x in (0, 1)]
    return counts, groups, *lists


def align_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
                 with_groups: bool = False) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, the linked id pairs and how many links
    each has; with ``with_groups`` also the groups as text, A ids, `|`, B ids, groups parted by `;`.

    A pair is a * (size of B's vocabulary) + b. Texts that are null or empty, or that either tokenizer does not give back byte by byte after a
    space, have zeros, no pairs and an empty text in place of the hash. Other columns are ignored; an empty table gives no row.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]
    schema = TOKENS + (", groups string" if with_groups else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, store = TaskContext.get().partitionId() << 40, aligner(path_a, path_b)
        for part in parts:
            ids, texts, at = part.column(0), part.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < PIECE:
                    size += len(texts[end] or "")
                    end += 1
                counts, groups, pairs, times = _rows(store, texts[at:end])
                hashed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = [pa.array(np.arange(number, number + end - at)), ids.slice(at, end - at),
                           *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(4)], pa.array(hashed, pa.string()), pairs, times]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(groups, pa.string())] if with_groups else []),
                                                 names=[c.split()[0] for c in schema.split(", ")])
                number, at = number + end - at, end

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best): how many documents hold each pair linked, and whether no other pair of the same A id has more.

    Counted with partial sums; a row per distinct pair of ids meets its A id's maximum, never a row per document.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("pair", F.call_function("div", F.col("pair"), F.lit(size_b).cast("long")).alias("a"),
                           (F.col("pair") % size_b).alias("b"), "n")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) over the links of each document that has any. Read both tables from storage.

    The most frequent pairs, as many as ``broadcast_pairs`` allows by powers of two of their counts, are broadcast; the others, which are rare one by
    one, meet by a shuffle.
    """
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("pairs"))
    least, common, rare = 64, 0, 0
    for power, pairs in sorted(((r.power, r.pairs) for r in sizes.collect()), reverse=True):  # at most 63 rows
        if rare or common + pairs > broadcast_pairs:
            rare += pairs
        else:
            least, common = power, common + pairs
    slim, cut = counts.select("pair", "n", "best"), float(2.0**least)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.times")
    often = slim.filter(F.col("n") >= cut)
    found = links.join(F.broadcast(often), "pair") if common else None
    if rare:
        others = links.join(F.broadcast(often.select("pair")), "pair", "left_anti") if common else links
        others = others.join(slim.filter(F.col("n") < cut).hint("merge"), "pair")
        found = found.unionByName(others) if found is not None else others
    if found is None:
        found = links.join(slim, "pair")
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def alignment_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
                     broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The aligned documents and the counts of pairs are written once to the shared folder. Rows that repeat a doc_id are documents of their own,
    in the counts too.
    """
    path_b = path_b or default_paths()[1]
    aligned = materialize(align_tokens(docs, doc_id, text, path_a, path_b), "aligned")
    counts = materialize(pair_counts(aligned, len(PieceTokenizer(path_b).bytes)), "pairs")
    sums = link_sums(aligned, counts, broadcast_pairs)
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                                                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
