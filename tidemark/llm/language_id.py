"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt

#: Hash cells of the byte trigrams, for each language.
CELLS = 1 << 15
ROUNDS = 8
#: Prior count of every cell.
PRIOR = 0.5
NONE = "und"
COUNTS = "lang string, cell int, n long"


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters and the cell of the trigram around each; what is not a letter, and a text's end, count as a blank."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = bt.LETTER[data]
    low = np.where(letter, bt.LOWER[data], 32).astype(np.uint32)
    before, after = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = 32
    after[inner[inner > 0] - 1] = 32
    at = np.flatnonzero(letter)
    return at, _cells(before[at], low[at], after[at])


def _cells(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    code = (before << 16 | here << 8 | after) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64)


def _word_sums(table: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of the table's rows over the trigrams of each word, a run of letters with blanks around it."""
    size = ends - starts
    first = np.cumsum(size) - size
    letters = low[np.repeat(starts - first, size) + np.arange(size.sum())].astype(np.uint32)
    before, after = np.full(len(letters), 32, np.uint32), np.full(len(letters), 32, np.uint32)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    before[first] = after[first + size - 1] = 32
    return np.add.reduceat(table[_cells(before, letters, after)], first, axis=0)


def _across(rows: np.ndarray) -> np.ndarray:
    """The sum of the columns, which are few."""
    total = rows[:, 0].copy()
    for column in rows.T[1:]:
        total += column
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    """Log probabilities of the cells, one row per language (sorted)."""

    langs: list[str]
    table: np.ndarray

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions of the languages for each text; rows of zeros for texts without letters."""
        return self.fitted(data, offsets)[0]

    def fitted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages for each text, and what languages add over the background alone, in which every cell is equally
        likely: the log likelihood that words win in their best language, words that win nothing left to the background, less
        half the log of the number of words. Zeros for texts without letters.

        A word (a run of letters) is one draw from the mixture; its likelihood in a language is the product of its trigrams'.
        The proportions are estimated for all languages first. Then sets of the 1, 2, ... most frequent
        languages are fitted and the one with the best likelihood, less half the log of the number of words for
        each language, is taken.
        """
        n, k = len(offsets) - 1, len(self.langs)
        out, gain = np.zeros((n, k)), np.zeros(n)
        starts, ends, words = bt.spans(data, offsets, ~bt.LETTER)
        if not len(starts) or not k:
            return out, gain
        # Likelihoods depend on the word alone, so they are made once for each different word.
        names = bt.hashes(low := bt.LOWER[data], starts, ends)
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        ll = _word_sums(self.table, low, starts[one], ends[one])
        top = ll.max(1, keepdims=True)
        like, top = np.exp(np.maximum(ll - top, -60.0))[which], top[which, 0]
        full = np.flatnonzero(np.diff(words))
        first, many = words[full], np.diff(words)[full]

        def fit(start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            p = start
            for _ in range(rounds):
                joint = like * np.repeat(p, many, axis=0)
                joint /= (_across(joint) + 1e-300)[:, None]
                p = np.add.reduceat(joint, first, axis=0) / many[:, None]
            return p, np.add.reduceat(np.log(_across(like * np.repeat(p, many, axis=0)) + 1e-300), first)

        p, _ = fit(np.full((len(full), k), 1.0 / k), ROUNDS)
        rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
        best, chosen = np.full(len(full), -np.inf), p
        for size in range(1, k + 1):
            some = np.where(rank < size, np.maximum(p, 1e-12), 0.0)
            q, fitted = fit(some / some.sum(1, keepdims=True), 2 if size > 1 else 1)
            value = fitted - 0.5 * size * np.log(many + 1.0)
            better = value > best
            best, chosen = np.where(better, value, best), np.where(better[:, None], q, chosen)
        out[full] = chosen
        gain[full] = np.add.reduceat(np.maximum(top + (ends - starts) * np.log(CELLS), 0.0), first) - 0.5 * np.log(many + 1.0)
        return out, gain


def fit_languages(docs: DataFrame, rows: Column, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts the trigrams of all ``rows`` with a language, and makes the table: ``CELLS`` numbers for each language.

    Nothing is sampled. Every task adds up its counts before they are shuffled; what comes to the driver is one row
    per language and cell that occurs, whatever the number of documents.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            for row, data, offsets in bt.pieces(part.column(0)):
                at, cells = _trigrams(data, offsets)
                doc = np.searchsorted(offsets, at, "right") - 1
                names, which = np.unique(langs[row : row + len(offsets) - 1].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    total.setdefault(name, np.zeros(CELLS, np.int64))
                    total[name] += np.bincount(cells[which[doc] == k], minlength=CELLS)
        for name, cells in total.items():
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()),
                                              pa.array(cells[some], pa.int64())], names=["lang", "cell", "n"])

    known = docs.filter(rows & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = known.mapInArrow(count, COUNTS).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.full((CELLS, len(langs)), PRIOR)
    for k, name in enumerate(langs):
        mine = sums[sums["lang"] == name]
        table[mine["cell"].to_numpy(), k] += mine["n"].to_numpy()
    return LanguageModel(langs, np.log(table / table.sum(0, keepdims=True)))


def language_mixtures(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, langs (sorted by share), shares.

    lang_pred is the language with the largest share, score its share. A text that is null or has no letter gets
    ``und``, 0 and empty lists, as does every text where no language was learned. Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers for each language

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            for row, data, offsets in bt.pieces(part.column(1)):
                n = len(offsets) - 1
                texts = part.column(1).slice(row, n).to_pylist()
                found, best, score, langs, shares = model.mixtures(data, offsets), [], [], [], []
                for text, p in zip(texts, found, strict=True):
                    if not p.any() or not has_letter(text):
                        best.append(NONE), score.append(0.0), langs.append([]), shares.append([])
                        continue
                    order = [k for k in np.argsort(-p, kind="stable") if p[k] > 0]
                    best.append(model.langs[order[0]]), score.append(min(1.0, float(p[order[0]])))
                    langs.append([model.langs[k] for k in order]), shares.append([float(p[k]) for k in order])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(row, n), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                     pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "langs", "shares"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def identify_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 4 is not 2 and predicts every row: doc_id, held_out, lang_pred, score.

    A null doc_id belongs to no fold: it is not learned from and is not held out. Only the text enters a prediction;
    rows that repeat get equal rows; an empty table gives no row.
    """
    model = fit_languages(docs, fold(doc_id, 4) != 2, text, lang)
    return language_mixtures(docs, model, doc_id, text).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = 0.0,
                    wanted: Collection[str] | None = None) -> DataFrame:
    """The documents, with all their columns, in whose text the learned languages can be told; with ``wanted``, those in one of these languages.

    A text stays when languages explain it better than the background alone does, by ``margin`` at least and with the penalty of
    ``LanguageModel.fitted``: one ordinary word does, also beside keys or numbers; long runs of random letters do not. The model learns from all rows with a language. Null texts and texts without a letter always go; where nothing
    was learned, all others stay, as nothing speaks against them. A text's language is the one with the largest share, as in
    :func:`language_mixtures`; what ``lang`` says of the text does not count.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_languages(docs, F.lit(True), text, lang))
    names = docs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(names.index(text))
            for row, data, offsets in bt.pieces(column):
                shares, gain = model.value.fitted(data, offsets)
                texts = column.slice(row, len(gain)).to_pylist()
                fits = gain >= margin
                if wanted is not None and model.value.langs:
                    fits &= np.isin(model.value.langs, [*wanted])[shares.argmax(1)]
                keep = [has_letter(t) and (not model.value.langs or bool(g)) for g, t in zip(fits, texts, strict=True)]
                yield part.slice(row, len(gain)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
