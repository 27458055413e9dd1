"""A convolutional classifier of toxic texts, trained in numpy on every labelled row, by replicas that are averaged."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.language_id import LanguageModel, fit_languages, fold
from tidemark.session import materialize

#: Labelled documents for each replica of the model. All rows are trained on, by as many replicas as that takes.
TRAIN_ROWS = 12_000
#: Up to so many labelled ids are sent to the tasks, so that no text moves to meet its label; more meet the texts by a shuffle.
SENT_IDS = 5_000_000
#: Logits are counted in cells of this width; each cell keeps its smallest and largest logit.
LOGIT_CELL = 1 / 1024
CELLS, DIM, WIDTHS, FILTERS = 1 << 14, 16, (1, 2, 3), 16
#: A word enters by its own cell and by those of its first bytes, so that forms of a stem share weights.
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
#: A small training set is gone through more often, until there were so many steps.
LEAST_STEPS = 600
#: A language with fewer labelled rows of either kind uses the threshold of all.
LEAST_LABELLED = 10


def word_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each word (own, and of its prefixes) and the number of words before each text."""
    low = bt.LOWER[data]
    starts, ends, words = bt.spans(low, offsets, ~bt.LETTER)
    sums = bt.prefix_sums(low)
    columns = [bt.hashes(low, starts, ends, sums)] + [
        bt.hashes(low, starts, np.minimum(ends, starts + p), sums) ^ bt.U(p) for p in PREFIXES]
    return (np.stack(columns, 1) % bt.U(CELLS)).astype(np.int32), words


@dataclass
class ToxicityModel:
    """Word embeddings by hash cell, filters of several widths, max pooling over the whole text, a linear layer."""

    emb: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    langs: LanguageModel | None = None

    @classmethod
    def new(cls, seed: int = SEED) -> ToxicityModel:
        rng = np.random.default_rng(seed)
        made = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(made(CELLS, DIM, scale=0.1), [made(w, DIM, FILTERS, scale=0.3) for w in WIDTHS],
                   np.zeros(len(WIDTHS) * FILTERS, np.float32), made(len(WIDTHS) * FILTERS, scale=0.1))

    def maps(self, cells: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs at every word (a window past its text's end sees nothing there) and the word vectors."""
        vectors = self.emb[cells[:, 0]]
        for column in cells.T[1:]:
            vectors += self.emb[column]
        ends = words[1:][np.diff(words) > 0]
        maps = np.empty((len(cells), len(self.bias)), np.float32)
        for i, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            total = vectors @ f[0]
            for k in range(1, width):
                more = vectors[k:] @ f[k]
                # The last k words of a text reach past its end.
                past = (ends[:, None] - np.arange(1, k + 1)).ravel()
                more[past[(past >= 0) & (past < len(more))]] = 0
                total[:-k] += more
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            np.add(total, self.bias[part], out=maps[:, part])
        return maps, vectors

    def logits(self, cells: np.ndarray, words: np.ndarray) -> np.ndarray:
        """One per text; a text without words has the logit of no feature at all."""
        full = np.flatnonzero(np.diff(words))
        pooled = np.zeros((len(words) - 1, len(self.out)), np.float32)
        if len(full):
            pooled[full] = np.maximum(np.maximum.reduceat(self.maps(cells, words)[0], words[full], axis=0), 0)
        return pooled @ self.out + self.out_bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """At least 0.5 where the logit reaches the threshold of the language that the text itself shows."""
        logit = self.logits(*word_cells(data, offsets))
        shift = np.full(len(logit), self.threshold)
        if self.langs and self.langs.langs and self.thresholds:
            of = np.array([self.thresholds.get(x, self.threshold) for x in self.langs.langs])
            mix = self.langs.mixtures(data, offsets)
            shift = np.where(mix.any(1), of[mix.argmax(1)], shift)
        return 1 / (1 + np.exp(-np.clip(logit - shift, -30, 30)))


def _tensors(model: ToxicityModel) -> dict[str, np.ndarray]:
    return {"emb": model.emb, "bias": model.bias, "out": model.out} | {f"f{w}": f for w, f in zip(WIDTHS, model.filters, strict=True)}


@dataclass
class Moments:
    """What Adam keeps beside the weights."""

    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @classmethod
    def new(cls, model: ToxicityModel) -> Moments:
        return cls(*({k: np.zeros_like(v) for k, v in _tensors(model).items()} for _ in range(2)))


def _train(model: ToxicityModel, cells: list[np.ndarray], labels: np.ndarray, seed: int | list[int] = SEED,
           moments: Moments | None = None, only: int | None = None) -> np.ndarray:
    """Adam on the log loss with both labels at equal weight; a maximum's gradient goes to the one window that gave it.

    With ``only``, just that one of ``EPOCHS`` passes is made, from the given moments on. Gives the cells whose embedding changed.
    """
    rng = np.random.default_rng(seed)
    tensors, moments, touched = _tensors(model), moments or Moments.new(model), np.zeros(CELLS, bool)
    first, second = moments.first, moments.second
    weight = np.where(labels == 1, len(labels) / (2 * max(1, labels.sum())), len(labels) / (2 * max(1, (1 - labels).sum())))
    step, bias1, bias2 = moments.step, 0.0, 0.0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(cells))) if only is None else EPOCHS
    for epoch in range(epochs) if only is None else [only]:
        for at in np.array_split(rng.permutation(len(cells)), max(1, len(cells) // BATCH)):
            at = at[[len(cells[i]) > 0 for i in at]]
            if not len(at):
                continue
            words = np.concatenate([[0], np.cumsum([len(cells[i]) for i in at])])
            some = np.concatenate([cells[i] for i in at])
            maps, vectors = model.maps(some, words)
            where = np.stack([maps[a:b].argmax(0) + a for a, b in zip(words[:-1], words[1:], strict=True)])
            raw = maps[where, np.arange(maps.shape[1])]
            pooled = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
            d = ((p - labels[at]) * weight[at] / len(at)).astype(np.float32)
            dp = (d[:, None] * model.out) * (raw > 0)
            grads = {"bias": dp.sum(0), "out": pooled.T @ d}
            cell_at, cell_grad = [], []
            for k, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                g, place, gf = dp[:, part], where[:, part], np.zeros_like(f)
                for j in range(width):
                    spot = np.minimum(place + j, len(some) - 1)
                    inside = (place + j < words[1:, None]) * g
                    gf[j] = np.einsum("nfd,nf->df", vectors[spot], inside)
                    dv = inside[:, :, None] * f[j].T[None]
                    cell_at.append(some[spot.ravel()])
                    cell_grad.append(dv.reshape(-1, DIM))
                grads[f"f{width}"] = gf
            ids, grad = np.concatenate(cell_at), np.concatenate(cell_grad)
            keep = np.abs(grad).sum(1) > 0
            ids, grad = ids[keep].ravel(), np.repeat(grad[keep], ids.shape[1], axis=0)
            rows, which = np.unique(ids, return_inverse=True)
            touched[rows] = True
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, which, grad)
            step += 1
            bias1, bias2, rate = 1 - 0.9**step, 1 - 0.999**step, RATE * (1 - epoch / epochs)
            for name, tensor in tensors.items():
                spot, g = (rows, total) if name == "emb" else (slice(None), grads[name])
                m, v = first[name], second[name]
                m[spot] = 0.9 * m[spot] + 0.1 * g
                v[spot] = 0.999 * v[spot] + 0.001 * g * g
                tensor[spot] -= rate * (m[spot] / bias1) / (np.sqrt(v[spot] / bias2) + 1e-8)
            model.out_bias -= rate * float(d.sum())
    moments.step = step
    return np.flatnonzero(touched)


def _split(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Cells and labels of a replica's rows in the order of their hash, which of them calibrate (a fifth; all of fewer than 100),
    and their languages."""
    table = table.sort_by([("_hash", "ascending"), ("_text", "ascending")])
    cells = []
    for _, data, offsets in bt.pieces(table.column("_text").combine_chunks()):
        some, words = word_cells(data, offsets)
        cells += np.split(some, words[1:-1])
    y = np.array(table.column("_label").to_pylist(), np.int64)
    keep = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.ones(len(y), bool)
    return cells, y, keep, np.array(table.column("_lang").to_pylist(), dtype=object)


def _rows(model: ToxicityModel, moments: Moments) -> np.ndarray:
    """Weights and moments as rows of DIM numbers each: those of the embedding first, then all others."""
    parts = []
    for tensors, last in ((_tensors(model), [model.out_bias, moments.step]), (moments.first, [0, 0]), (moments.second, [0, 0])):
        rest = np.concatenate([*[tensors[k].ravel() for k in sorted(tensors) if k != "emb"], last])
        rest = np.concatenate([rest, np.zeros(-len(rest) % DIM)]).reshape(-1, DIM)
        parts.append(np.concatenate([tensors["emb"].astype(np.float64), rest]))
    return np.concatenate(parts, 1)


def _unpack(rows: np.ndarray, model: ToxicityModel, moments: Moments) -> None:
    """The reverse of :func:`_rows`, in place."""
    for tensors, part in zip((_tensors(model), moments.first, moments.second), np.split(rows, 3, axis=1), strict=True):
        tensors["emb"][:] = part[:CELLS]
        rest, at = part[CELLS:].ravel(), 0
        for k in sorted(tensors):
            if k != "emb":
                tensors[k][...] = rest[at : at + tensors[k].size].reshape(tensors[k].shape)
                at += tensors[k].size
        if tensors["out"] is model.out:
            model.out_bias, moments.step = float(rest[at]), int(round(rest[at + 1]))


def _train_replicas(taken: DataFrame, replicas: int) -> ToxicityModel:
    """One replica trains in its task to the end. Several make one pass each over their own rows from common weights, which are
    averaged by rows after each pass; an embedding by the replicas that changed it. A fixed count of numbers comes to the driver."""
    model = ToxicityModel.new()
    moments = Moments.new(model)
    names = [f"w{k}" for k in range(3 * DIM)]
    for epoch in range(EPOCHS if replicas > 1 else 1):
        shared = taken.sparkSession.sparkContext.broadcast((model, moments))

        def run(table: pa.Table) -> pa.Table:
            own, state = pickle.loads(pickle.dumps(shared.value))
            cells, y, keep, _ = _split(table)
            train = ~keep if len(y) >= 100 else keep
            seed, only = (SEED, None) if replicas == 1 else ([SEED, table.column("_replica")[0].as_py(), epoch], epoch)
            touched = _train(own, [cells[i] for i in np.flatnonzero(train)], y[train], seed, state, only)
            rows = _rows(own, state)
            at = np.concatenate([touched, np.arange(CELLS, len(rows))])
            return pa.table([pa.array(at, pa.int32()), pa.array(np.full(len(at), float(train.sum()))), *[pa.array(c) for c in rows[at].T]], names=["k", "n", *names])

        made = taken.groupBy("_replica").applyInArrow(run, ", ".join(["k int", "n double", *[f"{c} double" for c in names]]))
        mean = made.groupBy("k").agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in names]).toPandas()
        rows = _rows(model, moments)
        rows[mean["k"].to_numpy()] = mean[names].to_numpy()
        _unpack(rows, model, moments)
    return model


def best_threshold(high: np.ndarray, low: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The cut with the best F1, half-way between the neighbouring logits; ties go to the highest cut.

    The logits are given by cells from the highest on: largest and smallest logit, rows, rows with the label.
    """
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + max(1, hits.sum()))
    k = int(f1.argmax())
    return float((low[k] + high[k + 1]) / 2 if k + 1 < len(low) else low[k])


def _calibrate(taken: DataFrame, model: ToxicityModel) -> None:
    """Sets the thresholds from the rows that were kept from training. Their logits are counted by cell; only cells reach the driver."""
    shared = taken.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        cells, y, keep, spoken = _split(table)
        logits = [float(shared.value.logits(cells[i], np.array([0, len(cells[i])]))[0]) for i in np.flatnonzero(keep)]
        return pa.table([pa.array(spoken[keep], pa.string()), pa.array(logits, pa.float64()), pa.array(y[keep])], names=["lang", "logit", "y"])

    found = taken.groupBy("_replica").applyInArrow(run, "lang string, logit double, y long")
    counted = found.groupBy("lang", F.floor(F.col("logit") / LOGIT_CELL).alias("cell")).agg(
        F.max("logit").alias("high"), F.min("logit").alias("low"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).toPandas()

    def cut(some) -> float:
        by = some.groupby("cell").agg({"high": "max", "low": "min", "n": "sum", "hits": "sum"}).sort_index(ascending=False)
        return best_threshold(*(by[c].to_numpy() for c in ("high", "low", "n", "hits")))

    if 0 < counted["hits"].sum() < counted["n"].sum():
        model.threshold = cut(counted)
    for name in sorted(set(counted["lang"]) - {""}):
        mine = counted[counted["lang"] == name]
        if min(mine["hits"].sum(), (mine["n"] - mine["hits"]).sum()) >= LEAST_LABELLED:
            model.thresholds[name] = cut(mine)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                 label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Trains on all labelled rows among ``rows``; whole texts, a fifth of them kept to calibrate the thresholds.

    The rows are dealt by the hash of their id to replicas of about ``train_rows`` rows, whatever the number of rows; see
    :func:`_train_replicas`. The language table is counted over all of ``rows``. With one label or none there is nothing to learn,
    and every score is below 0.5.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    # Written first, so that the number of the ids decides how the texts meet them.
    known = materialize(known.filter(rows), "labelled")
    ids = known.count()
    replicas = max(1, -(-ids // train_rows))
    known = F.broadcast(known) if ids <= SENT_IDS else known
    own = docs.filter(rows).select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                                   F.coalesce(F.col(lang), F.lit("")).alias("_lang"))
    taken = own.join(known, F.col("_id") == F.col(doc_id)).select(F.xxhash64("_id").alias("_hash"), "_text", "_lang", "_label")
    # More partitions than replicas, so that few replicas share one.
    taken = taken.withColumn("_replica", F.pmod("_hash", F.lit(replicas)).cast("int")).repartition(4 * replicas, "_replica").persist(StorageLevel.DISK_ONLY)
    seen = taken.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("hits")).first()
    if not 0 < seen["hits"] < seen["n"]:
        taken.unpersist()
        model = ToxicityModel.new()
        model.out[:] = 0
        model.out_bias = -1.0
        return model
    model = _train_replicas(taken, replicas)
    _calibrate(taken, model)
    taken.unpersist()
    model.langs = fit_languages(docs, rows, text, lang)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted (1 where score >= 0.5). Null counts as empty; an empty text is scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, data, offsets in bt.pieces(part.column(1)):
                score = shared.value.probabilities(data, offsets).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(row, len(score)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 5 is not 0 and scores every row: doc_id, held_out, score, predicted.

    A null doc_id belongs to no fold. Of several labels of one id the largest counts. Only the text enters a score; rows that repeat get equal rows;
    an empty table gives no row.
    """
    model = fit_toxicity(docs, labels, fold(doc_id, 5) != 0, doc_id, text, **settings)
    return score_toxicity(docs, model, doc_id, text).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
