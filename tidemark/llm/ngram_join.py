"""Documents whose sets of word shingles are alike, by T-occurrence search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.components import connected_components
from tidemark.session import materialize

SHINGLE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The so many longest inverted lists come last in the order of shingles. Any order gives the same links.
LONG_LISTS = 1 << 16
#: In the second round a list of so many documents is compared whole; in a longer one so many documents are
#: compared with all, and eight times as many in each further round.
SHORT_LIST, PIVOTS = 32, 8
#: Documents that one search compares with its query.
SEARCH = 256
#: So many rows of ids are broadcast to pick texts or prefixes by; more of them are joined by a shuffle.
BROADCAST_ROWS = 250_000
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words none."""
    low = bt.LOWER[data]
    starts, ends, words = bt.spans(low, offsets, bt.BLANK)
    hashed = bt.hashes(low, starts, ends)
    runs, out = bt.run_hashes(hashed, shingle), []
    for a, b in zip(words[:-1], words[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        else:
            out.append(bt.run_hashes(hashed[a:b], b - a) if b > a else hashed[:0])
    return out


def least_overlap(n, m, percent: int = PERCENT):
    """Shingles that sets of n and m must share: ceil(percent * (n + m) / (100 + percent))."""
    return -(-percent * (n + m) // (100 + percent))


def search(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of ``sets`` link with ``query``, by DivideSkip.

    The query's inverted lists over ``sets`` are ordered by length. With T the least overlap that any of the sets needs,
    the L longest lists are set aside; the others are merged in order, and a set found in at least T - L of
    them is looked up in the long ones by binary search.
    """
    sizes = np.array([len(s) for s in sets])
    need = least_overlap(sizes, len(query), percent)
    least = int(need.min())
    member = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, member = every[order], member[order]
    first, last = np.searchsorted(every, query, "left"), np.searchsorted(every, query, "right")
    length = last - first
    by_length = np.argsort(length, kind="stable")
    n_long = min(least - 1, int(least / (0.01 * np.log2(max(2, length.max(initial=0))) + 1)))
    short, long = by_length[: len(query) - n_long], by_length[len(query) - n_long :]
    lists = [member[a:b] for a, b in zip(first[short], last[short], strict=True) if b > a]
    merged = np.sort(np.concatenate(lists), kind="stable") if lists else member[:0]  # merges the sorted lists
    found, count = np.unique(merged, return_counts=True)
    linked = np.zeros(len(sets), bool)
    probes = query[long]
    for k, have in zip(found, count, strict=True):
        if have + len(probes) >= need[k]:
            at = np.minimum(np.searchsorted(sets[k], probes), len(sets[k]) - 1)
            linked[k] = have + int((sets[k][at] == probes).sum()) >= need[k]
    return linked


def _long_lists(docs: DataFrame, shingle: int, keep: int) -> np.ndarray:
    """The shingles with the longest inverted lists, the longest last.

    Tasks count all texts piece by piece and report what occurs in two or more documents of a piece, so shingles that occur
    once never leave their task. At most ``keep`` come to the driver; they only set an order.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, data, offsets in bt.pieces(part.column(0)):
                sets = shingle_sets(data, offsets, shingle)
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                some = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["s", "n"])

    counts = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "s").limit(keep).toPandas()
    return top["s"].to_numpy()[::-1].astype(np.int64).view(bt.U)


def _signature(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _prefixes(docs: DataFrame, late: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """doc_id, n, signature of the set, and its first shingles in the common order: enough that two linked sets share one."""
    order = np.argsort(late)
    shared = docs.sparkSession.sparkContext.broadcast((late[order], order))  # LONG_LISTS numbers at most

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = shared.value
        for part in parts:
            for row, data, offsets in bt.pieces(part.column(1)):
                sets = shingle_sets(data, offsets, shingle)
                prefixes = []
                for s in sets:
                    if len(late) and len(s):
                        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        is_late = late[at] == s
                        ordered = np.concatenate([s[~is_late], s[is_late][np.argsort(rank[at[is_late]])]])
                    else:
                        ordered = s
                    prefixes.append(ordered[: len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_signature(s) for s in sets], pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["id", "n", "signature", "prefix"])

    return docs.mapInArrow(run, "id long, n long, signature binary, prefix array<long>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _likely(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose short lists meet often enough.

    Of two linked sets, let q be the one whose prefix ends first. What they share is in both prefixes or among q's other T - 1
    shingles, so the prefixes share at least the overlap needed less the larger T, plus one.
    """
    known = _small(pairs, pairs.count())
    sets = prefixes.filter("n > 0").select("id", "n", "prefix")
    of_q = sets.join(known, F.col("id") == F.col("q")).select("q", "x", F.col("n").alias("qn"), F.col("prefix").alias("q_prefix"))
    of_x = sets.join(known, F.col("id") == F.col("x")).select("q", "x", "n", "prefix")
    needed = F.ceil((F.col("n") + F.col("qn")) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
    rest = F.ceil(F.greatest("n", "qn") * F.lit(percent) / F.lit(100) + 1e-9)
    return of_q.join(of_x, ["q", "x"]).filter(F.size(F.array_intersect("q_prefix", "prefix")) >= needed - rest + 1).select("q", "x").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (q, x) that link, as (a, b). A query's candidates are searched in blocks of bounded size."""
    degree = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / SEARCH).cast("int").alias("blocks"))
    dealt = pairs.join(degree, "q").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    targets = dealt.select(F.col("x").alias("id"), "q", "block", F.lit(False).alias("is_query"))
    queries = dealt.select(F.col("q").alias("id"), "q", "block", F.lit(True).alias("is_query")).distinct()
    # A document in many searches is sent to each, but its text is split into shingles once.
    wanted = targets.union(queries).groupBy("id", F.pmod(F.xxhash64("q"), F.lit(64)).alias("part")).agg(
        F.collect_list(F.struct("q", "block", "is_query")).alias("roles"))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            roles = part.column(2)
            for row, data, offsets in bt.pieces(part.column(1)):
                made = shingle_sets(data, offsets, shingle)
                rows = [(r["q"], r["block"], r["is_query"], key, s.tobytes())
                        for key, each, s in zip(part.column(0).slice(row, len(made)).to_pylist(), roles.slice(row, len(made)).to_pylist(), made, strict=True)
                        for r in each]
                for at in range(0, len(rows), 500):
                    columns = zip(*rows[at : at + 500], strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                     names=["q", "block", "is_query", "x", "set"])

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, names, held = None, [], [], []

        def flush() -> pa.RecordBatch:
            hit = set()
            for q in query if held else []:
                hit |= {names[k] for k in np.flatnonzero(search(q, held, percent))}
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(hit), pa.int64()), pa.array(sorted(hit), pa.int64())], names=["a", "b"])

        for part in parts:
            for q, block, is_query, x, raw in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                if (q, block) != now:
                    if held:
                        yield flush()
                    now, query, names, held = (q, block), [], [], []
                values = np.frombuffer(raw, bt.U)
                if is_query:
                    query.append(values)
                elif len(values):
                    names.append(x), held.append(values)
                    if len(held) >= SEARCH:
                        yield flush()
                        names, held = [], []
        if held:
            yield flush()

    wanted = materialize(wanted, "wanted")
    text = docs.join(_small(wanted, wanted.count()), "id").select("id", "text", "roles")
    rows = text.mapInArrow(sets, "q long, block int, is_query boolean, x long, set binary")
    return rows.repartition("q", "block").sortWithinPartitions("q", "block", F.desc("is_query")).mapInArrow(probe, "a long, b long").distinct()


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Equal sets are one class, known by its smallest doc_id. In a common order of all shingles, with the longest inverted lists last,
    two sets that link share one of their first n - T + 1 shingles, T being the overlap that a set of n needs;
    these make the short lists. A list is not expanded into its pairs: its first document is the query of a search over the
    others, found links are closed to components, and only lists that still hold several components go on to
    another round, in which documents of other components are compared with further pivots, until none is
    left. So every two documents of one list end in one component or have been compared, and no link is lost.

    Texts of fewer words are one shingle; null and empty texts have no shingle and stay alone. Rows that repeat
    a doc_id count as one document; rows without one too, and their component_id is null where it has no
    other document. Other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    late = _long_lists(rows, shingle, LONG_LISTS)
    every = materialize(_prefixes(rows, late, shingle, percent), "prefixes")
    classes = every.filter("n > 0").groupBy("signature").agg(F.min("id").alias("rep"))
    reps = every.join(classes, "signature").filter("id = rep").dropDuplicates(["signature"]).select("id", "n", "prefix")
    lists = reps.select("id", "n", F.posexplode("prefix").alias("at", "s"))
    # Most rows of this exchange are alone in their list: they travel with size and place in one number.
    lists = lists.select("id", "s", (F.shiftleft("n", 32) + F.col("at")).alias("_place"))
    lists = lists.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("s"))).filter("size > 1")
    lists = lists.select("id", F.shiftright("_place", 32).alias("n"), F.col("_place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"), "s", "size")
    # Sizes in a ratio of at least percent / 100 are in the same band or in neighbouring ones.
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) * (1 - 1e-9))
    lists = materialize(lists.withColumn("band", band).withColumn("label", F.col("id")), "lists")
    links = components = None
    turn = 0
    while components is None or not lists.isEmpty():
        pivots = F.lit(1) if not turn else F.when(F.col("size") <= SHORT_LIST, F.col("size")).otherwise(PIVOTS * 8 ** (turn - 1))
        ranked = lists.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("id", "n")))
        heads = ranked.filter(F.col("k") <= pivots).select(
            "s", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), F.col("id").alias("q"), F.col("n").alias("qn"),
            F.col("at").alias("qat"), F.col("k").alias("qk"), F.col("label").alias("qlabel"))
        met = ranked.join(heads, ["s", "band"]).filter("k > qk AND label <> qlabel")
        needed = F.ceil((F.col("n") + F.col("qn")) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
        most = F.lit(1) + F.least(F.col("n") - F.col("at") - 1, F.col("qn") - F.col("qat") - 1)
        pairs = materialize(met.filter((needed <= F.least("n", "qn")) & (most >= needed)).select(
            F.least("id", "q").alias("q"), F.greatest("id", "q").alias("x")).distinct(), "pairs")
        pairs = materialize(_likely(pairs, every, percent), "likely")
        found = materialize(_verified(rows, pairs, shingle, percent), "found")
        if components is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            components = materialize(connected_components(links), "components")
        rest = ranked.filter(F.col("k") > pivots).drop("k", "label", "size")
        rest = rest.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        several = rest.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        lists = materialize(rest.join(several.filter("lo <> hi").select("s", "size"), "s"), "lists")
        turn += 1
    ids = every.select("id", "n", "signature").join(classes, "signature", "left").withColumn("node", F.coalesce("rep", "id"))
    joined = ids.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return joined.select(F.expr(f"nullif(id, {NO_ID})").alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.expr(f"nullif(component, {NO_ID})").alias("component_id"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that have the smallest doc_id of their component; a missing id comes after all others.

    Rows are judged one by one. Where ids are unique and known they name the rows. Where one is repeated or missing, the rows are written once with
    a number each and compared by it, so another text under the same id is not touched; of rows with the smallest id, one stays.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("own"))
    if ids.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("own IS NULL OR n > 1").isEmpty():
        gone = similar_documents(docs, doc_id, text, shingle, percent).filter("doc_id > component_id").select(F.col("doc_id").alias("own"))
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("own"))
        return rows.join(gone, "own", "left_anti").select("row.*")
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    places = similar_documents(rows.select("number", F.col("row").getField(text).alias("text")), "number", "text", shingle, percent)
    owned = places.select(F.col("doc_id").alias("number"), F.col("component_id").alias("component")).join(
        rows.select("number", F.col("row").getField(doc_id).cast("long").alias("own")), "number")
    rank = F.struct(F.col("own").isNull().alias("missing"), "own", "number")
    kept = owned.groupBy("component").agg(F.min(rank).alias("best")).select("best.number")
    return rows.join(kept, "number", "left_semi").select("row.*")
