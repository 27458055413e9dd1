"""The permutation against one in plain Python, and shards of odd tables."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def once(n, total, seed):
    a, b = sharding.sides(total)
    left, right = divmod(n, b)
    for k in range(sharding.ROUNDS):
        mixed = int(hashlib.md5(f"{seed}:{k}:{left if k % 2 else right}".encode()).hexdigest()[:15], 16)
        left, right = (left, (right + mixed) % b) if k % 2 else ((left + mixed) % a, right)
    return left * b + right


def walked(n, total, seed):
    p, steps = once(n, total, seed), 1
    while p >= total:
        p, steps = once(p, total, seed), steps + 1
    return p, steps


@pytest.mark.parametrize("total", [0, 1, 2, 3, 7, 97, 1009])
@pytest.mark.parametrize("seed", [1, sharding.SEED])
def test_permutation_walks_its_cycles(spark, total, seed):
    found = sharding.Permutation.for_rows(spark, total, seed)
    rows = spark.range(-1, total + 1).select("id", found.place(F.col("id")).alias("p"))
    rows = rows.withColumn("back", found.row(F.col("p"))).collect()
    places = {r.id: r.p for r in rows}
    assert places.pop(-1) is None and places.pop(total) is None
    want = {n: walked(n, total, seed) for n in range(total)}
    assert places == {n: p for n, (p, _) in want.items()} and sorted(places.values()) == list(range(total))
    assert max([s for _, s in want.values()], default=1) <= found.steps
    assert all(r.back == r.id for r in rows if r.p is not None)


@pytest.mark.parametrize("total", [10**9 + 7, 10**12 + 39, 10**14 + 31])
def test_large_numbers_come_back(spark, total):
    found = sharding.Permutation.for_rows(spark, total)
    rows = spark.range(total - 300, total).select("id", found.place(F.col("id")).alias("p")).withColumn("back", found.row(F.col("p")))
    rows = rows.collect()
    assert all(0 <= r.p < total and r.back == r.id for r in rows) and len({r.p for r in rows}) == 300
    assert {r.id: r.p for r in rows[:20]} == {r.id: walked(r.id, total, sharding.SEED)[0] for r in rows[:20]}


TEXTS = ["one", None, "", "é" * 4000, "x" * 100_000, "one"] * 20
ROWS = [(k, t, k % 3, "s", "n") for k, t in enumerate(TEXTS)] + [(None, "no id", 0, None, None)] * 30 + [(3, "again", 0, "s", "n")] * 40
SCHEMA = "doc_id long, text string, slot int, digest string, number string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.mark.parametrize("most", [sharding.MOST_ROWS, 7])
def test_places(docs, most, monkeypatch):
    """With a limit of 7 rows the repeated and the missing id are taken apart."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 16)
    rows = sharding.place_documents(docs, 6, most=most).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(6)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(6) for k in range(counts[s])]
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    ids = {r.doc_id: (r.shard, r.slot) for r in rows if r.doc_id not in (None, 3)}
    again = sharding.place_documents(docs.repartition(2), 6, most=most).collect()
    if most > 7:
        assert sorted(map(str, rows)) == sorted(map(str, again))
        total, order = len(ROWS), sorted(ROWS, key=lambda r: (hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest(),
                                                            zlib.crc32((r[1] or "").encode())))
        assert all(ids[r[0]] == divmod(walked(k, total, sharding.SEED)[0], 6)[::-1] for k, r in enumerate(order) if r[0] in ids)
    else:
        assert ids == {r.doc_id: (r.shard, r.slot) for r in again if r.doc_id in ids}


def test_all_columns_stay(docs):
    out = sharding.shard_rows(docs, 4)
    assert out.columns == ["doc_id", "text", "digest", "number", "shard", "slot"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, *_ in ROWS)
    spread = {r.shard for r in out.filter("doc_id IS NULL").collect()}
    assert len(spread) == 4


def test_row_at_a_slot(spark):
    found = sharding.Permutation.for_rows(spark, 103)
    shard, slot = sharding.shard_and_slot(found, F.col("id"), 5)
    rows = spark.range(103).select("id", shard.alias("shard"), slot.alias("slot"))
    assert rows.filter(sharding.row_at(found, F.col("shard"), F.col("slot"), 5) == F.col("id")).count() == 103
    assert spark.range(1).select(sharding.row_at(found, F.lit(4), F.lit(20), 5).alias("x")).first().x is None


def test_empty_table_and_no_shard(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.place_documents(empty).count() == 0 and sharding.shard_rows(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(docs, 0)


def test_numbering_needs_no_python_worker(docs, spark):
    plan = sharding.place_documents(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
