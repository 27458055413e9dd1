"""Shards by a keyed permutation of the row numbers.

Rows are numbered in the order of the md5 of their id. A Feistel network over pairs (left, right) with left < a and
right < b, a * b a little above the number of rows, permutes the numbers; numbers that fall behind the last row walk on along their
cycle. Row p of the permuted order is in shard p % shards at slot p // shards, so the shards' counts are at most one
apart, and both directions are plain column expressions: no shuffle is needed to find a row's place or the row at a place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

SHARDS = 16
SEED = 20_240_117
ROUNDS = 8
#: Numbers are counted out in buckets of about so many rows, at most MANY_BUCKETS of them while these hold no more than LARGE_BUCKET each.
ROWS_PER_BUCKET, MANY_BUCKETS, LARGE_BUCKET = 256, 1 << 16, 1_000_000
#: An id with more rows than this is taken apart.
MOST_ROWS = 4_000_000
#: Sides tried for the grid of the network.
SIDES = 20_000


@lru_cache
def sides(total: int) -> tuple[int, int]:
    """The grid (a, b) with a * b >= total that leaves the fewest places over, a between the root of total and 1.5 times that."""
    root = math.isqrt(max(total, 1) - 1) + 1
    tried = range(root, min(root + SIDES, root + root // 2) + 1)
    a = min(tried, key=lambda x: (x * -(-total // x), x)) if total else 1
    return a, -(-max(total, 1) // a)


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. total - 1, fixed by ``total`` and ``seed``. ``steps`` bounds the walks exactly; see ``for_rows``."""

    total: int
    seed: int = SEED
    steps: int = 1

    @classmethod
    def for_rows(cls, spark: SparkSession, total: int, seed: int = SEED) -> Permutation:
        """Finds how far the longest walk goes by walking from each of the places left over, which are about the root of ``total`` at most."""
        a, b = sides(total)
        once, steps = cls(total, seed), 1
        lost = spark.range(total, max(total, a * b)).select(F.col("id").alias("p"))
        while total and steps <= a * b - total:
            lost, steps = lost.select(once._once(F.col("p")).alias("p")).filter(F.col("p") >= total), steps + 1
            if not lost.take(1):
                break
        return cls(total, seed, steps)

    def _mixed(self, k: Column, half: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(self.seed)), k.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

    def _once(self, n: Column, back: bool = False) -> Column:
        a, b = (F.lit(x).cast("long") for x in sides(self.total))
        sign = -1 if back else 1

        def turn(pair: Column, k: Column) -> Column:
            left, right = pair["left"], pair["right"]
            return F.when(k % 2 == 0, F.struct(F.pmod(left + sign * (self._mixed(k, right) % a), a).alias("left"), right.alias("right"))).otherwise(
                F.struct(left.alias("left"), F.pmod(right + sign * (self._mixed(k, left) % b), b).alias("right")))

        order = range(ROUNDS)[:: sign]
        first = F.struct(F.call_function("div", n, b).alias("left"), (n % b).alias("right"))
        return F.aggregate(F.array(*[F.lit(k) for k in order]), first, turn, lambda pair: pair["left"] * b + pair["right"])

    def _walk(self, n: Column, back: bool) -> Column:
        total = F.lit(self.total).cast("long")
        out = F.aggregate(F.sequence(F.lit(2), F.lit(self.steps)), self._once(n, back),
                          lambda p, _: F.when(p < total, p).otherwise(self._once(p, back))) if self.steps > 1 else self._once(n, back)
        return F.when(n.between(0, self.total - 1), out)

    def place(self, n: Column) -> Column:
        """The place of row ``n``; null outside 0 .. total - 1."""
        return self._walk(n.cast("long"), False)

    def row(self, p: Column) -> Column:
        """The row at place ``p``: the inverse of ``place``."""
        return self._walk(p.cast("long"), True)


def shard_and_slot(permutation: Permutation, n: Column, shards: int = SHARDS) -> tuple[Column, Column]:
    """Where row ``n`` goes."""
    p = permutation.place(n)
    return (p % shards).cast("int"), F.call_function("div", p, F.lit(shards).cast("long"))


def row_at(permutation: Permutation, shard: Column, slot: Column, shards: int = SHARDS) -> Column:
    """The number of the row at a slot of a shard; null where there is none."""
    return permutation.row(slot.cast("long") * shards + shard)


def number_rows(docs: DataFrame, key: str, ties: list[Column], large: int = LARGE_BUCKET, most: int = MOST_ROWS) -> tuple[DataFrame, int]:
    """(row: the columns of ``docs`` as a struct, number) and the number of rows. Read ``docs`` from storage, as it is counted first.

    Numbers go by (md5 of ``key``, ``ties``) from 0 without gaps. Buckets of md5 ranges are counted (a scan of one column), the
    counts summed up in two levels, and rows numbered inside their bucket. An id with more than ``most`` rows would fill a bucket
    alone: its rows are dealt to several by their place in the written table, so among them (and only there) the order is free.
    """
    total = docs.count()
    buckets = 1 << max(0, min(total // ROWS_PER_BUCKET, max(MANY_BUCKETS, total // large)).bit_length() - 1)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    bucket = F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets, 32)
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"), bucket.alias("bucket"), F.lit(0).cast("long").alias("part"),
                       *[t.alias(f"tie{k}") for k, t in enumerate(ties)])
    counts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    if total > most and (counts.agg(F.max("n")).first()[0] or 0) > most:
        hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        parts = F.call_function("div", F.col("n"), F.lit(most).cast("long")) + 1
        dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn(  # at most total / most rows
            "part", F.coalesce(F.pmod(F.monotonically_increasing_id(), parts) + 1, F.lit(0).cast("long"))).drop("n")
        rows = materialize(dealt, "numbered")
        counts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    wide = F.shiftright("bucket", 10).alias("wide")
    inner = Window.partitionBy("wide").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    summed = counts.select("bucket", "part", "n", wide).withColumn("inner", F.coalesce(F.sum("n").over(inner), zero))
    above = counts.groupBy(wide).agg(F.sum("n").alias("n")).select("wide", F.coalesce(F.sum("n").over(outer), zero).alias("outer"))
    first = summed.join(F.broadcast(above), "wide").select("bucket", "part", (F.col("inner") + F.col("outer")).alias("first"))  # one row for 1024 buckets
    within = Window.partitionBy("bucket", "part").orderBy("digest", *[f"tie{k}" for k in range(len(ties))])
    placed = rows.withColumn("within", F.row_number().over(within)).join(first, ["bucket", "part"])
    return placed.select("row", (F.col("first") + F.col("within") - 1).alias("number")), total


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", ties: list[Column] | None = None,
               names: tuple[str, str] = ("shard", "slot"), **limits) -> DataFrame:
    """All rows and columns of ``docs``, with shard int and slot long added.

    The law is `rows`: shards hold equally many rows, one more at most, whatever their sizes and groups; slots run from 0 without
    gaps. The place depends on the ids, ``ties`` (by default the hash of all columns), the number of rows and the seed, not on files or partitions. Rows that repeat an id,
    or have none, get places of their own; rows equal in every column may change places with each other. Columns of the input that
    have one of the two ``names`` (in any case) are replaced. An empty table gives no row.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ties = [F.xxhash64(*[_hashable(docs, c) for c in docs.columns])] if ties is None else ties
    numbered, total = number_rows(docs, doc_id, ties, **limits)
    shard, slot = shard_and_slot(Permutation.for_rows(docs.sparkSession, total, seed), F.col("number"), shards)
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in kept], shard.alias(names[0]), slot.alias(names[1]))


def _hashable(docs: DataFrame, name: str) -> Column:
    """A column to hash by; types that cannot be hashed or ordered are written as JSON first."""
    plain = docs.schema[name].dataType.simpleString()
    quoted = F.col("`" + name.replace("`", "``") + "`")
    return F.to_json(F.struct(quoted)) if "map<" in plain or "variant" in plain else quoted


def place_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and one), text_crc32, law (`rows`), shard, slot, grown_shard (null).

    A null text counts as empty. Texts are only measured where they are read; the shuffle moves ids, sizes and checksums.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = shard_rows(slim, shards, seed, "doc_id", [F.col("text_crc32"), F.col("size")], **limits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
