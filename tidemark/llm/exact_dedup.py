"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import without_blanks

#: Tasks share so many salts; a group of copies meets in at most this many places before the last merge.
SALTS = 16

WIDTH = "18446744073709551616"  # 2 ** 64, above any difference of two longs


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("id"), without_blanks(body).alias("content"),
                       F.char_length(body).alias("points")).withColumn("digest", F.unhex(F.sha2("content", 256)))


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id, keep_points, group_size.

    Copies are first merged inside each task (partial aggregation), then by salted digest, then over the salts.
    Every stage groups by digest and by the whole content, so only equal contents
    merge; two contents of one digest would end the job with an error. Copies in one task carry one salt, so a
    group of any size sends at most one row a task. The winner has the most code points, then the
    smallest id; a null id comes last.
    """
    rank = (F.col("points").cast("decimal(38,0)") * F.lit(WIDTH).cast("decimal(20,0)")
            + F.coalesce(F.lit("9223372036854775808").cast("decimal(20,0)") - F.col("id").cast("decimal(20,0)"),
                         F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)")
    rows = _prepared(docs, doc_id, text).withColumn("rank", rank).withColumn("salt", F.spark_partition_id() % salts)
    local = rows.groupBy("digest", "content", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("best"), F.max_by("id", "rank").alias("best_id"),
        F.max("points").alias("points"))
    whole = local.groupBy("digest", "content").agg(
        F.sum("n").alias("n"), F.max_by("best_id", "best").alias("best_id"), F.max("points").alias("points"))
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two contents share a digest")).cast("long"))
    return whole.groupBy("digest").agg(
        F.coalesce(one, F.max("n")).alias("group_size"), F.max("best_id").alias("keep_id"),
        F.max("points").alias("keep_points"))


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after white space (blank, tab to carriage return) is deleted; null counts
    as empty, and all empty texts are one group. Rows that repeat a winner's id and text are that same document and
    are kept with it. The ids meet their group by digest alone, without the texts; a large group is split by
    the skewed join. Other columns are ignored; an empty table gives no row.
    """
    groups = copy_groups(docs, doc_id, text, salts)
    ids = _prepared(docs, doc_id, text).select("id", "digest", "points")
    return ids.join(groups, "digest", "left").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; of rows repeated with id and text, one.

    Texts move three times: twice for the groups and once to meet their group. The keys of that join are never null (a null id has a mark of
    its own), so what is left of repeated rows is merged where the join has put them. Rows that repeat both id and text meet in one task.
    """
    def keys(own: Column, points: Column) -> list[Column]:
        return [F.coalesce(own, F.lit(0).cast("long")).alias("own"), own.isNull().alias("missing"), points.alias("points")]

    groups = copy_groups(docs, doc_id, text, salts).select("digest", *keys(F.col("keep_id"), F.col("keep_points")))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(without_blanks(body), 256)).alias("digest"),
                        *keys(F.col(doc_id).cast("long"), F.char_length(body)))
    same = ["digest", "own", "missing", "points"]
    return keyed.join(groups, same, "left_semi").dropDuplicates(same).select("row.*")
