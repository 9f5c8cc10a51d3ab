"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A mergeable frequent-items summary of the Misra-Gries family (``approx_top_k``, one per task, merged) names the digests that may
be frequent; an exact count verifies them.  Frequent groups are settled where their rows are read: the
verified digests are broadcast with the row that stays, and every other row of such a group leaves the
flow before any shuffle.  All remaining rows, and the one survivor of each frequent group, are
shuffled by digest in the ordinary way.

*Bounds.*  A digest is frequent when it has more than 1/``SHARE`` of all rows, so there are fewer than
``SHARE`` of them: the broadcast is below a megabyte at any input size.  The summary tracks ``TRACKED`` digests, its
error is at most 3.5 / ``TRACKED`` of the rows, so no frequent digest can be missed among the ``LISTED`` best.
A group that is left to the shuffle holds at most 1/``SHARE`` of the rows.

*Defined results.*  A null text counts as empty.  The row with the largest id stays; null ids come last; of
rows that repeat both text and id one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keysift.sources.staging import Staging

SHARE = 4096
TRACKED = 65536
LISTED = 8192


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def frequent(keyed: DataFrame) -> DataFrame:
    """Of a frame (id, digest): (digest, keep_id, group_size) of the digests above 1/SHARE of the rows."""
    listed = keyed.agg(F.expr(f"approx_top_k(digest, {LISTED}, {TRACKED})").alias("top"))
    names = listed.select(F.explode("top").alias("x")).select(F.col("x.item").alias("digest"))
    total = keyed.count()
    exact = (keyed.join(F.broadcast(names), "digest").groupBy("digest")
             .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return exact.filter(F.col("group_size") * SHARE > total)


def _beaten(frame: DataFrame) -> Column:
    """True for a row of a frequent group that is certainly not the survivor."""
    return F.col("keep_id").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("keep_id")))


def _split(keyed: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows settled where they are read, and rows that still have to be shuffled by digest."""
    joined = keyed.join(F.broadcast(winners), "digest", "left")
    return joined.filter(_beaten(joined)), joined.filter(~F.coalesce(_beaten(joined), F.lit(False)))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, digest)."""
    staging = Staging(docs.sparkSession, "exact-dedup")
    keyed = staging.write(docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")), "keyed")
    winners = staging.write(frequent(keyed), "winners")
    settled, rest = _split(keyed, winners)
    group = Window.partitionBy("digest")
    best_first = group.orderBy(F.col("id").desc_nulls_last())
    shuffled = rest.select(
        "id", F.coalesce("keep_id", F.max("id").over(group)).alias("keep_id"),
        F.coalesce("group_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(best_first) == 1).alias("kept"), "digest")
    return settled.select("id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest").unionByName(shuffled)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows travel as one struct, so that no column of ``docs`` can clash with a working column.
    """
    staging = Staging(docs.sparkSession, "exact-dedup")
    keyed = staging.write(docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")), "keyed")
    winners = staging.write(frequent(keyed), "winners")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
                       digest_of(docs[text_col]).alias("digest"))
    _, rest = _split(rows, winners)
    best_first = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())
    return rest.withColumn("n", F.row_number().over(best_first)).filter("n = 1").select("row.*")
