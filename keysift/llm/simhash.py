"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

*Fingerprint.*  A-Z are lower-cased, words are what white space (space, tab to carriage return) leaves, a
shingle is ``size`` consecutive words joined by spaces, repeats included; a shorter text is one shingle.  Each
shingle is hashed with XXH64 (seed 42); a bit is set when it is set in over half of the hashes.  A
text without words, and null, has the fingerprint zero.

*Links.*  Fingerprints are first made distinct, so copies cost nothing.  64 bits are cut into four blocks; two
fingerprints that differ in at most two bits agree in at least two blocks, so each is listed under its six pairs of blocks and joined on
those 32-bit keys, then the Hamming distance is verified.  A key with more than ``DIRECT`` fingerprints is
not expanded into pairs: two fingerprints differ in at most two bits exactly when some value is within one bit of
both, so the members are listed under the 65 values within one bit of them and linked to the smallest
fingerprint under each value.  A value has at most 65 fingerprints.  This is exact and its cost is linear in the group.

*Defined results.*  Rows that repeat an id and text have the same fingerprint and component.  The component's id is the smallest
non-null id in it (null if it has none).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from keysift.llm.components import components
from keysift.sources.staging import Staging

BLOCK_BITS = 16
DIRECT = 24
MAX_BITS = 2
PIECE = 4096


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), 42)
    total, n = np.zeros(64, np.int64), len(words) - size + 1
    for start in range(0, n, PIECE):
        part = words[start:start + PIECE + size - 1]
        values = np.array([hashed(b" ".join(x), 42) for x in zip(*[part[i:] for i in range(size)])], np.uint64)
        total += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, size: int = 3) -> Column:
    """The fingerprint as a (signed) bigint."""
    @pandas_udf("bigint")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((fingerprint(x, size) for x in texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))
    return simhash(text.cast("string"))


def hexed(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _block_keys() -> Column:
    """Six (pair number, 32 bits) keys of a fingerprint."""
    blocks = [F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*[F.lit(k * (1 << 32)).cast("bigint") + F.shiftleft(blocks[i], 16) + blocks[j]
                     for k, (i, j) in enumerate(pairs)])


def close_pairs(prints: DataFrame, staging: Staging) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that differ in at most two bits."""
    keys = prints.select("fp", F.explode(_block_keys()).alias("key"))
    counts = staging.write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    shared = staging.write(keys.join(counts, "key").select("key", "fp", (F.col("n") <= DIRECT).alias("few")), "shared")
    groups = shared.filter("few").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    pairs = groups.select(F.explode(F.expr(
        f"flatten(transform(fps, x -> transform(filter(fps, y -> x < y AND bit_count(x ^ y) <= {MAX_BITS}),"
        " y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b")
    crowded = shared.filter("NOT few").select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("value"))
    stars = near.groupBy("value").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    spokes = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.union(spokes).distinct()


def linked(rows: DataFrame, staging: Staging) -> DataFrame:
    """Of (id, fp) rows: (fp, label, component_id) for every distinct fingerprint."""
    prints = staging.write(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "prints")
    labels = components(close_pairs(prints, staging), staging)
    known = staging.write(prints.join(labels.toDF("fp", "label"), "fp", "left")
                          .select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "known")
    firsts = staging.write(known.groupBy("label").agg(F.min("first_id").alias("component_id")), "firsts")
    return staging.write(known.join(firsts, "label").select("fp", "label", "component_id"), "linked")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp, component_id), one row per row of ``docs``."""
    staging = Staging(docs.sparkSession, "simhash")
    rows = staging.write(docs.select(docs[id_col].alias("id"), fingerprint_column(docs[text_col], size).alias("fp")), "rows")
    found = linked(rows, staging)
    return rows.join(found.select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays (nulls last, then by
    hash of the text; rows equal in both are settled by exact deduplication beforehand and otherwise all stay).

    Only (id, hash, fingerprint) travel while groups are found; texts are moved once, to meet the list of survivors.
    """
    staging = Staging(docs.sparkSession, "simhash")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = staging.write(docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("h"),
                                     fingerprint_column(docs[text_col], size).alias("fp")), "rows")
    found = linked(rows, staging)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    stay = (rows.join(found, "fp").groupBy("label").agg(F.min(order).alias("x"))
            .select(F.col("x.id").alias("id"), F.col("x.h").alias("h")))
    stay = staging.write(stay.distinct(), "stay")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
                        F.xxhash64(text).alias("h"))
    same = (whole["h"] == stay["h"]) & whole["id"].eqNullSafe(stay["id"])
    return whole.join(stay, same, "left_semi").select("row.*")
