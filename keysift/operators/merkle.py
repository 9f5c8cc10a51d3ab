"""Changed files between two snapshots, found by comparing digests of folders.

A snapshot's *tree* has a row for every file and every folder.  A file's digest is that of its path and content; a folder's is made of four sums over
the digests of all files below it, so files come in any order, are pre-aggregated, and a folder with very many files is no list.  Trees are kept: the tree of one
run is the old one of the next, and then only the new snapshot's contents are read.

Two trees are compared level by level from the root.  Only what lies directly in a folder that differs is looked at next, so folders without a change are
not descended into, whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keysift.operators.gates import slashes
from keysift.sources.staging import Staging

CHUNKS = 4


def _sums(digest: Column) -> list[Column]:
    """A SHA-256 in hex as four numbers."""
    return [F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)").alias(f"s{k}") for k in range(CHUNKS)]


def file_digests(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, digest) of a snapshot, narrow rows; a null content differs from an empty one."""
    return files.select(slashes(F.coalesce(F.col(path), F.lit(""))).alias("path"), F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")).alias("digest"))


def tree(digests: DataFrame) -> DataFrame:
    """(path, parent, depth, is_file, files, digest) of every file and folder; the root is the empty path.  Rows with one path are one file."""
    parts = F.split("path", "/")
    # the folders above a file and the file itself, each with its depth
    nodes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        F.when(k == F.size(parts), F.col("path")).otherwise(F.array_join(F.slice(parts, 1, k), "/")).alias("path"),
        k.alias("depth"), (k == F.size(parts)).alias("is_file")))
    own = digests.select("path", *_sums(F.sha2(F.concat_ws("\n", "path", "digest").cast("binary"), 256)))
    spread = own.select(F.explode(nodes).alias("node"), *[f"s{k}" for k in range(CHUNKS)])
    summed = spread.groupBy("node.path", "node.depth", "node.is_file").agg(
        F.count("*").alias("files"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(CHUNKS)])
    parent = F.when(F.col("depth") > 1, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("depth") == 1, F.lit("")))
    return summed.select("path", parent.alias("parent"), "depth", "is_file", "files",
                         F.sha2(F.concat_ws(",", F.col("files").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(CHUNKS)]).cast("binary"), 256).alias("digest"))


def changed_paths(old: DataFrame, new: DataFrame, staging: Staging | None = None, seen: list[DataFrame] | None = None) -> DataFrame:
    """(path, change) of the files that differ between two trees: added, removed or modified.  ``seen`` gets the nodes compared at each level."""
    spark = new.sparkSession
    staging = staging or Staging(spark, "merkle")
    changes, differing, depth = None, None, 0
    while True:
        level = F.col("depth") == depth
        sides = [t.filter(level).select("path", "parent", "is_file", "digest") for t in (old, new)]
        if differing is not None:
            sides = [s.join(differing, "parent", "left_semi") for s in sides]
        was, now = (s.select("path", "is_file", F.col("digest").alias(name)) for s, name in zip(sides, ("was", "now")))
        compared = staging.write(was.join(now, ["path", "is_file"], "full"), f"level{depth}")
        if seen is not None:
            seen.append(compared)
        differs = compared.filter(~F.col("was").eqNullSafe(F.col("now")))
        found = differs.filter("is_file").select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
                                                 .otherwise("modified").alias("change"))
        changes = found if changes is None else changes.unionAll(found)
        differing = differs.filter("NOT is_file").select(F.col("path").alias("parent"))
        if differing.isEmpty():
            return changes
        depth += 1
