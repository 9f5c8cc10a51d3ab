"""Files and text tables as input frames."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.operators.gates import (MAX_FILE_BYTES, MAX_IMAGE_BYTES, MIB, file_length, gate_files, gate_paths, is_binary, is_inside_git,
                                     is_scannable_path, is_skipped_in_image, readable_text, slashes)
from keysift.operators.allow import is_allowed_path
from keysift.rules.pack import RulePack
from keysift.sources.staging import materialized


READ_TASK_BYTES = 256 * MIB
MOST_READ_TASKS = 100_000
LISTED_AT_ONCE = 10_000


def arrow_uri(root: str) -> str:
    """``root`` as a URI that Arrow's file systems accept; a plain path is a local one."""
    scheme, colon, rest = root.rstrip("/").partition(":")
    local = not colon or "/" in scheme or scheme == "file"
    if local:
        plain = rest if scheme == "file" and colon else root.rstrip("/")
        return "file://" + quote("/" + plain.lstrip("/"))
    return f"{scheme}:{quote(rest, safe='/:@')}"


def _entries(uri: str):
    """Lists each folder of its input, not what lies below: (place under the root, length), the length null for a folder."""
    def lists(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(uri)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for place in batch.column("place").to_pylist():
                here = store.get_file_info(f"{base}/{place}" if place else base)
                if here.type == fs.FileType.NotFound:
                    raise FileNotFoundError(here.path)
                found = store.get_file_info(fs.FileSelector(here.path)) if here.type == fs.FileType.Directory else [here]
                rows = [(i.path[len(base) + 1:], i.size if i.type == fs.FileType.File else None) for i in found
                        if i.type == fs.FileType.File
                        or i.type == fs.FileType.Directory and not (local and os.path.islink(i.path))]
                for start in range(0, len(rows), LISTED_AT_ONCE):
                    part = rows[start:start + LISTED_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()),
                                                      pa.array([n for _, n in part], pa.int64())], ["place", "length"])
    return lists


def list_files(spark: SparkSession, root: str, relative: bool = False) -> DataFrame:
    """(path, length, place) of every file under ``root``, without reading any; with ``relative`` paths start below ``root``.

    The built-in reader passes over names that start with a dot or an underscore, and secrets often
    lie in ``.env``; so folders are listed here, level by level: one Spark job for all folders of a depth.
    Links to local folders are not followed.
    """
    uri = arrow_uri(root)
    level = spark.createDataFrame([("",)], "place string")
    files = None
    while True:
        entries = materialized(level.mapInArrow(_entries(uri), "place string, length bigint"))
        found = entries.filter(F.col("length").isNotNull())
        files = found if files is None else files.unionByName(found)
        level = entries.filter(F.col("length").isNull()).select("place")
        if level.isEmpty():
            break
        level = level.repartition(spark.sparkContext.defaultParallelism, "place")
    shown = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.col("place") if relative else F.when(F.col("place") == "", shown).otherwise(F.concat(F.lit(shown + "/"), "place"))
    return files.select(path.alias("path"), "length", "place")


def read_files(spark: SparkSession, root: str, pack: RulePack | None = None, max_bytes: int = MAX_FILE_BYTES,
               relative: bool = False) -> DataFrame:
    """(path, length, content) of the files under ``root`` that pass the gates on size and path (and, with ``pack``, its path allowlist).

    The gates work on the listing; only files that pass are opened, in tasks of about
    ``READ_TASK_BYTES`` each whatever folder they lie in.  Those left out are in ``skipped_files``.  A
    file that cannot be read is an error.
    """
    wanted = gate_files(list_files(spark, root, relative), max_bytes=max_bytes)
    if pack is not None:
        wanted = gate_paths(wanted, pack)
    volume = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(spark.sparkContext.defaultParallelism, volume // READ_TASK_BYTES), MOST_READ_TASKS)
    return wanted.repartition(tasks, "place").mapInArrow(_contents(arrow_uri(root)), "path string, length bigint, content binary")


def _contents(uri: str):
    """Opens the listed files one by one through Arrow's file systems."""
    def reads(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, length, place in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "place")]):
                with store.open_input_file(f"{base}/{place}" if place else base) as handle:
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([length], pa.int64()),
                                                      pa.array([handle.read()], pa.binary())], ["path", "length", "content"])
    return reads


def skip_reason(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, pack: RulePack | None = None) -> Column:
    """Why the gates leave a file out; null for files that are scanned."""
    name = slashes(F.coalesce(F.col("path"), F.lit("")))
    reason = (F.when(file_length(files) > max_bytes, "size").when(is_inside_git(name), "git folder")
              .when(~is_scannable_path(name), "extension"))
    if pack is not None:
        reason = reason.when(is_allowed_path(name, pack), "path allowlist")
    if_binary = F.when(is_binary(F.col("content")), "binary")
    return F.coalesce(reason, if_binary)


def skipped_files(files: DataFrame, pack: RulePack | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, length, reason) of every file that a scan leaves out; without ``content`` the test for binary files is left out too."""
    seen = files if "content" in files.columns else files.withColumn("content", F.lit(None).cast("binary"))
    return seen.select("path", "length", skip_reason(seen, max_bytes, pack).alias("reason")).filter(F.col("reason").isNotNull())


def skipped_image_files(files: DataFrame, max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """(path, length, reason) of every file that the scan of an extracted image leaves out."""
    reason = (F.when(file_length(files) > max_bytes, "size")
              .when(F.coalesce(is_skipped_in_image(F.col("path")), F.lit(False)), "extension"))
    return files.select("path", "length", reason.alias("reason")).filter(F.col("reason").isNotNull())


def files_as_text(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content text) of the files that pass all file gates."""
    kept = gate_files(files, max_bytes=max_bytes).filter(~is_binary(F.col("content")))
    return kept.withColumn("content", readable_text(F.col("content")))


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts, with the splits that Spark gives it; nothing is moved."""
    return spark.read.parquet(path)
