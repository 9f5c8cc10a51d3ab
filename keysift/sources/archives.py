"""Container image archives as rows of files.

Tar streams have no built-in reader, so one ``mapInPandas`` step opens them with the standard library.  Archive and layers are
streamed one entry at a time; nothing is held but the file being read.  Everything after is ordinary columns.

Nothing is lost silently: an archive gives one row of its own, a layer one row before it is opened, and whatever cannot be
read (a broken or cut archive or layer, a bad compression header, a short or over-long file) one row with the error.

Most layers of a fleet of images are the same few base layers.  ``layer_manifest`` streams each archive once for the digests of its layers alone;
``expand_layers`` then opens each different layer in one of the places where it stands.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from keysift.operators.gates import MAX_IMAGE_BYTES
from keysift.sources.files import arrow_uri

FILE_SCHEMA = "image string, layer string, path string, length bigint, content binary, error string"
COLUMNS = ["image", "layer", "path", "length", "content", "error"]
BATCH_BYTES = 16 * 1024 * 1024
PIECE = 1 << 20
BROKEN = (tarfile.TarError, OSError, EOFError, zlib.error, ValueError)


class _Entry(tarfile.TarInfo):
    """An entry that remembers on its archive how reading headers ended."""

    @classmethod
    def fromtarfile(cls, archive: tarfile.TarFile) -> tarfile.TarInfo:
        try:
            return super().fromtarfile(archive)
        except tarfile.HeaderError as error:
            archive.ended = error
            raise


def _entries(stream: BinaryIO) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """The entries of a tar stream; an end without the end mark raises."""
    with tarfile.open(fileobj=stream, mode="r|", tarinfo=_Entry) as archive:
        for entry in archive:
            yield archive, entry
        ended = getattr(archive, "ended", None)
        if ended is not None and not isinstance(ended, tarfile.EOFHeaderError):
            raise tarfile.ReadError(str(ended) or "ends without an end mark")


def _read(stream: BinaryIO, size: int, keep: bool) -> tuple[int, bytes | None]:
    """Bytes that are there, up to ``size``; the body itself where it is kept."""
    if keep:
        body = stream.read(size)
        return len(body), body
    there = 0
    while there < size and (piece := stream.read(min(PIECE, size - there))):
        there += len(piece)
    return there, None


def _files(image: str, layer: str, stream: BinaryIO, max_bytes: int, bodies: bool) -> Iterator[tuple]:
    """The layer itself, then its regular files; every failure is a row."""
    yield image, layer, None, None, None, None
    name = None
    try:
        buffered = io.BufferedReader(stream) if not isinstance(stream, io.BufferedIOBase) else stream
        opened = gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
        for archive, entry in _entries(opened):
            name = entry.name
            if entry.type not in (tarfile.REGTYPE, tarfile.AREGTYPE):
                continue
            if entry.size > max_bytes:
                yield image, layer, name, entry.size, None, f"skipping large file: {name} ({entry.size} bytes)"
                continue
            there, body = _read(archive.extractfile(entry), entry.size, bodies)
            if there < entry.size:
                raise tarfile.ReadError(f"{name} has {there} of {entry.size} bytes")
            yield image, layer, name, entry.size, body, None
    except BROKEN as error:
        yield image, layer, None, None, None, f"layer scan error: {error}"


def _images(image: str, stream: BinaryIO, max_bytes: int, bodies: bool) -> Iterator[tuple]:
    """The image itself, then its layers and their files."""
    yield image, None, None, None, None, None
    try:
        head = stream.peek(1)
        if not head:
            return
        for archive, entry in _entries(stream):
            if entry.isdir():
                continue
            if entry.size > max_bytes:
                yield image, entry.name, None, None, None, f"skipping large file: {entry.name} ({entry.size} bytes)"
            elif entry.name.endswith(".tar") and entry.isreg():
                yield from _files(image, entry.name, io.BufferedReader(archive.extractfile(entry), PIECE), max_bytes, bodies)
    except BROKEN as error:
        yield image, None, None, None, None, f"tar error: {error}"


def _digests(image: str, stream: BinaryIO, max_bytes: int) -> Iterator[tuple]:
    """(image, place, layer, digest, length, error): the image itself without a place, its layers by their place in the archive, and what can't be read."""
    yield image, None, None, None, None, None
    place = 0
    try:
        if not stream.peek(1):
            return
        for archive, entry in _entries(stream):
            if entry.isdir():
                continue
            if entry.size > max_bytes:
                yield image, None, entry.name, None, entry.size, f"skipping large file: {entry.name} ({entry.size} bytes)"
            elif entry.name.endswith(".tar") and entry.isreg():
                body, digest, length = archive.extractfile(entry), hashlib.sha256(), 0
                try:
                    while piece := body.read(PIECE):
                        digest.update(piece)
                        length += len(piece)
                finally:  # a layer that the archive's end cuts counts as far as it goes
                    yield image, place, entry.name, digest.hexdigest(), length, None
                place += 1
    except BROKEN as error:
        yield image, None, None, None, None, f"tar error: {error}"


def _chosen(image: str, stream: BinaryIO, places: dict[int, str], max_bytes: int) -> Iterator[tuple]:
    """The files of the layers at ``places``, named by digest instead of image; what fails is a row as in ``_files``."""
    place, left = 0, set(places)
    try:
        for archive, entry in _entries(stream):
            if entry.isdir() or entry.size > max_bytes or not (entry.name.endswith(".tar") and entry.isreg()):
                continue
            if place in left:
                left.discard(place)
                for _, layer, path, length, content, error in _files(image, entry.name, io.BufferedReader(archive.extractfile(entry), PIECE), max_bytes, True):
                    yield places[place], layer, path, length, content, error
                if not left:
                    return
            place += 1
    except BROKEN:
        return  # the manifest has the error


def _batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows in frames of limited size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= BATCH_BYTES or len(held) >= 1000:
            yield pd.DataFrame(held, columns=COLUMNS)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=COLUMNS)


def _opened(path: str, content: bytes | None, codec: str | None = None) -> BinaryIO:
    if content is not None and codec is None:
        return io.BufferedReader(io.BytesIO(content))
    import pyarrow as pa
    from pyarrow import fs
    if content is not None:
        return io.BufferedReader(pa.CompressedInputStream(pa.BufferReader(content), codec), PIECE)
    store, place = fs.FileSystem.from_uri(arrow_uri(path))
    return io.BufferedReader(store.open_input_stream(place, compression=codec), PIECE)


def expand_archives(archives: DataFrame, max_bytes: int = MAX_IMAGE_BYTES, bodies: bool = True, codec: str | None = None) -> DataFrame:
    """One row per file of every layer, one per image (no layer), one per layer (no path) and one per error.

    ``archives`` has ``path`` and ``content``; without ``content`` each path (a URI of the shared store) is opened and streamed, so
    an archive may be of any size.  ``bodies=False`` reads everything and returns no file contents.  ``codec`` names the compression
    (of Arrow's, such as ``zstd`` or ``gzip``) in which whole archives are kept; they are decompressed as they are streamed.
    """
    held = "content" in archives.columns
    kept = archives.select("path", "content") if held else archives.select("path", F.lit(None).cast("binary").alias("content"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image, content in zip(frame["path"], frame["content"]):
                if held and content is None:
                    yield pd.DataFrame([(image, *[None] * 5), (image, *[None] * 4, "tar error: no content")], columns=COLUMNS)
                    continue
                try:
                    stream = _opened(image, content, codec)
                except (OSError, ValueError) as error:
                    yield pd.DataFrame([(image, *[None] * 5), (image, *[None] * 4, f"tar error: {error}")], columns=COLUMNS)
                    continue
                with stream:
                    yield from _batches(_images(image, stream, max_bytes, bodies))

    return kept.mapInPandas(split, FILE_SCHEMA)


MANIFEST_SCHEMA = "image string, place int, layer string, digest string, length bigint, error string"


def layer_manifest(archives: DataFrame, max_bytes: int = MAX_IMAGE_BYTES, codec: str | None = None) -> DataFrame:
    """(image, place, layer, digest, length, error): a row for each image, each layer with the digest of its bytes, and each error; no file is opened.

    ``archives`` and ``codec`` are as in ``expand_archives``.
    """
    held = "content" in archives.columns
    kept = archives.select("path", "content") if held else archives.select("path", F.lit(None).cast("binary").alias("content"))
    names = ["image", "place", "layer", "digest", "length", "error"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image, content in zip(frame["path"], frame["content"]):
                try:
                    if held and content is None:
                        raise ValueError("no content")
                    with _opened(image, content, codec) as stream:
                        rows = list(_digests(image, stream, max_bytes))  # one small row for each layer
                except (OSError, ValueError) as error:
                    rows = [(image, *[None] * 5), (image, *[None] * 4, f"tar error: {error}")]
                yield pd.DataFrame(rows, columns=names).astype({"place": "Int32", "length": "Int64"})

    return kept.mapInPandas(read, MANIFEST_SCHEMA)


def one_place_each(manifest: DataFrame) -> DataFrame:
    """(image, places): of each different layer the first place in order of image and place, gathered by image."""
    first = (manifest.filter(F.col("place").isNotNull()).groupBy("digest")
             .agg(F.min(F.struct("image", "place")).alias("at")).select("at.image", "at.place", "digest"))
    # no more entries than the image has layers
    return first.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("place", "digest"))).alias("places"))


def expand_layers(archives: DataFrame, places: DataFrame, max_bytes: int = MAX_IMAGE_BYTES, codec: str | None = None) -> DataFrame:
    """(digest, layer, path, length, content, error) of the layers at ``places`` (image, places); other archives are not opened, other layers passed over.

    Archives given by path are narrow rows that stand for much reading, so they are dealt to as many tasks as a shuffle of the session has, which
    adaptive execution leaves alone; given with content they meet ``places`` by broadcast where Spark finds that small.
    """
    held = "content" in archives.columns
    wanted = archives.join(places.withColumnRenamed("image", "path"), "path")
    rows = wanted.select("path", "content" if held else F.lit(None).cast("binary").alias("content"), F.to_json("places").alias("places"))
    if not held:  # in turn; by path they would lie as the join leaves them
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image, content, at in zip(frame["path"], frame["content"], frame["places"]):
                with _opened(image, content, codec) as stream:
                    for batch in _batches(_chosen(image, stream, {int(k): v for k, v in json.loads(at).items()}, max_bytes)):
                        yield batch.rename(columns={"image": "digest"})

    return rows.mapInPandas(split, FILE_SCHEMA.replace("image string", "digest string"))
