"""WARC archives of a table of pages, and indexed reads from them.

*Writing.*  Each task writes one archive to the shared folder, one gzip member per record, and returns the index: file, offset, length,
URL and digest of every record.  The archive is written under a name of its own for each attempt; only what the index names is
ever read, so a repeated attempt does no harm.  Of records with equal payloads of at least ``REVISIT`` bytes, the one with the
smallest id is a response and the others are revisits that refer to it and carry no payload.

*Reading.*  The selected records' index rows are put in order of file and offset; neighbours whose gap is at most
``GAP`` bytes are read as one range of up to ``RANGE`` bytes, and records are cut from it; results leave in batches of about that size.  A very long record is a range of its own.

The tasks that read are as many as the records' bytes ask for, ``TASK`` each, and no fewer than the cluster has cores.

*Skew.*  To find copies only digests are shuffled, pre-aggregated; those that repeat are written as a table.  If a count proves it to be of at most ``SENT`` rows it
is broadcast to the pages and no payload moves; a larger one is joined by sort-merge, which moves each payload once and splits a hot digest.

*Defined results.*  A null page has an empty payload and is a response; a null URL is written as an empty header.  Rows equal in id, URL and payload are
one page and all responses; of rows equal in id and payload only, one URL leads.  Null ids come last among copies; a payload whose ids are all null is never a revisit.
An empty table gives no archive and an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from keysift.sources.staging import Staging

REVISIT = 100
GAP = 64 << 10
RANGE = 4 << 20
TASK = 64 << 20
SENT = 1_000_000
INDEX = T.StructType([T.StructField(n, k) for n, k in (
    ("id", T.LongType()), ("url", T.StringType()), ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()),
    ("digest", T.StringType()), ("payload_bytes", T.LongType()), ("record_type", T.StringType()), ("refers_to", T.LongType()))])
RECORD = T.StructType([T.StructField(n, k) for n, k in (
    ("id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()),
    ("digest", T.StringType()), ("payload_bytes", T.LongType()), ("payload", T.BinaryType()))])


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def _header(value: object) -> str:
    """A header value on one line: line ends are percent-encoded (the index has the URL as it was)."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One gzip member with a record: a revisit when ``first`` is given."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Page: {_header(page)}", f"X-Payload-Length: {len(payload)}", f"X-Null-URI: {int(url is None)}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {first}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "replace") + payload + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> dict:
    """The record in one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    number = lambda name: int(fields[name]) if fields.get(name) else None
    kind = fields["WARC-Type"]
    return {"id": number("X-Page"), "url": None if fields["X-Null-URI"] == "1" else fields["WARC-Target-URI"],
            "record_type": kind, "refers_to": number("X-Refers-To-Page"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload_bytes": number("X-Payload-Length"), "payload": rest[:int(fields["Content-Length"])] if kind == "response" else None}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _digest():
    return F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)


def _copies(pages: DataFrame, staging: Staging) -> DataFrame:
    """(digest, first, uid): the response of each payload that occurs more than once and is long enough."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    long = pages.select("id", "uid", _digest().alias("digest"), size.alias("size")).filter(F.col("size") >= REVISIT)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid"))
    found = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("x")).filter("n > 1 AND x.id IS NOT NULL")
    return staging.write(found.select("digest", F.col("x.id").alias("first"), F.col("x.uid").alias("first_uid")), "copies")


def write_archives(pages: DataFrame, staging: Staging, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Writes the archives and returns their index, itself a table in the shared folder."""
    rows = pages.select(pages[id_col].cast("bigint").alias("id"), pages[url_col].cast("string").alias("url"),
                        pages[html_col].cast("string").alias("html"))
    rows = rows.withColumn("uid", F.xxhash64("url"))
    copies = _copies(rows, staging)
    few = copies.count() <= SENT  # the size is checked
    joined = rows.withColumn("digest", _digest()).join(F.broadcast(copies) if few else copies.hint("merge"), "digest", "left")
    ready = joined.select("id", "url", "html", "digest", "first",
                          (F.col("first").isNotNull() & F.col("id").eqNullSafe(F.col("first"))
                           & F.col("uid").eqNullSafe(F.col("first_uid"))).alias("leads"))
    folder = staging.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at = None, f"{base}/{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                found = []
                for x in batch.to_pylist():
                    payload = (x["html"] or "").encode("utf-8", "replace")
                    first = x["first"] if x["first"] is not None and not x["leads"] else None
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    member = record(x["id"], x["url"], payload, x["digest"], first)
                    out.write(member)
                    found.append({"id": x["id"], "url": x["url"], "file": name, "offset": at, "length": len(member), "digest": x["digest"],
                                  "payload_bytes": len(payload), "record_type": "response" if first is None else "revisit", "refers_to": first})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(found, _arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return staging.write(ready.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected ``index`` rows, read in coalesced ranges; ``folder`` is that of the archives."""
    wanted = index.select("file", "offset", "length")
    volume = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-volume // TASK))
    ordered = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        handle, opened = None, None
        for batch in batches:
            rows, i = batch.to_pylist(), 0
            while i < len(rows):
                x, j = rows[i], i + 1
                end = x["offset"] + x["length"]
                while j < len(rows) and rows[j]["file"] == x["file"] and rows[j]["offset"] - end <= GAP \
                        and rows[j]["offset"] + rows[j]["length"] - x["offset"] <= RANGE:
                    end = max(end, rows[j]["offset"] + rows[j]["length"])
                    j += 1
                if opened != x["file"]:
                    if handle is not None:
                        handle.close()
                    handle, opened = store.open_input_file(x["file"]), x["file"]
                data = handle.read_at(end - x["offset"], x["offset"])
                cut = [r["offset"] - x["offset"] for r in rows[i:j]]
                found, held = [], 0
                for a, r in zip(cut, rows[i:j]):
                    found.append(parse(data[a:a + r["length"]]))
                    held += len(found[-1]["payload"] or b"")
                    if held > RANGE:
                        yield pa.RecordBatch.from_pylist(found, _arrow(RECORD))
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, _arrow(RECORD))
                i = j
        if handle is not None:
            handle.close()

    return ordered.mapInArrow(read, RECORD)
