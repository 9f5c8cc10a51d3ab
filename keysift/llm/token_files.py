"""Token counts of the documents in flat token files that have no index.

A token file is a plain sequence of little-endian identifiers of one width; a separator ends each document.  Files are cut into blocks of
``BLOCK`` bytes, whichever file they belong to; each block is searched for separators in one vectorised pass and yields the lengths of
the pieces between them, at most ``PIECES`` in a row.  The number of separators before each block, a prefix sum over narrow rows of one per block, gives
every piece its document's number in the file.  Pieces with a separator on both sides are documents; pieces at the
edges of blocks are added up by document, so a document may lie across any number of blocks.

*Defined results.*  Adjacent separators are an empty document.  Identifiers after the last separator are a document marked as
not closed; nothing after it is no document.  An empty file has no documents.  A file that is no whole number of identifiers is an error.  A folder that is not there has no files.
In ``write_tokens`` a null text reads as empty, rows with equal ids or texts are documents of their own, and no columns but the two named are read; an empty table writes no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from keysift.llm import bpe
from keysift.llm.words import slices, text_column
from keysift.sources.staging import Staging

BLOCK = 32 << 20
SEPARATOR = 50256
PIECES = 1 << 16
FOUND = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("separators", T.LongType()),
                      T.StructField("first", T.LongType()),
                      T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType()))])


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else "file://" + uri)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the token files in a folder; contents are not read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "file string, bytes bigint")
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def count_tokens(files: DataFrame, staging: Staging, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, number, start, n_tokens, closed) of every document in ``files`` (file, bytes); starts count identifiers from 0."""
    block -= block % width
    spans = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {block}"))).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                if x["bytes"] % width:
                    raise ValueError(f"{x['file']} is no whole number of identifiers")
                store, path = _store(x["file"])
                first = x["block"] * block
                with store.open_input_file(path) as handle:
                    data = np.frombuffer(handle.read_at(min(block, x["bytes"] - first), first), f"<u{width}")
                at = np.flatnonzero(data == separator)
                starts = np.concatenate([[0], at + 1])
                sizes = np.concatenate([at, [len(data)]]) - starts
                for k in range(0, len(starts), PIECES):
                    one = [[x["file"]], [x["block"]], [len(at)], [k], [starts[k:k + PIECES] + first // width], [sizes[k:k + PIECES]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, (pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2))], FOUND.names)

    found = staging.write(spans.repartition("file", "block").mapInArrow(scan, FOUND), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = found.filter("first = 0").select("file", "block", F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("base"))
    pieces = (found.join(base, ["file", "block"])
              .select("file", "base", "separators", "first", F.posexplode(F.arrays_zip("starts", "sizes")).alias("k", "x"))
              .withColumn("k", F.col("k") + F.col("first"))
              .select("file", (F.col("base") + F.col("k")).alias("number"), F.col("x.starts").alias("start"),
                      F.col("x.sizes").alias("n_tokens"), (F.col("k") < F.col("separators")).alias("closed"),
                      ((F.col("k") > 0) & (F.col("k") < F.col("separators"))).alias("whole")))
    inner = pieces.filter("whole").drop("whole")
    edges = (pieces.filter("NOT whole").groupBy("file", "number")
             .agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.max("closed").alias("closed"))
             .filter("closed OR n_tokens > 0"))
    return inner.unionByName(edges)


def write_tokens(docs: DataFrame, staging: Staging, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR) -> DataFrame:
    """Encodes the texts by the public byte-level vocabulary into token files, one for each task, and returns what was written in which order:
    (file, number, id).  Files of attempts that failed are not named in it."""
    where, rule = bpe.public_ranks()
    folder = staging.path("tokens")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("number", T.LongType()), rows.schema["id"]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, (store, base) = bpe.codec(where, rule), _store(folder)
        name, out, number = f"{uuid.uuid4().hex}.bin", None, 0
        try:
            for batch in slices(batches, text_column):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for ids in by.encode(pc.fill_null(batch.column("text"), "").to_pylist()):
                    out.write(np.array([*ids, separator], "<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(number, number + n), pa.int64()),
                                                  batch.column("id")], ["file", "number", "id"])
                number += n
        finally:
            if out is not None:
                out.close()

    return staging.write(rows.mapInArrow(write, schema), "written")
