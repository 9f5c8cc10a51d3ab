"""Benchmark decontamination: one FM-index per shard of training text, searched for the windows of the items.

A-Z are lower-cased; words are runs of digits, letters and characters beyond ASCII.  A window is ``size``
consecutive words of an item; an item with fewer, but not none, is one window.  A shard is a bounded run of
words (``SHARD``) of some documents of one task; shards overlap by ``size - 1`` words, so no occurrence is cut, and
texts are parted by symbols of their own, so none crosses from text to text.  In each shard all windows are
searched backwards through wavelet-tree ranks, occurrences are located from sampled suffix places, compared
word by word, and merged to spans.

Item rows are made distinct and taken in blocks of about ``BLOCK`` bytes, picked by hash; a block's windows are arrays of numbers.  With one block the documents
are read once and nothing is shuffled.  With more, each block is a pass of its own: it is broadcast, its narrow findings are written to the shared folder, and it is given up
before the next is collected, so that driver and workers hold one block at a time; the findings are merged by row number and joined to the documents at the end.

*Defined results.*  Null and empty texts have no words.  Item rows that repeat count once; an item without id is
removed from the documents like any other but not listed or counted.  Long texts are cut into shards like any others.  Document rows with equal ids are rows
of their own; columns of any name are carried inside ``row``.  Empty tables give no rows, or rows without findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from keysift.llm.fm_index import FmIndex
from keysift.llm.words import LOWER, WORD_BYTES, carried, column_bytes, find_words, runs, slices, text_column
from keysift.sources.staging import Staging

SHARD = 1 << 18
BLOCK = 4 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(SPAN)), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])


class Windows:
    """The distinct windows of a block of items as arrays, ready to be looked up.

    ``hashes`` has a row of word hashes for each window, right-aligned; a window's words are words ``first`` to ``first + lengths`` of the block's
    (``text`` without separators, cut at ``cuts``), and the items that own it stand in ``owner`` between two of ``owned``.
    """

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        raw, offsets = column_bytes(pa.array([x or "" for _, x in items], pa.large_string()))
        low = LOWER[raw]
        found, begin = runs(low, offsets, WORD_BYTES[low])
        coded = found.dictionary_encode()
        code, n = coded.indices.to_numpy().astype(np.int64), np.diff(begin)
        words = find_words(low, offsets)  # of the same words in the same order
        counts = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), counts)
        start = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        lengths = np.minimum(n[item], size)
        rows = np.full((len(item), size), -1, np.int32)
        for k in range(size):
            there = k < lengths
            rows[there, size - 1 - k] = code[start[there] + lengths[there] - 1 - k]
        distinct, where = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        where, total = where.ravel(), len(distinct)
        some = np.zeros(total, np.int64)
        some[where[::-1]] = np.arange(len(where))[::-1]
        self.size, self.count, self.first, self.lengths = size, total, start[some], lengths[some].astype(np.int64)
        self.used = distinct >= 0
        hash_of = np.zeros(len(coded.dictionary), np.uint64)
        hash_of[code] = words.hash
        self.hashes = np.where(self.used, hash_of[distinct], np.uint64(0)) if total else np.zeros((0, size), np.uint64)
        self.text, self.cuts = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(found.buffers()[1], np.int64)[:len(found) + 1].copy()
        self.names = [x for x, _ in items]
        pairs = np.unique(where * max(len(items), 1) + item)
        self.owner = (pairs % max(len(items), 1)).astype(np.int32)
        self.owned = np.searchsorted(pairs // max(len(items), 1), np.arange(total + 1))

    def words(self, w: int) -> tuple[bytes, ...]:
        cuts = self.cuts[self.first[w]:self.first[w] + self.lengths[w] + 1].tolist()
        return tuple(self.text[a:b] for a, b in zip(cuts, cuts[1:]))

    def items(self, w: int) -> set[str]:
        return {self.names[i] for i in self.owner[self.owned[w]:self.owned[w + 1]].tolist()} - {None}


def _occurrences(windows: Windows, hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence in one shard, given its word hashes and the text of each word."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, symbols = np.unique(hashes, return_inverse=True)
    # windows with a word that the shard lacks are out
    where = np.minimum(np.searchsorted(known, windows.hashes), len(known) - 1)
    able = np.flatnonzero(((known[where] == windows.hashes) | ~windows.used).all(axis=1))
    if not len(able):
        return none
    cuts = np.flatnonzero(np.diff(text_of)) + 1  # a symbol of its own between two texts, and one at the end
    parts = len(cuts) + 1
    sequence = np.insert(symbols + parts, np.append(cuts, len(symbols)), np.arange(parts))
    index = FmIndex(sequence, parts + len(known))
    low, high = index.search(where[able] + parts, windows.lengths[able])
    counts = np.maximum(high - low, 0)
    if not counts.any():
        return none
    rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    place = index.locate(rows)
    return np.repeat(able, counts), place - np.searchsorted(cuts + np.arange(1, parts), place, "right") if parts > 1 else place


def _ranges(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _search(column: pa.Array, windows: Windows) -> list[tuple]:
    """What is found in each text of one slice, the fields of FOUND."""
    raw, offsets = column_bytes(column)
    low = LOWER[raw]
    words = find_words(low, offsets, WORD_BYTES)
    n, first = len(words.start), words.first
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    covered = np.zeros(n, bool)
    items: dict[int, set[str]] = {}
    step = SHARD - windows.size + 1
    for at in range(0, max(n - windows.size + 1, 1) if windows.count and n else 0, step):
        window, place = _occurrences(windows, words.hash[at:at + SHARD], text_of[at:at + SHARD])
        place = place + at
        sure: dict[tuple[int, bytes], bool] = {}
        for w, p in zip(window.tolist(), place.tolist()):
            stop = p + int(windows.lengths[w])
            text = low[words.start[p]:words.end[stop - 1]].tobytes()
            if (w, text) not in sure:
                sure[w, text] = tuple(WORD.findall(text)) == windows.words(w)
            if sure[w, text]:
                covered[p:stop] = True
                items.setdefault(int(text_of[p]), set()).update(windows.items(w))
    out, hit = [], set(np.unique(text_of[covered]).tolist())
    for i in range(len(offsets) - 1):
        if i not in hit:
            out.append((int(first[i + 1] - first[i]), [], [], sorted(items.get(i, ()))))
            continue
        starts, ends = _ranges(covered[first[i]:first[i + 1]])
        begin = np.cumsum(raw[offsets[i]:offsets[i + 1]] & 0xC0 != 0x80)  # characters up to each byte
        from_, to = words.start[first[i] + starts] - offsets[i], words.end[first[i] + ends - 1] - offsets[i]
        out.append((int(first[i + 1] - first[i]),
                    [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)],
                    [{"start": int(a), "end": int(b)} for a, b in zip(begin[from_] - 1, begin[to - 1])],
                    sorted(items.get(i, ()))))
    return out


def _found(rows: list[tuple]) -> pa.Array:
    return pa.array([dict(zip(("n_words", "hits", "spans", "items"), x)) for x in rows], ARROW)


def _united(spans: Iterable[dict]) -> list[dict]:
    """Spans in order, those that meet or overlap as one."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def _merged(parts: list[dict]) -> tuple:
    """What several passes found in one text.  In characters a merged hit reaches from the start of its first part to the end of its last."""
    hits = _united(x for p in parts for x in p["hits"])
    spans = [{"start": a["start"], "end": b["end"]} for a, b in _edges(parts, hits)]
    return max(p["n_words"] for p in parts), hits, spans, sorted(set().union(*(p["items"] for p in parts)))


def _edges(parts: list[dict], hits: list[dict]) -> Iterator[tuple[dict, dict]]:
    """For each merged hit, the spans in characters of a first and a last part of it."""
    placed = [(h, s) for p in parts for h, s in zip(p["hits"], p["spans"])]
    starts, ends = {h["start"]: s for h, s in placed}, {h["end"]: s for h, s in placed}
    return ((starts[h["start"]], ends[h["end"]]) for h in hits)


def _distinct_items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, text), each once, and the number of blocks."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return items, max(1, -(-total // BLOCK))


def _collected(items: DataFrame, k: int, blocks: int, size: int) -> Windows:
    part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
    return Windows([(r["item"], r["text"]) for r in part.toLocalIterator()], size)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", size: int = 10, keep: list[str] | None = None) -> DataFrame:
    """(row, found) for every row of ``docs``: ``row`` is the row as a struct (of the columns ``keep``, or all), ``found`` holds the number of words, merged
    spans of hit words (``hits``, in words; ``spans``, in characters; ends exclusive) and the sorted ids of the items that occur."""
    spark = docs.sparkSession
    items, blocks = _distinct_items(benchmark, item_id, item_text)
    if blocks > 1:
        return _in_passes(docs, items, blocks, text_col, size, keep)
    out, texts = carried(docs, text_col, keep)
    shared = spark.sparkContext.broadcast(_collected(items, 0, 1, size))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, texts):
            yield pa.RecordBatch.from_arrays([batch.column("row"), _found(_search(texts(batch), shared.value))], ["row", "found"])

    return out.mapInArrow(search, T.StructType([out.schema["row"], T.StructField("found", FOUND)]))


def _in_passes(docs: DataFrame, items: DataFrame, blocks: int, text_col: str, size: int, keep: list[str] | None) -> DataFrame:
    """``contamination`` with one block of items after the other."""
    spark, staging = docs.sparkSession, Staging(docs.sparkSession, "decontaminate")
    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    numbered = staging.write(docs.select(F.monotonically_increasing_id().alias("number"), row, docs[text_col].cast("string").alias("text")), "documents")
    kind = T.StructType([T.StructField("number", T.LongType()), T.StructField("found", FOUND)])
    found = None
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(_collected(items, k, blocks, size))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, all_rows=not k) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_column):
                rows = _search(batch.column("text"), shared.value)
                kept = [i for i, x in enumerate(rows) if all_rows or x[1]]  # the first pass counts the words of every text
                yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(kept, pa.int64())), _found([rows[i] for i in kept])], ["number", "found"])

        part = staging.write(numbered.select("number", "text").mapInArrow(search, kind), f"found{k}")
        shared.destroy()
        found = part if found is None else found.unionAll(part)
    # one entry for each block at most
    lists = found.groupBy("number").agg(F.collect_list("found").alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("number"), _found([_merged(x) for x in batch.column("parts").to_pylist()])], ["number", "found"])

    return numbered.select("number", "row").join(lists.mapInArrow(merge, kind), "number").select("row", "found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which a window of ``benchmark`` occurs."""
    return contamination(docs, benchmark, **options).filter(F.size("found.hits") == 0).select("row.*")
