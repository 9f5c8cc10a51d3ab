"""Words of many texts at once, found on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW = 1 << 18


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


#: Bytes of words after lower-casing: digits, letters, and every byte of a character beyond ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _powers(base: int) -> np.ndarray:
    out = np.full(WINDOW, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def carried(docs: DataFrame, text_col: str, keep: list[str] | None = None) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """Rows as one struct ``row`` (of the columns ``keep``, or all), so that no name can clash, and what gives a batch's texts.

    A text that is among the kept columns is not sent a second time.
    """
    names = keep or docs.columns
    row = F.struct(*[docs[c] for c in names]).alias("row")
    if text_col in names and docs.schema[text_col].dataType == T.StringType():
        return docs.select(row), lambda batch: batch.column("row").field(text_col)
    return docs.select(row, docs[text_col].cast("string").alias("text")), lambda batch: batch.column("text")


def slices(batches: Iterator[pa.RecordBatch], texts: Callable[[pa.RecordBatch], pa.Array], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(texts(batch)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_column(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text")


@dataclass
class Words:
    """Words of some texts: byte places, a 64-bit hash each, and where each text's words begin."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of length texts + 1


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES) -> Words:
    """Maximal runs of ``kind`` within each text.  ``data`` is lower-cased already.

    The hash is a polynomial over the bytes of a word, read off running sums that are kept for one window at a time.
    """
    inside = kind[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.zeros(len(start), np.uint64)
    base = np.uint64(BASE)
    for lo in range(0, len(data), WINDOW // 2):
        # words that begin in this half window; longer ones are finished by hand
        a, b = np.searchsorted(start, (lo, lo + WINDOW // 2))
        if a == b:
            continue
        whole = a + int(np.searchsorted(end[a:b], lo + WINDOW, "right"))
        chunk = data[lo:lo + WINDOW].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(chunk) + 1, np.uint64)
        np.cumsum(chunk * _UP[:len(chunk)], out=sums[1:])
        s, e = start[a:whole] - lo, end[a:whole] - lo
        hashes[a:whole] = (sums[e] - sums[s]) * _DOWN[s]
        for i in range(whole, b):
            total, scale = np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for at in range(start[i], end[i], WINDOW):
                    part = data[at:min(at + WINDOW, end[i])].astype(np.uint64) + np.uint64(1)
                    total += scale * (part * _UP[:len(part)]).sum(dtype=np.uint64)
                    scale *= _UP[-1] * base
            hashes[i] = total
    hashes ^= hashes >> np.uint64(29)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes that are ``inside``, each within one text, as strings, and where each text's runs begin."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    before = np.cumsum(inside, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    places = np.append(before[start] - 1, before[-1]) if len(start) else np.zeros(1, np.int64)
    flat = pa.py_buffer(np.ascontiguousarray(data[inside]))
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), flat)
    return found, np.searchsorted(start, offsets)


def word_hash(word: bytes) -> int:
    """The hash that ``find_words`` gives ``word``."""
    data = np.frombuffer(word, np.uint8)
    return int(find_words(data, np.array([0, len(data)]), np.ones(256, bool)).hash[0])
