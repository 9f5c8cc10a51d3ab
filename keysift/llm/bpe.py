"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Ranks come from a file of base-64 tokens and numbers.  The library works on characters that stand for bytes, so the ranks'
tokens go through the byte-to-character table, and every way to join two tokens into a third becomes a merge, in
order of the third's rank: what merges is then decided by ranks alone.  Texts are first cut by
the pattern; each distinct cut that a worker has not met before is encoded by the library, in batches, and
encodings of short cuts are kept in a table of bounded size.

Offsets are in characters.  A token that holds only a part of a character's bytes covers that whole
character.  Decoding reverses the byte table; bytes are joined over the whole sequence before they are read as UTF-8, so that
characters split between tokens come out whole, and what is not UTF-8 becomes U+FFFD.

*Defined results.*  Null and empty texts have no tokens.  Null ids within a sequence, and ids without a token, decode to nothing.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from keysift.llm.words import carried, column_bytes, slices

KEPT = 100_000
SHORT = 48
TOGETHER = 64
MORE = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
OFFSETS = [T.StructField("starts", T.ArrayType(T.IntegerType(), False)), T.StructField("ends", T.ArrayType(T.IntegerType(), False))]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _letters_and_numbers(last: int) -> tuple[str, str]:
    """Bodies of character classes for the general categories L and N, up to the character ``last``."""
    out = []
    for kind in "LN":
        ranges, start = [], None
        for code in range(last + 2):
            inside = code <= last and unicodedata.category(chr(code))[0] == kind
            if inside and start is None:
                start = code
            elif not inside and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
                start = None
        out.append("".join(ranges))
    return out[0], out[1]


def compiled(pattern: str, last: int = sys.maxunicode) -> re.Pattern:
    """A pattern with \\p{L} and \\p{N} for Python's matcher, for texts without characters beyond ``last``; white space is that of Unicode, without
    the separators U+001C to U+001F."""
    letters, numbers = _letters_and_numbers(last)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    text = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    text = text.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(text.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


class Codec:
    """Encodes and decodes by one rank file."""

    def __init__(self, file: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models
        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        shown = byte_characters()
        name = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
        merges = [(name[token[:i]], name[token[i:]]) for token in sorted(ranks, key=ranks.get)
                  for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True,
                                            cache_capacity=0))
        self.bytes = {r: t for t, r in ranks.items()}
        self.table = pa.array([self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)], pa.binary())
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        self.sizes[list(self.bytes)] = [len(t) for t in self.bytes.values()]
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(shown)})
        self.cut_any = compiled(pattern).findall
        # Python's matcher looks classes up to U+FFFF up at once, and goes through the ranges beyond one by one wherever a run ends
        self.cut_plane = compiled(pattern, 0xFFFF).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def cut(self, text: str) -> list[str]:
        beyond = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return (self.cut_any if beyond else self.cut_plane)(text)

    def _fill(self, cuts: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each cut.  The library gets many cuts as one sequence of words; tokens cover every byte, so their sizes tell where a cut ends."""
        new = list(cuts)
        mapped = [x.encode("utf-8", "replace").decode("latin-1").translate(self.shown) for x in new]
        words = [mapped[i:i + TOGETHER] for i in range(0, len(mapped), TOGETHER)]
        coded = self.library.encode_batch_fast(words, is_pretokenized=True, add_special_tokens=False)
        ids = list(chain.from_iterable(e.ids for e in coded))
        places, ends = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, mapped), np.int64, len(mapped)))
        if len(new) and (not len(ids) or places[-1] != ends[-1]):  # ranks that lack a byte
            return dict(zip(new, (tuple(e.ids) for e in self.library.encode_batch_fast(mapped, add_special_tokens=False))))
        stops = np.searchsorted(places, ends, "right").tolist()
        return dict(zip(new, (tuple(ids[a:b]) for a, b in zip([0, *stops], stops))))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        parts = [self.cut(x) for x in texts]
        missing = set(chain.from_iterable(parts)).difference(self.kept)
        fresh = self._fill(missing)
        self.kept.update((k, v) for k, v in fresh.items() if len(k) <= SHORT)
        table = self.kept if all(len(k) <= SHORT for k in fresh) else {**self.kept, **fresh}
        return [list(chain.from_iterable(map(table.__getitem__, x))) for x in parts]

    def offsets(self, column: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character, and the character after the last, of each token of some texts; ``flat`` are their ids, ``sizes`` the ids of each."""
        raw, edges = column_bytes(column)
        character = np.cumsum(raw & 0xC0 != 0x80)  # of all characters, the number up to each byte
        first = np.repeat(edges[:-1], sizes)
        before = np.where(first > 0, character[first - 1] if len(raw) else 0, 0)
        ends = np.cumsum(self.sizes[flat])  # tokens cover every byte, text after text
        return character[ends - self.sizes[flat]] - 1 - before, character[ends - 1] - before

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of several texts from their ids, all of which must be of the vocabulary: tokens looked up one after the other, cut where texts end."""
        tokens = self.table.take(lists.values)
        ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        cuts = pa.py_buffer(np.ascontiguousarray(ends[lists.offsets.to_numpy()]))
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, cuts, tokens.buffers()[2] or pa.py_buffer(b"")])

    def decode(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            return b"".join(self.bytes.get(i, b"") for i in ids)


@lru_cache(maxsize=2)
def codec(file: str, pattern: str) -> Codec:
    return Codec(file, pattern)


def public_ranks() -> tuple[str, str]:
    """The installed public vocabulary: (rank file, pattern)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.fromiter(chain.from_iterable(values), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, file: str | None = None,
           pattern: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(row, ids): the row as a struct (of the columns ``keep``, or all) and the ids of its text, with
    ``starts`` and ``ends`` of the tokens in characters where ``offsets`` are asked for, and ``decoded_bytes``, what ``decode`` makes of the
    ids, where ``decoded`` is: a round trip in one pass, with one worker for each task.  ``file`` must be readable on all executors."""
    where, rule = public_ranks()
    where, rule = file or where, pattern or rule
    out, texts_of = carried(docs, text_col, keep)
    names = ["row", "ids", *(["starts", "ends"] if offsets else []), *(["decoded_bytes"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(where, rule)
        for batch in slices(batches, texts_of):
            texts = pc.fill_null(texts_of(batch), "").to_pylist()
            ids = by.encode(texts)
            lists = _lists(ids, pa.int32())
            columns = [batch.column("row"), lists]
            if offsets:
                places = by.offsets(texts_of(batch), lists.values.to_numpy(), np.diff(lists.offsets.to_numpy()))
                columns += [pa.ListArray.from_arrays(lists.offsets, pa.array(x, pa.int32())) for x in places]
            if decoded:
                columns.append(by.decode_all(lists))
            yield pa.RecordBatch.from_arrays(columns, names)

    back = [T.StructField("decoded_bytes", T.BinaryType())] if decoded else []
    return out.mapInArrow(run, T.StructType([out.schema["row"], *MORE, *(OFFSETS if offsets else []), *back]))


def decode(encoded: DataFrame, ids_col: str = "ids", file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with the columns ``decoded_bytes`` and ``decoded``, which replace any of these names."""
    where, rule = public_ranks()
    where, rule = file or where, pattern or rule
    rest = [c for c in encoded.columns if c not in ("decoded_bytes", "decoded")]
    out = encoded.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(where, rule)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lists = part.column(ids_col)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
                raw = [by.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)]
                text = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary()), text], [*rest, "decoded_bytes", "decoded"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("decoded_bytes", T.BinaryType()),
                                             T.StructField("decoded", T.StringType())]))
