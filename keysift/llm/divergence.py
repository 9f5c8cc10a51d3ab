"""How the sources of a language differ: term frequencies by single-pass in-memory indexing, then distances in whole numbers.

*Indexing.*  A task reads its texts once and builds a block: a dictionary of terms, each with its postings (source, occurrences) and its number of
documents.  When a block holds ``BLOCK`` postings it is spilled as a run sorted by language and term and the next block is begun.  Runs are dealt
out to hash shards by (language, term); in a shard Spark's external sort merges them through a heap, and a stream over the merged rows
adds the postings of equal terms up, a term's sources at a time.  So a term in every block costs a shard one row for each block, and
memory holds a block or a term's sources, never an index.

*Kept terms* of a language are those in at least ``DOCUMENTS`` of its documents; ``V`` is their number.  With c occurrences of a term in a
group (language, source) and N occurrences of all kept terms there, p = 1 + floor(10^9 (c + 1) / (N + V)); q is the like of what is
compared with, and the term's distance is floor((p - q)^2 / q).

*Pairs.*  Summed over all kept terms, most of which occur in neither source.  So the sum starts from V times the distance of two absent
terms; the terms present on one side are added by how often each p occurs in a group; and a stream over the postings adds corrections for
terms present on both sides.  Sources are known by a 64-bit hash that is checked to be free of collisions.

*Defined results.*  Null text, language and source read as the empty string.  Every (language, source) that occurs is a group, also without
terms.  Rows with equal ids or texts count each.  Ties are ranked by the item in UTF-8 order.  A language with one source has no pairs.  All sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from keysift.llm.words import LOWER, byte_class, column_bytes, runs, slices, text_column
from keysift.sources.staging import Staging

BLOCK = 500_000
DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
PAIRS_AT_ONCE = 1 << 20
#: After lower-casing: letters of ASCII, and every byte of a character beyond ASCII.
TERM = byte_class((0x61, 0x7A), (0x80, 0xFF))
POSTING = np.dtype([("source", "<i8"), ("n", "<i8")])
RUN = "lang string, term string, docs bigint, postings binary"
KEPT = "lang string, term string, n bigint, places array<struct<sid bigint, n bigint>>"


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sum of each of ``values`` over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64) for v in values)


class Block:
    """Postings in memory: parts of (dictionary, code, group, n, documents), the numbers of 32 bits, for they count within one slice of texts."""

    def __init__(self):
        self.groups: dict[tuple[str, int], int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, texts: pa.Array, langs: list[str], sources: np.ndarray) -> None:
        raw, offsets = column_bytes(texts)
        low = LOWER[raw]
        found, first = runs(low, offsets, TERM[low])
        if not len(found):
            return
        coded = found.dictionary_encode()
        size = len(coded.dictionary)
        text = np.repeat(np.arange(len(langs)), np.diff(first))
        in_text, n = _sums(text * size + coded.indices.to_numpy(), np.ones(len(text), np.int64))
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources.tolist())], np.int64)
        key, n, docs = _sums(group[in_text // size] * size + in_text % size, n, np.ones(len(n), np.int64))
        self.parts.append((coded.dictionary, *(x.astype(np.int32) for x in (key % size, key // size, n, docs))))
        self.size += len(key)

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block's terms in order, with their postings; the block is empty then."""
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        of_part, names = coded.indices.to_numpy(), coded.dictionary
        ranked = pc.sort_indices(names).to_numpy().astype(np.int64)
        rank = np.empty(len(names), np.int32)
        rank[ranked] = np.arange(len(names), dtype=np.int32)
        langs = sorted({lang for lang, _ in self.groups})
        lang_of = np.array([langs.index(lang) for lang, _ in self.groups], np.int64)
        source_of = np.array([sid for _, sid in self.groups], np.int64)
        key = np.concatenate([(lang_of[p[2]] * len(names) + rank[of_part[p[1] + s]]) * len(self.groups) + p[2] for p, s in zip(parts, shift)])
        n, docs = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        del parts, coded, of_part, rank
        key, n, docs = _sums(key, n, docs)
        postings = np.empty(len(key), POSTING)
        postings["source"], postings["n"] = source_of[key % len(self.groups)], n
        del n
        word = key // len(self.groups)
        del key
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        ends = np.append(first, len(word))
        docs, word = np.add.reduceat(docs, first), word[first]
        raw = pa.py_buffer(postings)
        for a in range(0, len(word), 50_000):
            b = min(a + 50_000, len(word))
            places = pa.py_buffer(((ends[a:b + 1] - ends[a]) * POSTING.itemsize).astype(np.int64))
            own = raw.slice(int(ends[a]) * POSTING.itemsize, int(ends[b] - ends[a]) * POSTING.itemsize)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(langs, object)[word[a:b] // len(names)], pa.string()),
                 names.take(pa.array(ranked[word[a:b] % len(names)])).cast(pa.string()), pa.array(docs[a:b]),
                 pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, places, own]).cast(pa.binary())],
                ["lang", "term", "docs", "postings"])


def index_runs(docs: DataFrame) -> DataFrame:
    """Of (lang, sid, text): the spilled runs, one row for each block, language and term."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in slices(batches, text_column):
            block.add(batch.column("text"), batch.column("lang").to_pylist(), batch.column("sid").to_numpy())
            if block.size >= BLOCK:
                yield from block.run()
                block = Block()
                pa.default_memory_pool().release_unused()
        yield from block.run()

    return docs.select("lang", "sid", "text").mapInArrow(build, RUN)


def merge_runs(spilled: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(lang, term, n, places) of the terms in at least ``documents`` documents, from runs merged shard by shard."""
    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row where each term starts, its documents, and its postings: term, source, n."""
        same = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False).astype(bool)
                for c in (table.column(k).combine_chunks() for k in ("lang", "term"))]
        first = np.flatnonzero(np.append(True, ~(same[0] & same[1])))
        docs = np.add.reduceat(table.column("docs").to_numpy(), first)
        raw = table.column("postings").combine_chunks()
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64) // POSTING.itemsize
        flat = np.frombuffer(b"".join(raw.to_pylist()), POSTING)
        term = np.repeat(np.searchsorted(first, np.arange(len(sizes)), "right") - 1, sizes)
        order = np.lexsort((flat["source"], term))
        term, source, n = term[order], flat["source"][order], flat["n"][order]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (source[1:] != source[:-1])))
        return first, docs, term[new], source[new], np.add.reduceat(n, new)

    def out(table: pa.Table, found: tuple, last: int) -> pa.RecordBatch:
        """The first ``last`` terms, without those in too few documents."""
        first, docs, term, source, n = found
        kept = np.flatnonzero(docs[:last] >= documents)
        sizes = np.bincount(term, minlength=len(first))
        there = (term < last) & (docs[term] >= documents)
        offsets = np.append(0, np.cumsum(sizes[kept])).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            [pa.array(source[there]), pa.array(n[there])], ["sid", "n"]))
        total = np.add.reduceat(n[there], offsets[:-1]) if len(kept) else np.zeros(0, np.int64)
        rows = pa.array(first[kept])
        return pa.RecordBatch.from_arrays([table.column("lang").take(rows).combine_chunks(), table.column("term").take(rows).combine_chunks(),
                                           pa.array(total), places], ["lang", "term", "n", "places"])

    def held_back(table: pa.Table, found: tuple) -> pa.Table:
        """The last term as one row, for it may go on in the next batch."""
        first, docs, term, source, n = found
        own = term == len(first) - 1
        postings = np.empty(int(own.sum()), POSTING)
        postings["source"], postings["n"] = source[own], n[own]
        row = table.slice(int(first[-1]), 1)
        return pa.table([row.column("lang"), row.column("term"), pa.array([int(docs[-1])], pa.int64()), pa.array([postings.tobytes()], pa.binary())],
                        names=["lang", "term", "docs", "postings"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            found = merged(table)
            yield out(table, found, len(found[0]) - 1)
            rest = held_back(table, found)
        if rest is not None:
            yield out(rest, merged(rest), 1)

    shards = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(merge, KEPT)


def share(c: Column, whole: Column) -> Column:
    """1 + floor(10^9 (c + 1) / whole) by long division, three digits at a time, so that nothing overflows."""
    whole = F.greatest(whole, F.lit(1).cast("bigint"))
    rest, out = c + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, whole), rest % whole
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def both_sided(postings: DataFrame) -> DataFrame:
    """Of (lang, found array of (g, p, none)): (lang, g, other, value), what terms that occur in both groups add to the sum over the groups' single sides."""
    def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            flat = lists.flatten()
            g, p, none = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("g", "p", "none"))
            langs = batch.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy()
            for size in np.unique(sizes[sizes > 1]).tolist():
                rows = np.flatnonzero(sizes == size)
                wide = max(1, min(size, PAIRS_AT_ONCE // size))
                deep = max(1, PAIRS_AT_ONCE // (size * wide))
                for r in range(0, len(rows), deep):
                    part = rows[r:r + deep]
                    right = first[part][:, None, None] + np.arange(size)[None, None, :]
                    for lo in range(0, size, wide):
                        left = first[part][:, None, None] + np.arange(lo, min(lo + wide, size))[None, :, None]
                        a, b = (x.ravel() for x in np.broadcast_arrays(left, right))
                        own = np.broadcast_to(lang_of[part][:, None, None], np.broadcast_shapes(left.shape, right.shape)).ravel()
                        other = a != b
                        a, b, own = a[other], b[other], own[other]
                        value = _distance(p[a], p[b]) - _distance(p[a], none[b]) - _distance(none[a], p[b]) + _distance(none[a], none[b])
                        key, value = _sums((own.astype(np.int64) << 56) | (g[a] << 28) | g[b], value)
                        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key >> 56)), pa.array((key >> 28) & 0xFFFFFFF),
                                                          pa.array(key & 0xFFFFFFF), pa.array(value)], ["lang", "g", "other", "value"])

    return postings.mapInArrow(corrections, "lang string, g bigint, other bigint, value bigint")


def groups_of(docs: DataFrame, staging: Staging) -> tuple[DataFrame, int]:
    """(lang, source) of all groups, and a seed by which the hashes of a language's sources differ."""
    groups = staging.write(docs.select("lang", "source").distinct(), "groups")
    seed = 0
    while not groups.groupBy("lang", F.xxhash64("source", F.lit(seed))).count().filter("count > 1").isEmpty():
        seed += 1
    return groups, seed


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, part ``term`` the ``top`` terms
    that are likelier in the group than in its language."""
    staging = Staging(docs.sparkSession, "divergence")
    text = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*text)
    names, seed = groups_of(rows, staging)
    sid = F.xxhash64("source", F.lit(seed)).alias("sid")
    kept = staging.write(merge_runs(index_runs(rows.select("lang", sid, "text")), documents), "terms")
    places = kept.select("lang", "term", F.col("n").alias("in_lang"), F.inline("places"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    of_group = places.groupBy("lang", "sid").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("bigint")
    groups = (names.select("lang", "source", sid, F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint").alias("g"))
              .join(of_lang, "lang", "left").join(of_group, ["lang", "sid"], "left")
              .select("lang", "source", "sid", "g", F.coalesce("v", zero).alias("v"),
                      (F.coalesce("lang_n", zero) + F.coalesce("v", zero)).alias("lang_whole"),
                      (F.coalesce("group_n", zero) + F.coalesce("v", zero)).alias("whole")))
    groups = staging.write(groups.withColumn("none", share(zero, F.col("whole"))), "sizes")

    known = places.join(groups.select("lang", "sid", "source", "g", "whole", "none", "lang_whole"), ["lang", "sid"])
    present = staging.write(known.select("lang", "source", "g", "none", "term", share(F.col("n"), F.col("whole")).alias("p"),
                                         share(F.col("in_lang"), F.col("lang_whole")).alias("q")), "present")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (present.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                            distance(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))

    here = groups.select("lang", "source", "g", "v", "none")
    there = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("other"), F.col("none").alias("far"))
    pairs = here.join(there, "lang").filter("g <> other")  # the rows of the result
    absent = pairs.select("lang", "g", "other", (F.col("v").cast("decimal(20,0)") * distance(F.col("none"), F.col("far"))).cast("decimal(38,0)").alias("value"))
    often = present.groupBy("lang", "g", "none", "p").agg(F.count("*").alias("terms"))  # as many as a group has different counts
    sided = often.join(there, "lang").filter("g <> other")
    p, none, far = F.col("p"), F.col("none"), F.col("far")

    def added(g: str, other: str, more: Column) -> DataFrame:
        return sided.select("lang", F.col(g).alias("g"), F.col(other).alias("other"),
                            (F.col("terms").cast("decimal(18,0)") * more.cast("decimal(20,0)")).cast("decimal(38,0)").alias("value"))

    near = added("g", "other", distance(p, far) - distance(none, far))
    back = added("other", "g", distance(far, p) - distance(far, none))
    together = present.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "none")).alias("found"))  # one entry for each source
    both = both_sided(together.filter(F.size("found") > 1).select("lang", "found")).select("lang", "g", "other", F.col("value").cast("decimal(38,0)").alias("value"))
    summed = (absent.unionAll(near).unionAll(back).unionAll(both).groupBy("lang", "g", "other").agg(F.sum("value").cast("bigint").alias("value")))
    paired = (summed.join(here.select("lang", "g", "source"), ["lang", "g"]).join(there.select("lang", "other", "item"), ["lang", "other"])
              .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)))
    return paired.unionByName(terms)
