"""Spelling variants: words at an edit distance of one, found exactly through pairs of trie nodes.

*Words* are maximal runs of letters (``A-Z``, ``a-z`` and U+00C0 to U+00FF), ASCII lower-cased, of at least ``LEAST`` code points and
``SEEN`` occurrences in all texts.  ``spelt`` may change a run before it is counted.

*Nodes.*  The words are sorted over ranges; walking down a sorted range, the part of a word that it does not share with the one before it gets new
node numbers, so a prefix has one number and a number one prefix.  Where a prefix reaches across the border of two ranges, the later
range takes over the numbers of the earlier: one row for each range goes to the driver for that.  The same on reversed words numbers suffixes.

*Pairs.*  A word has a pair (node of the prefix, node of the suffix) for each place between two characters, and for each character that is
skipped.  Two words that share a skipping pair differ by one replaced character; a word whose skipping pair is a plain pair of another is that
other with one character inserted.  A pair stands for the whole string beside the skipped character, so matches are exact and need no check.
In a run of one character only the first is skipped for insertions, so that a neighbour counts once.

All words with one pair differ in one character alone, so a pair has at most as many words as there are letters, and one more.  Counts and
the best word of each pair come from a window over the pair; pairs of words are not written out.  Words are ranked once by (n, word),
so that the best word is the smallest number.

*Defined results.*  A null text has no words.  Equal rows count each.  A word without a near word has ``n_near`` 0 and no form.  The chain of
forms ends, since n grows tenfold at each step.  A null id reads as the empty text where a run's spelling depends on it.  Very long runs are words like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from keysift.llm.words import LOWER, column_bytes, runs, slices, text_column
from keysift.sources.staging import Staging

LEAST = 7
SEEN = 2
TIMES = 10
ROOT = -1
NODES_AT_ONCE = 1 << 20
LEAD = 0xC3  # first byte of U+00C0 to U+00FF

#: Which runs a spelling concerns: (start of a crc32 for each text, runs as bytes, text of each run) -> (places, the new words)
Spelling = Callable[[list, list, np.ndarray], tuple[np.ndarray, list]]


def dropped_letter(ids: list, found: list, text: np.ndarray, one_in: int = 31) -> tuple[np.ndarray, list]:
    """Where ``one_in`` divides the crc32 h of ``id:run``, the run loses its code point h % length."""
    start = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    h = np.fromiter(map(zlib.crc32, found, map(start.__getitem__, text.tolist())), np.int64, len(found))
    places = np.flatnonzero(h % one_in == 0)
    out = []
    for at in places.tolist():
        word = found[at].decode()
        k = int(h[at]) % len(word)
        out.append(word[:k] + word[k + 1:])
    return places, out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seen: int = SEEN,
                spelt: Spelling | None = dropped_letter) -> DataFrame:
    """(word, n) of the words with at least ``least`` code points that occur ``seen`` times or more."""
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
    letters = np.zeros(256, bool)
    letters[0x61:0x7B] = True
    letters[LEAD] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 8 << 20):
            raw, offsets = column_bytes(batch.column("text"))
            low = LOWER[raw]
            inside = letters[low]
            inside[1:] |= low[:-1] == LEAD
            found, first = runs(low, offsets, inside)
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            long = pc.greater_equal(pc.utf8_length(found), least).to_numpy(zero_copy_only=False)
            coded = found.filter(pa.array(long)).dictionary_encode()
            code, text = coded.indices.to_numpy(), text[long]
            names, plain = coded.dictionary, np.ones(len(code), bool)
            if spelt and len(code):
                known = names.cast(pa.large_binary()).to_pylist()
                places, changed = spelt(batch.column("id").to_pylist(), [known[c] for c in code.tolist()], text)
                plain[places] = False
                other = pa.array([x for x in changed if len(x) >= least], pa.large_string()).value_counts()
                yield pa.RecordBatch.from_arrays([other.field(0), other.field(1)], ["word", "n"])
            n = np.bincount(code[plain], minlength=len(names))
            kept = n > 0
            yield pa.RecordBatch.from_arrays([names.filter(pa.array(kept)), pa.array(n[kept])], ["word", "n"])

    def as_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in count(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64())], ["word", "n"])

    counted = rows.mapInArrow(as_strings, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    if high < 64:
        while low < high and a[low] == b[low]:
            low += 1
        return low
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def number_nodes(words: DataFrame, staging: Staging, name: str) -> DataFrame:
    """Of distinct (word, id): (word, id, path), the trie's node for each prefix of the word, from the first character on.

    A number is made of the range's and a place in it.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, path, fresh = "", [], part << 33

        def out(ids: list, names: list, paths: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(names, pa.string()),
                                               pa.array(paths, pa.list_(pa.int64()))], ["part", "id", "word", "path"])

        for batch in batches:
            ids, names, paths, size = [], [], [], 0
            for word, id_ in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
                k = _shared(last, word)
                path = path[:k] + list(range(fresh, fresh + len(word) - k))
                fresh, last = fresh + len(word) - k, word
                ids.append(id_), names.append(word), paths.append(path)
                size += len(word)
                if size >= NODES_AT_ONCE:
                    yield out(ids, names, paths)
                    ids, names, paths, size = [], [], [], 0
            if ids:
                yield out(ids, names, paths)

    ordered = words.select("word", "id").repartitionByRange("word").sortWithinPartitions("word")
    walked = staging.write(ordered.mapInArrow(walk, "part bigint, id bigint, word string, path array<bigint>"), name)
    ends = walked.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"),
                                      F.max_by("path", "word").alias("path")).orderBy("part").collect()  # one row for each range
    taken, before = [], None
    for end in ends:
        shared = before[1][:_shared(before[0], end["first"])] if before else []
        if shared:
            taken.append((end["part"], shared))
        own = end["part"] << 33
        before = end["last"], [shared[x - own] if x - own < len(shared) else x for x in end["path"]]
    if not taken:
        return walked.select("word", "id", "path")
    over = walked.sparkSession.createDataFrame(taken, "part bigint, taken array<bigint>")
    place = "x - shiftleft(part, 33)"
    return (walked.join(F.broadcast(over), "part", "left")  # at most one row for each range
            .select("word", "id", F.expr(f"CASE WHEN taken IS NULL THEN path ELSE transform(path, x -> CASE WHEN {place} < size(taken) "
                                         f"THEN taken[CAST({place} AS INT)] ELSE x END) END").alias("path")))


def _cut(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about NODES_AT_ONCE nodes, one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + NODES_AT_ONCE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _with_root(paths: pa.Array, first: np.ndarray) -> np.ndarray:
    """The paths one after the other, each with the root before it."""
    return np.insert(paths.flatten().to_numpy(), first, ROOT)


def node_pairs(paths: DataFrame) -> DataFrame:
    """Of (id, word, path, back), ``back`` the nodes of the reversed word: (before, after, id, kind), kind 0 for a place between characters,
    1 for a skipped character, 2 for a skipped one that starts a run."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column("path")).to_numpy().astype(np.int64)
            for batch in _cut(whole, sizes):
                n = pc.list_value_length(batch.column("path")).to_numpy().astype(np.int64)
                first = np.cumsum(n) - n
                before, after = _with_root(batch.column("path"), first), _with_root(batch.column("back"), first)
                word = np.repeat(np.arange(len(n)), n + 1)
                begin = first + np.arange(len(n))  # of each word, among its n + 1 places
                place = np.arange(len(word))
                after = after[2 * begin[word] + n[word] - place]  # the nodes of the suffix that starts at each place
                skips = place != (begin + n)[word]
                code = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
                new = np.ones(len(code), bool)
                new[1:] = code[1:] != code[:-1]
                new[first] = True
                id_ = batch.column("id").to_numpy()[word]
                at = np.flatnonzero(skips)
                kind = np.concatenate([np.zeros(len(word), np.int8), np.where(new, 2, 1).astype(np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([before, before[at]])), pa.array(np.concatenate([after, after[at + 1]])),
                                                  pa.array(np.concatenate([id_, id_[at]])), pa.array(kind)], ["before", "after", "id", "kind"])

    return paths.select("id", "word", "path", "back").mapInArrow(pairs, "before bigint, after bigint, id bigint, kind tinyint")


def near_words(ranked: DataFrame, staging: Staging) -> DataFrame:
    """Of distinct (word, id): (id, n_near, best), the number of words at distance one and the smallest id among those that
    are smaller than the word's own, null if none is.  Words without a near word are left out."""
    ahead = number_nodes(ranked, staging, "prefixes")
    behind = number_nodes(ranked.select(F.reverse("word").alias("word"), "id"), staging, "suffixes")
    paths = ahead.join(behind.select("id", F.col("path").alias("back")), "id")
    pair = Window.partitionBy("before", "after")
    skips, starts = F.col("kind") > 0, F.col("kind") == 2
    id_ = F.col("id")
    met = node_pairs(paths).select(
        "id", "kind", F.count(F.when(skips, 1)).over(pair).alias("others"), F.min(F.when(skips, id_)).over(pair).alias("other"),
        F.count(F.when(starts, 1)).over(pair).alias("longer"), F.min(F.when(starts, id_)).over(pair).alias("long"),
        F.min(F.when(~skips, id_)).over(pair).alias("short"))
    counts = F.when(skips, F.col("others") - 1 + F.when(starts & F.col("short").isNotNull(), 1).otherwise(0)).otherwise(F.col("longer"))
    best = F.when(skips, F.least("other", F.when(starts, F.col("short")))).otherwise(F.col("long"))
    found = met.select("id", counts.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.when(F.col("best") < id_, F.col("best"))).alias("best"))


def with_roots(forms: DataFrame, most: int, staging: Staging) -> DataFrame:
    """Of (id, form): (id, form, root), where each chain of forms ends.  ``most`` is the longest chain; each round doubles what is followed."""
    linked = forms.withColumn("root", F.col("form"))
    followed, k = 1, 0
    while followed < most:
        onward = linked.select(F.col("id").alias("root"), F.col("root").alias("further"))
        linked = staging.write(linked.join(onward, "root", "left").select("id", "form", F.coalesce("further", "root").alias("root")), f"roots{k}")
        if k:
            staging.drop(f"roots{k - 1}")
        followed, k = followed * 2, k + 1
    return linked


def group_variants(words: DataFrame, staging: Staging | None = None, times: int = TIMES) -> DataFrame:
    """Of distinct (word, n): (word, form, root, n, n_near, form_n).  A word's form is its near word of largest n (ties: the smallest
    in code-point order) if that has ``times`` its n; the root is where following forms ends."""
    staging = staging or Staging(words.sparkSession, "variants")
    # numbers in the order of a sorted table: larger for a smaller n
    ranked = staging.write(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = staging.write(near_words(ranked, staging), "near")
    staging.drop("prefixes", "suffixes")
    of = ranked.select(F.col("id").alias("best"), F.col("n").alias("form_n"))
    judged = near.join(ranked.select("id", "n"), "id").join(of, "best", "left")
    fits = F.col("form_n") >= F.col("n") * times
    forms = staging.write(judged.filter(fits).select("id", F.col("best").alias("form"), "form_n"), "forms")
    top, chain = ranked.agg(F.max("n")).first()[0] or 0, 0
    while top >= times:
        top, chain = top // times, chain + 1
    linked = with_roots(forms.select("id", "form"), chain, staging)
    named = ranked.select(F.col("id").alias("key"), F.col("word").alias("name"))
    spelt = (linked.join(named.toDF("form", "form_word"), "form").join(named.toDF("root", "root_word"), "root")
             .join(forms.select("id", "form_n"), "id").select("id", "form_word", "root_word", "form_n"))
    return (ranked.join(near.select("id", "n_near"), "id", "left").join(spelt, "id", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of ``docs`` with their near words' number, form and root."""
    staging = Staging(docs.sparkSession, "variants")
    words = staging.write(count_words(docs, id_col, text_col), "counted")
    return group_variants(words, staging)
