"""Language-model scores of whole documents: an add-one unigram base, and a gated recurrent model that is trained on the corpus.

*Counts.*  Tokens (words and one end for each text) are counted over all texts, pre-aggregated in the tasks: occurrences in the texts to learn from, and
in all.  The ``HEAD`` most frequent words, a fixed bound, are broadcast; every word beyond them is looked up by a join, so no count is
left out and no word of the join is frequent.

*Model.*  The likeliest words have an identifier each, all others share one; ``gru.Gru`` predicts identifiers.  The chance of a word without an own identifier is that
of the shared one times its add-one share among such words, so the chances of all words, and of one that was never seen, add up to one.

*Learning* covers all texts to learn from: a model begun in one task on some ``BEGIN`` texts of at most ``LONG`` tokens, picked by hash, is carried on by every task
over all its texts by truncated backpropagation, and the tasks' weights are averaged by their numbers of tokens: sums of some tasks first, then sums of sums.

*Scoring* feeds a text's identifiers through the model from the first to the end, the state carried along, however long the text is.

*Defined results.*  Null and empty texts consist of the end alone.  Equal texts get equal scores up to rounding.  A null id is learnt from.  Without a text to learn from N and V are 0 and
the base is log10(1) for each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from keysift.llm.gru import Gru, Moments, in_lanes
from keysift.llm.words import LOWER, byte_class, column_bytes, runs, slices, text_column
from keysift.sources.staging import Staging

HEAD = 1 << 18
HIDDEN, CLASSES, MEMBERS = 16, 16, 32
LANES, WINDOW = 512, 16
BEGIN, UPDATES, LONG = 2000, 200, 20_000
FAST, SLOW = 0.01, 0.003
MERGED = 64
TOKENS_AT_ONCE = 4 << 20
END = ""
END_ID, OTHER_ID = 0, 1
VISIBLE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def _tokens(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts, and where each text's begin."""
    raw, offsets = column_bytes(batch.column("text"))
    found, first = runs(LOWER[raw], offsets, VISIBLE[raw])
    return found.dictionary_encode(), first


def count_tokens(docs: DataFrame) -> DataFrame:
    """Of (learn, text): (word, n, seen), a word's occurrences in texts to learn from, and in all; the end is the empty word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 16 << 20):
            coded, first = _tokens(batch)
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            code, size = coded.indices.to_numpy(), len(coded.dictionary)
            seen = np.bincount(code, minlength=size)
            n = np.bincount(code[np.repeat(learn, np.diff(first))], minlength=size)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n), pa.array(seen)], ["word", "n", "seen"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([int(learn.sum())]), pa.array([len(learn)])], ["word", "n", "seen"])

    return docs.select("learn", "text").mapInArrow(count, "word string, n bigint, seen bigint").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def most_seen(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words, those seen most often: all words above a number of occurrences that a small histogram gives."""
    step = F.floor(F.log2(F.col("seen")) * 8).alias("step")
    sizes = counts.filter("seen > 0").groupBy(step).count().orderBy(F.desc("step")).collect()  # 8 rows for each power of two
    least, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return counts.filter(F.lit(False) if least is None else step >= least)


class Head:
    """The most frequent words with what each adds to a score."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        order = np.argsort(-n, kind="stable")
        self.words, self.n = words.take(pa.array(order)), n[order]
        own = np.flatnonzero((self.n > 0) & ~pc.equal(self.words, END).to_numpy(zero_copy_only=False).astype(bool))[:CLASSES * MEMBERS - 2]
        self.ids = np.full(len(self.n), OTHER_ID, np.uint16)
        self.ids[own] = np.arange(2, len(own) + 2)
        self.own = own
        self.logs = np.log10(self.n + 1.0)


def encode(docs: DataFrame, head) -> DataFrame:
    """Of (row, id, learn, text): what the head says of each text, its identifiers (the end included), and the words beyond the head with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Head = head.value
        for batch in slices(batches, text_column, 8 << 20):
            coded, first = _tokens(batch)
            names, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
            place = pc.fill_null(pc.index_in(names, now.words), -1).to_numpy()
            there = place >= 0
            ids, logs, known = (np.where(there, x[place], y) if len(now.n) else np.full(len(place), y)
                                for x, y in ((now.ids, OTHER_ID), (now.logs, 0.0), (now.n > 0, False)))
            texts, sizes = len(first) - 1, np.diff(first)
            text = np.repeat(np.arange(texts), sizes)
            other = (ids == OTHER_ID)[code]
            beyond = np.flatnonzero(~there[code])
            key, n = np.unique(text[beyond] * max(len(names), 1) + code[beyond], return_counts=True)
            lists = np.append(0, np.cumsum(np.bincount(key // max(len(names), 1), minlength=texts))).astype(np.int32)
            rare = pa.StructArray.from_arrays([names.take(pa.array(key % max(len(names), 1))), pa.array(n)], ["word", "n"])
            flat = np.insert(ids[code], first[1:], END_ID).astype("<u2")
            bounds = pa.py_buffer(((first + np.arange(texts + 1)) * 2).astype(np.int64))
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts, [None, bounds, pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("row", "id", "learn")), pa.array(sizes + 1),
                pa.array(np.bincount(text, known[code], texts).astype(np.int64)), pa.array(np.bincount(text, logs[code], texts).astype(float)),
                pa.array(np.bincount(text, other, texts).astype(np.int64)), pa.array(np.bincount(text, np.where(other, logs[code], 0), texts).astype(float)),
                raw, pa.ListArray.from_arrays(pa.array(lists), rare)],
                ["row", "id", "learn", "n_tokens", "n_known", "logs", "n_other", "other_logs", "ids", "rare"])

    found = T.StructType.fromDDL("n_tokens bigint, n_known bigint, logs double, n_other bigint, other_logs double, ids binary, "
                                 "rare array<struct<word string, n bigint>>")
    given = docs.select("row", "id", "learn", "text")
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:3], *found.fields]))


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def _gathered(batches: Iterator[pa.RecordBatch], most: int = TOKENS_AT_ONCE) -> Iterator[pa.Table]:
    """Batches with ``ids`` put together until they hold about ``most`` tokens."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("ids").nbytes // 2
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _begun(texts: list[np.ndarray], counts: np.ndarray) -> Gru:
    """A model after ``UPDATES`` updates over the texts, again and again if they are few."""
    model, moments, done = Gru.fresh(HIDDEN, CLASSES, MEMBERS, counts), Moments(), 0
    given, wanted = in_lanes(texts, END_ID, LANES)
    while given.size and done < UPDATES:
        rates = iter(FAST * min(1.0, (k + 1) / 20) for k in range(done, 1 << 30))
        done += len(model.train(given, wanted, rates, WINDOW, moments))
    return model


def train(encoded: DataFrame, counts: np.ndarray) -> Gru:
    """The model of the rows of ``encoded`` to learn from; ``counts`` are the identifiers' numbers of occurrences."""
    spark = encoded.sparkSession
    texts = encoded.filter("learn").select("row", "ids")
    shape = Gru.fresh(HIDDEN, CLASSES, MEMBERS, counts)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for batch in batches for x in _texts(batch.column("ids"))]
        yield pa.RecordBatch.from_arrays([pa.array([_begun(got, counts).pack()])], ["weights"])

    some = max(1, int(counts[END_ID]))  # as many ends as texts
    few = (encoded.filter(F.col("learn") & (F.col("n_tokens") <= LONG)).select("ids", F.xxhash64("row").alias("h"))
           .filter(F.pmod("h", F.lit(some)) < BEGIN))
    found = few.repartition(1).sortWithinPartitions("h").select("ids").mapInArrow(begin, "weights binary").collect()
    start = spark.sparkContext.broadcast(bytes(found[0]["weights"]) if found else shape.pack())

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        model, moments, tokens, done = shape.unpack(start.value), Moments(), 0, 0
        for table in _gathered(batches):
            given, wanted = in_lanes(_texts(table.column("ids")), END_ID, LANES)
            if given.size:
                rates = iter(SLOW / (1 + k / 200) for k in range(done, 1 << 30))
                done += len(model.train(given, wanted, rates, WINDOW, moments))
                tokens += given.size
        if tokens:
            yield summed([(TaskContext.get().partitionId(), tokens, model.pack(), float(tokens))])

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        """One row: the tokens, and the weighted sum of the weights over them."""
        total, tokens = 0.0, 0
        for _, n, raw, scale in sorted(rows, key=lambda r: r[0]):
            total = total + np.frombuffer(raw, np.float32 if scale else np.float64).astype(np.float64) * (scale or 1.0)
            tokens += n
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0] % MERGED], pa.int64()), pa.array([rows[0][0]], pa.int64()), pa.array([tokens], pa.int64()),
                                           pa.array([total.tobytes()], pa.binary())], ["part", "first", "tokens", "weights"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held = groups.setdefault(r["part"], [])
                held.append((r["first"], r["tokens"], r["weights"], 0.0))
                if len(held) == MERGED:  # never more than a few models in memory
                    one = summed(held).to_pylist()[0]
                    groups[r["part"]] = [(one["first"], one["tokens"], one["weights"], 0.0)]
        for part, held in groups.items():
            yield summed(held)

    kind = "part bigint, first bigint, tokens bigint, weights binary"
    parts = texts.select("ids").mapInArrow(go_on, kind).repartition("part").sortWithinPartitions("part", "first").mapInArrow(merge, kind)
    rows = parts.collect()  # at most MERGED models
    tokens = sum(r["tokens"] for r in rows)
    if not tokens:
        return shape.unpack(start.value)
    total = sum((np.frombuffer(bytes(r["weights"])) for r in sorted(rows, key=lambda r: r["first"])), np.zeros(1))
    return shape.unpack((total / tokens).astype(np.float32).tobytes())


def model_scores(encoded: DataFrame, model: Gru) -> DataFrame:
    """(row, chance): the natural log of the chance of each row's identifiers."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            found = shared.value.score(_texts(table.column("ids")), END_ID)
            yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), pa.array(found)], ["row", "chance"])

    return encoded.select("row", "ids").mapInArrow(run, "row bigint, chance double")


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; rows that are ``held`` out are not learnt from."""
    spark, staging = docs.sparkSession, Staging(docs.sparkSession, "lm")
    rows = docs.select(docs[id_col].alias("id"), (~held).alias("learn"), docs[text_col].cast("string").alias("text"))
    counts = staging.write(count_tokens(rows), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = sums["n"], sums["v"]
    got = most_seen(counts, HEAD).orderBy("word").toArrow()
    head = Head(got.column("word").combine_chunks().cast(pa.string()), got.column("n").to_numpy())
    ends = counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    own = head.n[head.own]
    other_n, other_v = n - ends - int(own.sum()), v - len(own) - (1 if ends else 0)
    shared = spark.sparkContext.broadcast(head)
    encoded = staging.write(encode(rows.withColumn("row", F.monotonically_increasing_id()), shared), "encoded")
    model = train(encoded, np.concatenate([[ends, other_n + 1], own]))

    rare = encoded.select("row", F.inline("rare"))
    words = counts.filter("n > 0").select("word", F.col("n").alias("c"))
    met = (rare.join(words, "word").groupBy("row")
           .agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs")))
    scores = model_scores(encoded, model)
    told = encoded.select("row", "id", "learn", "n_tokens", "n_known", "logs", "n_other", "other_logs").join(met, "row", "left").join(scores, "row")
    more = F.coalesce("more_logs", F.lit(0.0))
    end_log, whole, other_whole = float(np.log10(ends + 1)), float(np.log10(n + v + 1)), float(np.log10(other_n + other_v + 1))
    return told.select(
        "id", (~F.col("learn")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more + F.lit(end_log) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("chance") / F.lit(float(np.log(10))) + F.col("other_logs") + more - F.col("n_other") * F.lit(other_whole)).alias("score"))
