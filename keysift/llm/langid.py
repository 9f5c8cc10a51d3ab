"""Language identification by unigram piece models whose segmentations are summed out.

The pieces are those of a fixed public vocabulary (read from its file, never trained) that consist of ASCII letters and characters beyond ASCII, lower-cased, of any length.  A language is a distribution over
pieces.  The probability of a word (a run of such characters, lower-cased, with the word-begin mark) is the sum over all its segmentations of the product of its pieces, by a forward recursion; the
score of a text is the product over its words, and a language's prior is its share of the training documents.

*Learning.*  Words are counted per language over all training texts, pre-aggregated in the tasks.  Starting from all pieces that occur,
``ROUNDS`` rounds of expectation-maximisation turn expected piece counts (forward and backward sums, weighted by word counts) into
probabilities.  A model is languages x vocabulary numbers whatever the size of the corpus; only that is collected and broadcast.

*Words* of at most ``SHORT`` characters are taken many at a time.  A longer one is walked along in windows of ``WINDOW`` characters that carry the forward sums on, scaled
so that they do not vanish: it is never cut, and a text without spaces costs in proportion to its length.  Characters that no piece covers have a small fixed probability.

*Defined results.*  Null texts and texts without a letter are ``und`` with score 0.  Otherwise the score is the posterior of the predicted
language.  Ties go to the language that sorts first.  Without training documents every text is ``und``.  Repeated rows get equal results; columns of any name are carried inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from keysift.llm.words import Words, byte_class, carried, column_bytes, find_words, slices, text_column
from keysift.sources.staging import Staging

SHORT = 24
WINDOW = 1 << 14
WORDS_AT_ONCE = 100_000
ROUNDS = 2
UNSEEN = 1e-7
SMALL = 1e-9
SMOOTH = 0.01
KEPT = 400_000
#: After lower-casing: letters of ASCII, and every byte of a character beyond ASCII, be it a letter or not.
LETTERS = byte_class((0x61, 0x7A), (0x80, 0xFF))
PRIME = np.uint64(0x100000001B3)
MARK = "▁"


def pieces_of(file: str) -> list[str]:
    """Distinct lower-cased pieces of a SentencePiece model file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if p and all(c > "\x7f" or "a" <= c <= "z" for c in p))


def public_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points as rows padded with 0, lengths)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max(initial=0))), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _hash_pieces(pieces: list[str]) -> np.ndarray:
    codes, sizes = _codes(pieces)
    value = np.zeros(len(pieces), np.uint64)
    for i in range(codes.shape[1]):
        value = np.where(i < sizes, value * PRIME + codes[:, i] + np.uint64(1), value)
    return value


class Lattice:
    """For words of one length: the piece (or -1) at each begin and length."""

    def __init__(self, pieces: list[str]):
        hashes = _hash_pieces(pieces)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.longest = max(map(len, pieces), default=1)

    def spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, piece of each word) of all spans, by end."""
        n, length = codes.shape
        running: dict[int, np.ndarray] = {}
        for end in range(1, length + 1):
            letter = codes[:, end - 1] + np.uint64(1)
            running = {b: v * PRIME + letter for b, v in running.items() if end - b <= self.longest}
            running[end - 1] = letter.copy()
            for begin, value in running.items():
                at = np.minimum(np.searchsorted(self.sorted, value), len(self.sorted) - 1)
                yield begin, end, np.where(self.sorted[at] == value, self.order[at], -1)


    def ends(self, codes: np.ndarray, before: int) -> list[list[tuple[int, int]]]:
        """Of one stretch of characters: for each place from ``before`` on, the (length, piece) of what ends there; -1 for a character without a piece."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(codes) - before)]
        value = np.zeros(len(codes), np.uint64)
        for length in range(1, min(self.longest, len(codes)) + 1):
            value = value[:len(codes) - length + 1] * PRIME + codes[length - 1:] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.sorted, value), len(self.sorted) - 1)
            hit = np.flatnonzero(self.sorted[at] == value) if length > 1 else np.arange(len(value))
            found = np.where(self.sorted[at[hit]] == value[hit], self.order[at[hit]], -1)
            for k, piece in zip((hit + length - 1 - before).tolist(), found.tolist()):
                if k >= 0:
                    out[k].append((length, piece))
        return out


def _ends(lattice: Lattice, codes: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """``Lattice.ends`` of a long word, a window at a time; windows overlap by the longest piece."""
    for at in range(0, len(codes), WINDOW):
        before = min(at, lattice.longest - 1)
        yield from lattice.ends(codes[at - before:at + WINDOW], before)


def forward_long(lattice: Lattice, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The log of ``forward`` for one word of any length: the last sums alone are held, scaled to the largest at every character."""
    held, log = [np.ones(table.shape[1])], np.zeros(table.shape[1])
    for found in _ends(lattice, codes):
        now = sum(held[-length] * table[piece] for length, piece in found)
        held = [x / now for x in held[-lattice.longest:]] + [np.ones(table.shape[1])]
        log += np.log(now)
    return log


def expected_long(lattice: Lattice, codes: np.ndarray, table: np.ndarray, weight: float, out: np.ndarray) -> None:
    """Adds one word's ``expected`` counts; the sums of its places, scaled, take some numbers for each character."""
    found = list(_ends(lattice, codes))
    ahead, scale = np.zeros(len(codes) + 1), np.ones(len(codes) + 1)  # ahead[i] is the sum up to i by the scales up to i
    ahead[0] = 1
    for end, pieces in enumerate(found, 1):
        total = sum(ahead[end - length] * table[piece] / np.prod(scale[end - length + 1:end]) for length, piece in pieces)
        ahead[end], scale[end] = 1.0, total
    back = np.zeros(len(codes) + 1)  # the sum from i on by the scales behind i
    back[-1] = 1
    for end in range(len(codes), 0, -1):
        for length, piece in found[end - 1]:
            chance = table[piece] * back[end] / np.prod(scale[end - length + 1:end + 1])
            back[end - length] += chance
            out[piece] += weight * ahead[end - length] * chance
    return None


def forward(lattice: Lattice, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[word, language]: the summed probability of all segmentations.  ``table`` has a last row for characters without a piece."""
    n, length = codes.shape
    sums = np.zeros((length + 1, n, table.shape[1]))
    sums[0] = 1
    for begin, end, piece in lattice.spans(codes):
        if end - begin == 1:
            sums[end] += sums[begin] * table[piece]
        else:
            hit = np.flatnonzero(piece >= 0)
            sums[end, hit] += sums[begin, hit] * table[piece[hit]]
    return sums[length]


def expected(lattice: Lattice, codes: np.ndarray, table: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Expected counts of each piece (and of uncovered characters, last) in words of one language, weighted."""
    n, length = codes.shape
    found = list(lattice.spans(codes))
    ahead, back = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    ahead[0] = back[length] = 1
    chance = [np.where((p >= 0) | (e - b == 1), table[p], 0.0) for b, e, p in found]
    for (b, e, _), c in zip(found, chance):
        ahead[e] += ahead[b] * c
    for (b, e, _), c in sorted(zip(found, chance), key=lambda x: -x[0][0]):
        back[b] += back[e] * c
    out = np.zeros(size + 1)
    for (b, e, p), c in zip(found, chance):
        np.add.at(out, p, weight * ahead[b] * c * back[e] / ahead[length])
    return out


def _texts(data: np.ndarray, words: Words, chosen: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [MARK + raw[words.start[i]:words.end[i]].decode("utf-8", "replace") for i in chosen]


def _by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the words, code points) of words of one length, at most ``most`` at a time; long words one by one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(sizes <= SHORT)
    codes, _ = _codes([words[i] for i in short])
    for length in np.unique(sizes[short]):
        rows = np.flatnonzero(sizes[short] == length)
        for part in np.array_split(rows, -(-len(rows) // most)):
            yield short[part], codes[part, :length]
    for i in np.flatnonzero(sizes > SHORT):
        yield np.array([i]), _codes([words[i]])[0]


class Model:
    """Languages, priors and piece probabilities."""

    def __init__(self, pieces: list[str], languages: list[str], priors: np.ndarray, table: np.ndarray):
        self.pieces, self.languages, self.priors, self.table = pieces, languages, priors, table
        self.lattice: Lattice | None = None
        self.known = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(languages)))

    def score_words(self, words: list[str]) -> np.ndarray:
        """[word, language] log probabilities."""
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
        out = np.zeros((len(words), len(self.languages)))
        for places, codes in _by_length(words, 8192):
            out[places] = (np.log(forward(self.lattice, codes, self.table)) if codes.shape[1] <= SHORT
                           else forward_long(self.lattice, codes[0], self.table))
        return out

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number, posterior) of each text."""
        data, offsets, words = _lowered(column)
        log = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(self.known) > KEPT:
            self.known, self.scores = self.known[:0], self.scores[:0]
        if len(words.start):
            seen, where = np.unique(words.hash, return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, seen), max(len(self.known) - 1, 0))
            new = np.flatnonzero(self.known[at] != seen) if len(self.known) else np.arange(len(seen))
            if len(new):
                first = np.empty(len(seen), np.int64)
                first[where[::-1]] = np.arange(len(where))[::-1]
                fresh = self.score_words(_texts(data, words, first[new]))
                known = np.append(self.known, seen[new])
                order = np.argsort(known)
                self.known, self.scores = known[order], np.concatenate([self.scores, fresh])[order]
            rows = self.scores[np.searchsorted(self.known, seen)][where]
            sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
            log = sums[words.first[1:]] - sums[words.first[:-1]]
        log = log + np.log(self.priors)
        best = log.argmax(axis=1)
        top = log[np.arange(len(best)), best]
        return best, 1 / np.exp(log - top[:, None]).sum(axis=1)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    data, offsets = column_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    return data, offsets, find_words(data, offsets, LETTERS)


def count_words(docs: DataFrame, lang_col: str, text_col: str, staging: Staging) -> DataFrame:
    """(lang, word, n) over all ``docs``, a table in the shared folder."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 4 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                data, _, words = _lowered(batch.column("text").filter(pa.array(langs == lang)))
                _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(_texts(data, words, first), pa.string()),
                                                  pa.array(n, pa.int64())], ["lang", "word", "n"])

    counted = rows.mapInArrow(count, "lang string, word string, n long")
    return staging.write(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def _table(counts: np.ndarray, pieces: list[str]) -> np.ndarray:
    """[piece or uncovered character, language] from expected counts [language, piece]."""
    chance = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * counts.shape[1])
    single = np.array([len(p) == 1 for p in pieces])
    chance = np.maximum(chance, np.where(single, UNSEEN, SMALL))
    return np.append(chance, np.full((len(chance), 1), UNSEEN), axis=1).T.copy()


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", file: str | None = None) -> Model:
    """The model of all rows of ``docs`` with a text and a language."""
    spark, staging = docs.sparkSession, Staging(docs.sparkSession, "langid")
    pieces = pieces_of(file or public_pieces())
    known = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    shares = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy("lang").collect()
    languages = [r["lang"] for r in shares]
    total = sum(r["count"] for r in shares)
    priors = np.array([r["count"] / total for r in shares])
    table = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    table[-1] = UNSEEN
    model = Model(pieces, languages, priors, table)
    if not languages:
        return model
    words = count_words(known, lang_col, text_col, staging)
    # the table is small in bytes and dear to walk: so many words make a task
    words = words.repartition(max(spark.sparkContext.defaultParallelism, -(-words.count() // WORDS_AT_ONCE)), "lang", "word")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            lattice, number = Lattice(now.pieces), {x: i for i, x in enumerate(now.languages)}
            sums = np.zeros((len(now.languages), len(now.pieces) + 1))
            for batch in batches:
                langs = np.array([number[x] for x in batch.column("lang").to_pylist()])
                weight = batch.column("n").to_numpy().astype(float)
                names = batch.column("word").to_pylist()
                for k in np.unique(langs):
                    own = np.flatnonzero(langs == k)
                    for places, codes in _by_length([names[i] for i in own], 4096):
                        if codes.shape[1] <= SHORT:
                            sums[k] += expected(lattice, codes, now.table[:, k], weight[own[places]], len(now.pieces))
                        else:
                            expected_long(lattice, codes[0], now.table[:, k], float(weight[own[places[0]]]), sums[k])
            lang, piece = np.nonzero(sums[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)),
                                              pa.array(sums[lang, piece])], ["lang", "piece", "n"])

        found = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(languages), len(pieces)))
        counts[found["lang"], found["piece"]] = found["n"]
        model = Model(pieces, languages, priors, _table(counts, pieces))
        shared.unpersist()
    staging.drop("words")
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score): the row as a struct (of the columns ``keep``, or all) and its language."""
    out, texts = carried(docs, text_col, keep)
    text = F.col("row")[text_col] if "text" not in out.columns else F.col("text")
    out = out.withColumn("able", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in slices(batches, texts):
            able = batch.column("able").to_numpy(zero_copy_only=False).astype(bool)
            if now.languages:
                best, score = now.judge(texts(batch))
                langs = np.where(able, np.array(now.languages, object)[best], "und")
            else:
                langs, score = np.full(len(able), "und", object), np.zeros(len(able))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(np.where(able, score, 0.0))], names)

    return out.mapInArrow(run, T.StructType([out.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
