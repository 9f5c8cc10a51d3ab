"""A quality classifier: naive Bayes features in a linear support-vector machine.

*Features* are indicators of word and word-pair n-grams, hashed to ``BUCKETS``.  Tokens are runs of
letters and digits, lower-cased, and runs of other visible characters; pairs and triples of one and the same token also set a bucket of their own, common to all tokens.

*Learning.*  Over all labelled training texts the texts of each class that have a feature are counted (summed in the tasks, then
merged); the log-count ratio of the classes scales each indicator, and rows are brought to length one.  A hinge-loss linear model is
fitted to at most ``SAMPLE`` labelled training texts, those with the smallest hash, and of these to no more than together have ``FEATURES`` features, by dual coordinate
descent in one task; a fifth of them is kept back to fit the logistic curve that turns margins into scores.  The weights are ``BUCKETS`` numbers, whatever the input's size.

*Joining.*  Labels first meet the narrow ids of the training texts.  What is left is broadcast to the texts if a count of its rows proves it to be at most ``SENT``;
a larger table is joined by sort-merge, which moves the training texts once.

*Defined results.*  Null and empty texts have no features: their score follows from the intercept.  Without labels of both classes the score is the
share of label 1 (0.5 without labels).  A text with several labels counts once for each, and so do rows with equal ids.  Labels of other ids count nothing.
Long texts have all their features; other columns are carried inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from keysift.llm.words import LOWER, WORD_BYTES, byte_class, carried, column_bytes, find_words, slices, text_column
from keysift.sources.staging import Staging

BUCKETS = 1 << 18
SAMPLE = 10_000
FEATURES = 20_000_000
SENT = 1_000_000
EPOCHS = 12
COST = 1.0
ALPHA = 1.0
OTHERS = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(32))) * MIX


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, distinct and sorted; buckets 0 and 1 stand for any token twice and three times in a row."""
    raw, offsets = column_bytes(column)
    low = LOWER[raw]
    parts = [find_words(low, offsets, kind) for kind in (WORD_BYTES, OTHERS)]
    start = np.concatenate([p.start for p in parts])
    order = np.argsort(start, kind="stable")
    token = _mixed(np.concatenate([p.hash for p in parts])[order])
    text = np.searchsorted(offsets, start[order], "right") - 1
    same = text[1:] == text[:-1]
    pair = _mixed(token[:-1] * np.uint64(3) + token[1:])[same]
    again = same & (token[1:] == token[:-1])
    key = np.concatenate([(text << 18) | (token >> np.uint64(46)).astype(np.int64),
                          (text[1:][same] << 18) | (pair >> np.uint64(46)).astype(np.int64),
                          text[1:][again] << 18, (text[2:][again[1:] & again[:-1]] << 18) | 1])
    key = np.unique(key)
    return key >> 18, key & (BUCKETS - 1)


@dataclass
class Model:
    """A score is 1 / (1 + exp(-(slope * margin + shift))); ``weights`` include the ratios, ``ratios`` give the length of a row."""
    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, column: pa.Array) -> np.ndarray:
        text, bucket = features(column)
        n = len(column)
        length = np.sqrt(np.bincount(text, self.ratios[bucket] ** 2, n))
        margin = np.bincount(text, self.weights[bucket], n) / np.where(length > 0, length, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def log_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """Of (text, label): log-count ratio of each bucket, texts of class 1, texts of class 0."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(iter([batch]), text_column):
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                text, bucket = features(part.column("text"))
                for k in (0, 1):
                    sums[k] += np.bincount(bucket[label[text] == k], minlength=BUCKETS)
                n += np.bincount(label, minlength=2)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(sums[0][used], n[0])),
                                          pa.array(np.append(sums[1][used], n[1]))], ["bucket", "bad", "good"])

    found = (labelled.mapInArrow(count, "bucket long, bad long, good long").groupBy("bucket")
             .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas())
    counts = np.full((2, BUCKETS), ALPHA)
    rows = found[found.bucket >= 0]
    counts[0][rows.bucket] += rows.bad
    counts[1][rows.bucket] += rows.good
    total = found[found.bucket < 0][["bad", "good"]].sum()
    chance = counts / counts.sum(axis=1, keepdims=True)
    return np.log(chance[1] / chance[0]), int(total.good), int(total.bad)


def coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model of sparse ``rows`` (places, values); the last place is the intercept.

    The rarer class weighs as much as the other.
    """
    weights, dual = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    share = np.array([(sign < 0).mean(), (sign > 0).mean()])
    most = COST * 0.5 / np.where(sign > 0, share[1], share[0])
    square = np.array([v @ v for _, v in rows])
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            places, values = rows[i]
            slope = sign[i] * (weights[places] @ values) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), most[i])
            if new != dual[i]:
                weights[places] += (new - dual[i]) * sign[i] * values
                dual[i] = new
    return weights


def logistic(margin: np.ndarray, label: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by damped Newton steps on smoothed targets."""
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    both, at = np.stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ both, -40, 40)))
        step = np.linalg.solve((both * (p * (1 - p) + 1e-9)) @ both.T + 1e-6 * np.eye(2), both @ (p - target))
        at -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return float(at[0]), float(at[1])


def _bounded(batches: Iterator[pa.RecordBatch], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the first texts that together have no more than ``most`` features, one text at least."""
    rows, labels, size = [], [], 0
    for batch in batches:
        for places, label in zip(batch.column("buckets"), batch.column("label").to_pylist()):
            places = places.values.to_numpy().astype(np.int32)
            size += len(places)
            if rows and size > most:
                return rows, np.array(labels, np.int64)
            rows.append(places)
            labels.append(label)
    return rows, np.array(labels, np.int64)


def _fit_rows(found: list[np.ndarray], label: np.ndarray, ratios: np.ndarray) -> Model:
    rows = []
    for places in found:
        values = ratios[places]
        length = np.sqrt(values @ values)
        rows.append((np.append(places, BUCKETS), np.append(values / length if length > 0 else values, 1.0)))
    kept = np.arange(len(rows)) % 5 == 4
    if len(set(label[~kept])) < 2 or len(set(label[kept])) < 2:
        kept[:] = False
    sign = np.where(label > 0, 1.0, -1.0)
    learn = np.flatnonzero(~kept)
    weights = coordinate_descent([rows[i] for i in learn], sign[learn])
    check = np.flatnonzero(kept) if kept.any() else learn
    margin = np.array([weights[rows[i][0]] @ rows[i][1] for i in check])
    slope, shift = logistic(margin, label[check])
    return Model(weights[:-1] * ratios, ratios, float(weights[-1]), slope, shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of the rows of ``docs`` that ``labels`` mark with 1 or 0."""
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    ids = texts.select("id").filter("id IS NOT NULL").distinct()
    staging = Staging(docs.sparkSession, "quality")
    marks = staging.write(marks.join(ids, "id", "left_semi"), "marks")
    marks = F.broadcast(marks) if marks.count() <= SENT else marks.hint("merge")  # the size is checked
    labelled = texts.join(marks, "id")
    ratios, good, bad = log_ratios(labelled.select("text", "label"))

    def by_share() -> Model:
        share = good / (good + bad) if good + bad else 0.5
        odds = float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else (40 if share else -40), -40, 40))
        return Model(np.zeros(BUCKETS), ratios, 0.0, 0.0, odds)

    if not good or not bad:
        return by_share()
    # the sample is one of labelled training texts; at most SAMPLE rows of three numbers each: a proven bound
    sample = texts.select("id").join(marks, "id").withColumn("h", F.xxhash64("id")).distinct().orderBy("h", "id", "label").limit(SAMPLE)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            text, bucket = features(batch.column("text"))
            sizes = np.bincount(text, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), lists], ["h", "label", "buckets"])

    chosen = texts.join(F.broadcast(sample), "id").select("h", "label", "text")
    rows = chosen.mapInArrow(sparse, "h long, label int, buckets array<int>").repartition(1).sortWithinPartitions("h", "label")
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, label = _bounded(batches, FEATURES)
        if got:
            model = _fit_rows(got, label, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([[model.bias, model.slope, model.shift]])],
                                             ["weights", "numbers"])

    found = rows.mapInArrow(learn, "weights binary, numbers array<double>").first()
    if found is None:
        return by_share()
    return Model(np.frombuffer(bytes(found["weights"])), ratios, *found["numbers"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, score): the row as a struct (of the columns ``keep``, or all) and the chance that its label is 1."""
    out, texts = carried(docs, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, texts):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shared.value.score(texts(batch)))], ["row", "score"])

    return out.mapInArrow(run, T.StructType([out.schema["row"], T.StructField("score", T.DoubleType())]))
