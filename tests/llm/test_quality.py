"""The quality classifier against plain Python: features, log-count ratios, the linear model; and its results for odd inputs."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keysift.llm import quality

TOKEN = re.compile(r"[0-9a-z\u0080-\U0010FFFF]+|[!-/:-@\[-`{-~]+")
DOCS = "doc_id long, text string, row string, score double, label int"


def buckets(text):
    return set(quality.features(pa.array([text]))[1].tolist())


def expected(text):
    """Buckets of tokens alone, and of neighbours, each looked up by itself."""
    tokens = TOKEN.findall(text.lower() if text.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    out = set()
    for t in tokens:
        out |= buckets(t)
    for a, b in zip(tokens, tokens[1:]):
        out |= buckets(f"{a} {b}")
    for a, b, c in zip(tokens, tokens[1:], tokens[2:]):
        if a == b == c:
            out.add(1)
    return out


@pytest.mark.parametrize("text", ["", "one", "The cat, the hat.", "a a a b b", "!!! Été x-y", "x " * 50, "Zz 12 zZ"])
def test_features_are_tokens_and_neighbours(text):
    assert buckets(text) == expected(text)


def test_features_do_not_cross_texts():
    texts = ["a b", "b c", "", "c"]
    text, bucket = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert set(bucket[text == i].tolist()) == buckets(t)


def frames(spark, texts, marks):
    docs = spark.createDataFrame([(i, t, "r", 0.1, 3) for i, t in texts], DOCS).repartition(3)
    return docs, spark.createDataFrame([(i, m, "x") for i, m in marks], "doc_id long, quality int, text string")


def test_log_ratios_equal_plain_counts(spark):
    rng = random.Random(1)
    texts = [(" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 12))), rng.randrange(2)) for _ in range(60)] + [("", 1), ("", 0)]
    got, good, bad = quality.log_ratios(spark.createDataFrame(texts, "text string, label int").repartition(4))
    counts = [dict(), dict()]
    for text, label in texts:
        for b in buckets(text):
            counts[label][b] = counts[label].get(b, 0) + 1
    total = [sum(c.values()) + quality.BUCKETS for c in counts]
    for b in set(counts[0]) | set(counts[1]):
        want = math.log((counts[1].get(b, 0) + 1) / total[1]) - math.log((counts[0].get(b, 0) + 1) / total[0])
        assert math.isclose(got[b], want, abs_tol=1e-9)
    assert (good, bad) == (sum(m for _, m in texts), sum(1 - m for _, m in texts))


def plain_machine(rows, sign, cost, rounds=3000):
    """Projected gradient ascent on the dual of the hinge-loss model, on dense vectors."""
    x = np.zeros((len(rows), 40))
    for i, (places, values) in enumerate(rows):
        x[i, places] = values
    gram = (x @ x.T) * np.outer(sign, sign)
    dual, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(rounds):
        dual = np.clip(dual + step * (1 - gram @ dual), 0, cost)
    return (dual * sign) @ x


def test_coordinate_descent_equals_a_plain_machine(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 39)
    monkeypatch.setattr(quality, "EPOCHS", 400)
    draw = np.random.default_rng(3)
    sign = np.where(draw.random(50) < 0.3, 1.0, -1.0)
    rows = [(np.append(np.sort(draw.choice(39, 6, replace=False)), 39), np.append(draw.normal(s * 0.2, 1, 6), 1.0)) for s in sign]
    got = quality.coordinate_descent(rows, sign)
    cost = quality.COST * 0.5 / np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    assert np.allclose(got, plain_machine(rows, sign, cost), atol=2e-3)


def labelled(n=80):
    rng = random.Random(4)
    words = (["vile", "junk", "spam", "buy"], ["calm", "clear", "sound", "true"])
    texts = [(i, " ".join(rng.choices(words[i % 2] + ["the", "of"], k=15))) for i in range(n)]
    return texts, [(i, i % 2) for i in range(n)]


def scores(docs, model):
    return {r["row"]["doc_id"]: r["score"] for r in quality.predict(docs, model).collect()}


def test_label_table_much_larger_than_the_documents(spark):
    texts, marks = labelled(12)
    docs, labels = frames(spark, texts, marks)
    many = labels.unionByName(spark.range(1000, 401_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit("x").alias("text")))
    got, alone = scores(docs, quality.fit(docs, many)), scores(docs, quality.fit(docs, labels))
    assert got.keys() == alone.keys() and all(math.isclose(got[i], alone[i], rel_tol=1e-9) for i in got)


def test_sort_merge_gives_the_same(spark, monkeypatch):
    docs, labels = frames(spark, *labelled())
    want = scores(docs, quality.fit(docs, labels))
    monkeypatch.setattr(quality, "SENT", 0)
    got = scores(docs, quality.fit(docs, labels))
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert all((want[i] > 0.5) == bool(i % 2) for i in want)


@pytest.mark.parametrize("marks, share", [([], 0.5), ([(900, 1), (901, 0)], 0.5), ([(1, 1)], 1.0), ([(2, 0), (3, 0)], 0.0), ([(1, None), (None, 1)], 0.5)])
def test_labels_that_teach_nothing(spark, marks, share):
    docs, labels = frames(spark, labelled(20)[0] + [(50, None), (51, "")], marks)
    got = scores(docs, quality.fit(docs, labels))
    assert len(got) == 22 and all(abs(s - share) < 1e-9 for s in got.values())


def test_empty_tables_repeats_and_long_texts(spark, monkeypatch):
    docs, labels = frames(spark, [], [(1, 1), (2, 0)])
    assert scores(docs, quality.fit(docs, labels)) == {}
    texts, marks = labelled()
    docs, labels = frames(spark, texts + [texts[0], texts[0], (200, "vile " * 100_000), (201, None)], marks + marks[:4])
    monkeypatch.setattr(quality, "FEATURES", 500)
    got = quality.predict(docs, quality.fit(docs, labels)).collect()
    same = {r["score"] for r in got if r["row"]["doc_id"] == 0}
    assert len(got) == 84 and len(same) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["row"]["row"] == "r" and got[0]["row"]["score"] == 0.1


def test_features_in_the_sample_are_bounded():
    batch = pa.record_batch([pa.array([1, 0, 1, 0]), pa.array([[1, 2, 3], [], [4, 5], [6]], pa.list_(pa.int32()))], ["label", "buckets"])
    rows, label = quality._bounded(iter([batch]), 4)
    assert [r.tolist() for r in rows] == [[1, 2, 3], []] and label.tolist() == [1, 0]
    assert len(quality._bounded(iter([batch]), 1)[0]) == 1
