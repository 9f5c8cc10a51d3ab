"""The recurrent language model against plain recursions, and its scores against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.llm import lm_score
from keysift.llm.gru import Gru, Moments, in_lanes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [""]


def small(seed=3):
    counts = np.array([5, 9, 4, 3, 2, 1, 1])
    model = Gru.fresh(4, 3, 3, counts, seed)
    draw = np.random.default_rng(seed)
    for k, v in model.weights.items():
        model.weights[k] = v + draw.normal(0, 0.3, v.shape).astype(np.float32) * (np.abs(v) < 30)
    return model


def chances(model, state):
    """Of one state: the chance of every id, written out."""
    w, one = model.weights, np.append(state, 1.0)

    def softmax(x):
        x = np.exp(x - x.max())
        return x / x.sum()

    groups = softmax(one @ w["classes"])
    return np.concatenate([groups[c] * softmax(one @ w["words"][c]) for c in range(model.n_classes)])


def plain(model, ids, start=0):
    """The log chance of one text and the states, one token at a time in double precision."""
    w, n = {k: v.astype(float) for k, v in model.weights.items()}, model.hidden
    state, total, given = np.zeros(n), 0.0, start
    for x in ids:
        turned, gates = state @ w["turn"], w["inputs"][given]
        keep, reset = 1 / (1 + np.exp(-(gates[:n] + turned[:n]))), 1 / (1 + np.exp(-(gates[n:2 * n] + turned[n:2 * n])))
        fresh = np.tanh(gates[2 * n:] + reset * (turned[2 * n:] + w["offset"]))
        state = (1 - keep) * fresh + keep * state
        total += math.log(chances(model, state)[x])
        given = x
    return total


def test_chances_add_up_to_one():
    model = small()
    for state in np.random.default_rng(0).uniform(-1, 1, (5, 4)):
        p = chances(model, state)
        assert abs(p.sum() - 1) < 1e-6 and p[7:].max() < 1e-6  # identifiers that no token has


@pytest.mark.parametrize("lanes", [1, 2, 512])
def test_scores_equal_the_plain_recursion(lanes):
    model, rng = small(), np.random.default_rng(1)
    texts = [np.append(rng.integers(1, 7, n), 0).astype(np.uint16) for n in (0, 1, 5, 40, 3, 0, 300, 17)]
    got = model.score(texts, 0, most=lanes, held=64)
    assert np.allclose(got, [plain(model, x) for x in texts], rtol=1e-4)
    assert model.score([], 0).tolist() == []


def test_gradients_equal_differences():
    model, rng = small(), np.random.default_rng(2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, targets, state = rng.integers(0, 7, (5, 3)), rng.integers(0, 7, (5, 3)), rng.uniform(-0.5, 0.5, (4, 3))
    grads, _, _ = model.gradients(state, ids, targets)
    for name, weight in model.weights.items():
        for place in rng.permutation(weight.size)[:12]:
            at = np.unravel_index(place, weight.shape)
            if abs(weight[at]) > 30:
                continue
            was, losses = weight[at], []
            for step in (1e-2, -1e-2):
                weight[at] = was + step
                losses.append(model.gradients(state, ids, targets)[2])
            weight[at] = was
            assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_large_weights_do_not_overflow():
    model = small()
    model.weights["classes"][:] *= 400
    assert np.isfinite(model.score([np.array([1, 2, 0])], 0)).all()


def test_training_learns_an_order():
    rng = random.Random(1)
    texts = [np.array([2 + (s + i) % 5 for i in range(rng.randrange(5, 30))] + [0]) for s in range(200)]
    model, moments = Gru.fresh(8, 3, 3, np.bincount(np.concatenate(texts), minlength=7)), Moments()
    given, wanted = in_lanes(texts, 0, 16)
    losses = [x for _ in range(12) for x in model.train(given, wanted, iter(lambda: 0.02, None), 8, moments)]
    assert np.mean(losses[-10:]) < 0.5 * np.mean(losses[:10])


def test_lanes_hold_every_token():
    texts = [np.arange(1, n + 1) for n in (3, 50, 1)]
    given, wanted = in_lanes(texts, 0, 4)
    assert wanted.ravel()[:54].tolist() == np.concatenate(texts).tolist() and given.ravel()[:4].tolist() == [0, 1, 2, 3]
    assert in_lanes([], 0)[0].size == 0


def base_of(rows, held):
    c = Counter()
    for i, text in rows:
        if i not in held:
            c.update(tokens(text))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}, c


def made():
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(1, 60))) + "\tEnd.") for i in range(80)]
    return rows + [(80, None), (81, ""), (82, "  \n"), (83, "é" * 5000 + " Only Here"), (84, rows[0][1]), (85, "x " * 20_000), (86, "y z \x1c")]


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_base_equals_brute_force_with_any_head(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    monkeypatch.setattr(lm_score, "UPDATES", 5)
    rows = made()
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in rows], "doc_id long, text string, row long, learn string").repartition(3)
    got = {r["id"]: r for r in lm_score.score_documents(docs, F.col("doc_id") % 7 == 2).collect()}
    want, _ = base_of(rows, {i for i, _ in rows if i % 7 == 2})
    assert got.keys() == want.keys()
    for i, (n, known, train, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, i % 7 == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert math.isclose(got[0]["score"], got[84]["score"], rel_tol=1e-5)


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """The score is the plain recursion over identifiers and the add-one share of words without an own one."""
    monkeypatch.setattr(lm_score, "UPDATES", 20)
    kept = []
    fitted = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: kept.append(fitted(*a)) or kept[0])
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(rng.randrange(1500), rng.randrange(1500))}" for _ in range(60))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in lm_score.score_documents(docs, F.col("doc_id") % 7 == 2).collect()}
    _, c = base_of(rows, {i for i, _ in rows if i % 7 == 2})
    own = sorted((w for w in c if w), key=lambda w: (-c[w], w))[:lm_score.CLASSES * lm_score.MEMBERS - 2]
    ids = {"": 0} | {w: k + 2 for k, w in enumerate(own)}
    other = {w: n for w, n in c.items() if w not in ids}
    assert other
    for i, text in rows[:20]:
        found = [ids.get(w, 1) for w in tokens(text)]
        want = plain(kept[0], found) / math.log(10)
        want += sum(math.log10((other.get(w, 0) + 1) / (sum(other.values()) + len(other) + 1)) for w in tokens(text) if w not in ids)
        assert math.isclose(got[i], want, rel_tol=1e-4)


def test_the_model_beats_the_base_on_texts_it_has_not_seen(spark):
    rng = random.Random(2)
    words = [[f"{a}{k}" for k in range(40)] for a in "ab"]
    rows = [(i, " ".join(rng.choices(words[i % 2], k=80))) for i in range(400)]
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 == 2).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.95 * sum(r["base_score"] for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score_documents(docs, F.lit(False)).count() == 0
    docs = spark.createDataFrame([(2, "never learnt"), (9, None)], "doc_id long, text string")
    got = {r["id"]: r for r in lm_score.score_documents(docs, F.col("doc_id") % 7 == 2).collect()}
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in (got[2], got[9])] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_head_is_bounded_and_rest_is_joined(spark):
    counts = spark.createDataFrame([(f"w{i}", 1, 1 + i // 10) for i in range(100)], "word string, n long, seen long")
    got = lm_score.most_seen(counts, 25).collect()
    assert 0 < len(got) <= 25 and min(r["seen"] for r in got) >= 8
    assert lm_score.most_seen(counts, 3).count() == 0
