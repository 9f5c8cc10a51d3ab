"""Piece models: the whole vocabulary, uncut words, expected counts, and odd inputs."""

import itertools
import math

import numpy as np
import pytest

from keysift.llm import langid

PIECES = sorted(["▁", "a", "b", "ab", "ba", "aab", "▁a", "abababababababababababababababab", "bb"])


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        piece = word[:n]
        if piece in PIECES or n == 1:
            for rest in segmentations(word[n:]):
                yield [piece, *rest]


def table(languages=2):
    draw = np.random.default_rng(1)
    return np.vstack([draw.uniform(0.01, 0.2, (len(PIECES), languages)), np.full((1, languages), 1e-3)])


def codes(word):
    return np.array([ord(c) for c in word], np.uint64)


@pytest.mark.parametrize("word", ["▁ab", "▁aabba", "▁zab", "b", "▁" + "ab" * 7])
def test_long_and_short_ways_equal_all_segmentations(word, monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 3)
    lattice, t = langid.Lattice(PIECES), table()
    at = {p: i for i, p in enumerate(PIECES)}
    ways = list(segmentations(word))
    for k in (0, 1):
        chances = [math.prod(t[at.get(p, -1), k] for p in way) for way in ways]
        assert math.isclose(langid.forward(lattice, codes(word)[None], t)[0, k], sum(chances), rel_tol=1e-9)
        assert math.isclose(langid.forward_long(lattice, codes(word), t)[k], math.log(sum(chances)), rel_tol=1e-9, abs_tol=1e-9)
        want = np.zeros(len(PIECES) + 1)
        for chance, way in zip(chances, ways):
            for p in way:
                want[at.get(p, -1)] += 3 * chance / sum(chances)
        assert np.allclose(langid.expected(lattice, codes(word)[None], t[:, k], np.array([3.0]), len(PIECES)), want)
        got = np.zeros(len(PIECES) + 1)
        langid.expected_long(lattice, codes(word), t[:, k], 3.0, got)
        assert np.allclose(got, want)


def test_every_piece_of_the_vocabulary_is_there():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=langid.public_pieces())
    pieces = set(langid.pieces_of(langid.public_pieces()))
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and all(c.isalpha() or c == "▁" for c in piece) and piece:
            assert piece in pieces
    assert langid.Lattice(sorted(pieces)).longest > 12


def test_a_long_word_neither_vanishes_nor_is_cut():
    lattice, t = langid.Lattice(PIECES), table(1)
    word = "▁" + "ab" * 20_000
    log = langid.forward_long(lattice, codes(word), t)
    assert np.isfinite(log).all()
    got = np.zeros(len(PIECES) + 1)
    langid.expected_long(lattice, codes(word[:5001]), t[:, 0], 1.0, got)
    assert math.isclose(sum(got[i] * len(p) for i, p in enumerate(PIECES)) + got[-1], 5001, rel_tol=1e-9)


def test_repeats_clashing_names_and_nulls(spark):
    schema = "doc_id long, text string, lang string, able int, row string, score string"
    rows = [(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de", 1, "r", "s") for i in range(6)]
    docs = spark.createDataFrame(rows + [rows[0], (9, None, "en", 1, "r", "s"), (10, "12 34", None, None, None, None)], schema)
    got = langid.predict(docs, langid.fit(docs)).collect()
    found = [(r["row"]["doc_id"], r["lang_pred"]) for r in got]
    assert sorted(found) == sorted([(i, "en" if i % 2 else "de") for i in range(6)] + [(0, "de"), (9, "und"), (10, "und")])
    assert {r["row"]["able"] for r in got} == {1, None}
    few = langid.predict(docs, langid.fit(docs), keep=["able", "row"]).collect()
    assert len(few) == len(got) and set(few[0]["row"].asDict()) == {"able", "row"}


def test_lanes_of_words_cover_each_once():
    words = ["a" * n for n in (1, 1, 24, 25, 3, 400)]
    places = list(itertools.chain.from_iterable(p.tolist() for p, _ in langid._by_length(words, 1)))
    assert sorted(places) == list(range(6))
    assert list(langid._by_length([], 5)) == []
