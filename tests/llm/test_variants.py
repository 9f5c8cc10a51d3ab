"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keysift.llm import variants
from keysift.sources.staging import Staging

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    out = Counter()
    for id_, text in rows:
        for run in RUN.findall(text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def grouped(words):
    near = defaultdict(list)
    for a in words:
        near[a] = [b for b in words if one_apart(a, b)]
    form = {}
    for a, others in near.items():
        if others:
            best = min(others, key=lambda w: (-words[w], w))
            if words[best] >= 10 * words[a]:
                form[a] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows_of(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_grouping_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {}
    while len(words) < 250:
        word = "".join(rng.choice("aabé") for _ in range(rng.choice((7, 7, 8, 8, 9))))
        words[word] = rng.choice((2, 2, 3, 20, 25, 300, 4000))
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert rows_of(variants.group_variants(frame)) == grouped(words)


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["Parlamentar", "parlamentare", "Écoliers", "abcdefgh", "xyzzyxyzzy", "short", "wortspiel×÷"]
    rows = [(i, " ".join(rng.choices(base, k=30)) + ("1" if i % 2 else "\n")) for i in range(60)]
    rows += [(7, None), (8, ""), (None, "parlamentar parlamentar"), (3, rows[3][1]), (3, rows[3][1]), (99, "q" * 70_000), (98, "q" * 70_000)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = rows_of(variants.spelling_variants(docs))
    assert got == grouped(counted(rows))
    assert any(form for _, form, *_ in got)


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "zzzzzzz": 5, "zzzzzzzz": 5}
    got = rows_of(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)
    assert {r[2] for r in got if r[0].startswith("abc")} == {"abcdefghijk"}


def test_ties_go_to_the_smallest(spark):
    words = {"aaaaaaab": 50, "aaaaaaac": 50, "aaaaaaad": 5}
    got = rows_of(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert ("aaaaaaad", "aaaaaaab", "aaaaaaab", 5, 2, 50) in got


def test_nodes_are_numbered_across_ranges(spark):
    words = sorted({f"{a}{b}{c}" for a in ("commonprefix", "common", "other") for b in "abcde" for c in range(40)} | {"x" * 3000})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, id long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["word"]: r["path"] for r in variants.number_nodes(frame, Staging(spark, "t"), "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of_node, of_prefix = {}, {}
    for word, path in got.items():
        assert len(path) == len(word)
        for depth, node in enumerate(path, 1):
            assert of_node.setdefault(node, word[:depth]) == word[:depth]
            assert of_prefix.setdefault(word[:depth], node) == node
    assert len(got) == len(words)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(docs).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert variants.spelling_variants(only).agg(F.count("*")).first()[0] == 0
