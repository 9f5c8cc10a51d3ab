"""Source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from keysift.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, g int, sid string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, documents=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms(text))
        seen[lang].update(set(terms(text)))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= documents]
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + v) for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in sources if o != s]
            hits = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", hits)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def rows_of(frame):
    return {tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()}


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(7, t, la, s, "x", 1, "y") for t, la, s in rows], SCHEMA).repartition(parts)


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("wort", "mot", "Éa", "ß", "z") for b in "abcdefghijk"]
    rows = [(" ".join(rng.choices(words[:rng.choice((5, 20, 55))], k=rng.randrange(0, 30))) + rng.choice(("", " 1x2", "-\n")),
             rng.choice(("en", "de", None, "")), rng.choice(("s1", "s1", "s1", "s2", "s3", None))) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "xx", "lonely"), ("...", "yy", "a"), ("wort", "yy", "b"), ("q" * 90_000, "en", "s2")] * 3


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    assert rows_of(divergence.divergence(frame(spark, rows))) == brute(rows)


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rows = made(9)
    want = rows_of(divergence.divergence(frame(spark, rows), top=5))
    monkeypatch.setattr(divergence, "BLOCK", 50)  # goes to the workers with the function that reads it
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    assert rows_of(divergence.divergence(frame(spark, rows, 1), top=5)) == want == brute(rows, top=5)


def test_runs_are_sorted_and_merge_to_the_same_counts():
    import pyarrow as pa
    block = divergence.Block()
    block.add(pa.array(["b a b", "c a"]), ["en", "de"], np.array([5, 6]))
    block.add(pa.array(["a b É"]), ["en"], np.array([9]))
    got = [(r["lang"], r["term"], r["docs"], dict(np.frombuffer(r["postings"], divergence.POSTING).tolist()))
           for batch in block.run() for r in batch.to_pylist()]
    assert got == [("de", "a", 1, {6: 1}), ("de", "c", 1, {6: 1}), ("en", "a", 2, {5: 1, 9: 1}), ("en", "b", 2, {5: 2, 9: 1}), ("en", "É", 1, {9: 1})]


def test_many_batches_of_one_term(spark):
    rows = [("same word here", "en", f"s{i % 50}") for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert rows_of(divergence.divergence(frame(spark, rows, 8))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F
    made = spark.createDataFrame([(0, 0), (0, 1), (99, 100), (10 ** 13, 10 ** 14 + 7), (10 ** 14, 10 ** 14 + 1)], "c long, m long")
    for r in made.select("c", "m", divergence.share(F.col("c"), F.col("m")).alias("p")).collect():
        assert r["p"] == 1 + 10 ** 9 * (r["c"] + 1) // max(r["m"], 1)


def test_empty_tables(spark):
    assert rows_of(divergence.divergence(frame(spark, [], 1))) == set()
    rows = [(None, None, None), ("", "en", "a"), ("word", "en", "b")]
    assert rows_of(divergence.divergence(frame(spark, rows, 1))) == brute(rows) == {
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_a_block_holds_numbers_of_32_bits_and_adds_up_64():
    """A block's memory is what bounds an executor; it is empty once it was spilled."""
    block = divergence.Block()
    for _ in range(3):
        block.add(pa.array(["b a b", None, "a"]), ["x", "x", "y"], np.array([5, 5, 6]))
    assert all(x.dtype == np.int32 for part in block.parts for x in part[1:])
    for part in block.parts:
        part[3][:] = 2_000_000_000
    rows = [r for batch in block.run() for r in batch.to_pylist()]
    assert block.parts == []
    got = {(r["lang"], r["term"]): (r["docs"], np.frombuffer(r["postings"], divergence.POSTING).tolist()) for r in rows}
    assert got == {("x", "a"): (3, [(5, 6_000_000_000)]), ("x", "b"): (3, [(5, 6_000_000_000)]), ("y", "a"): (3, [(6, 6_000_000_000)])}
