"""The training-data operators against brute force, and their defined results for nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keysift.llm import (bpe, decontaminate, exact_dedup, langid, quality, secret_index, simhash, token_files, url_rules, warc)
from keysift.llm.components import components
from keysift.llm.fm_index import FmIndex, suffix_array
from keysift.llm.words import LOWER, find_words, word_hash
from keysift.sources.staging import Staging

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def docs(spark):
    def make(*texts, ids=None):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], SCHEMA)
    return make


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- words and the FM-index

def test_words_match_the_expression():
    text = "Ab1 éÉ--x\n" + "z" * 600_000 + " y"
    data = np.frombuffer(text.encode(), np.uint8)
    low = LOWER[data]
    found = find_words(low, np.array([0, len(data)]))
    got = [low[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    assert got == WORD.findall(lowered(text))
    assert [word_hash(x.encode()) for x in got] == found.hash.tolist()


def test_words_stop_at_text_edges():
    data = np.frombuffer(b"abcdef", np.uint8)
    found = find_words(data, np.array([0, 2, 2, 4, 6]))
    assert found.start.tolist() == [0, 2, 4] and found.first.tolist() == [0, 1, 1, 2, 3]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_search(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 9))
    text = rng.integers(0, size, 400)
    text = np.concatenate([text, text[:150], [size]])  # a long repeat; the last symbol is its own
    order = suffix_array(text, size + 1)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = FmIndex(text, size + 1)
    for length in (1, 2, 5):
        phrases = np.array([text[i:i + length] for i in range(0, 300, 37)] + [rng.integers(0, size, length)])
        low, high = index.search(phrases, np.full(len(phrases), length))
        for p, a, b in zip(phrases, low, high):
            places = [i for i in range(len(text) - length + 1) if (text[i:i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == places


# --- 1 decontamination

def brute_contamination(text, items, size=10):
    windows = {}
    for item, body in items:
        w = WORD.findall(lowered(body))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(item)
    w, hit, found = WORD.findall(lowered(text)), set(), set()
    for window, owners in windows.items():
        for k in range(len(w) - len(window) + 1):
            if tuple(w[k:k + len(window)]) == window:
                hit |= set(range(k, k + len(window)))
                found |= owners
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("shard, block", [(decontaminate.SHARD, decontaminate.BLOCK), (64, 300)])
def test_decontamination_equals_brute_force(spark, docs, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(3)
    items = [(i, words(rng, n)) for i, n in enumerate([30, 10, 11, 4, 1, 25])] + [(7, None), (8, ""), (9, "?!"), (5, words(rng, 12)), (None, words(rng, 10))]
    passages = [body.split() for _, body in items if body]
    texts = [None, "", "!?", " ".join(passages[0][5:20]).upper(), "x " * 70 + items[0][1] + " é " + items[2][1]]
    for _ in range(25):
        base = words(rng, rng.randrange(0, 90)).split()
        at, p = rng.randrange(len(base) + 1), rng.choice(passages)
        texts.append(" , ".join(base[:at] + p[rng.randrange(3):] + base[at:]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs(*texts), benchmark).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = brute_contamination(texts[r["row"]["doc_id"]], items)
        got = r["found"]
        assert (got["n_words"], sum(h["end"] - h["start"] for h in got["hits"]), got["items"]) == (n, hit, found)
        text = texts[r["row"]["doc_id"]]
        inside = [w for s in got["spans"] for w in WORD.findall(lowered(text[s["start"]:s["end"]]))]
        assert len(inside) == hit


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs("a b"), none).count() == 1
    assert decontaminate.drop_contaminated(docs(), none).count() == 0


# --- 2 WARC

def test_archives_give_back_what_was_written(spark):
    same, long = "x" * 150, "é" * 2_000_000
    rows = [(5, "http://a", same, "q"), (3, "http://b\nX: 1", same, "q"), (None, "u", same, None), (7, "s", "short", "q"), (8, "s", "short", "q"),
            (9, None, None, "q"), (10, "", "", "q"), (11, "l", long, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    staging = Staging(spark, "test")
    index = warc.write_archives(pages, staging)
    got = {r["id"]: r for r in warc.read_records(index, staging.path("archives")).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        payload, copy = (html or "").encode(), html == same and page != 3
        r = got[page]
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if copy else ("response", None))
        assert r["payload_bytes"] == len(payload) and r["digest"] == hashlib.sha256(payload).hexdigest()
        assert r["payload"] is None if copy else bytes(r["payload"]) == payload
    some = warc.read_records(index.filter("id IN (7, 11)"), staging.path("archives")).collect()
    assert {r["id"] for r in some} == {7, 11}


def test_copies_joined_by_sort_merge_and_read_in_many_tasks(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", f"payload {i % 7} " * 20) for i in range(200)], "page_id long, url string, html string").repartition(5)
    want = None
    for sent, task in ((warc.SENT, warc.TASK), (0, 500)):
        monkeypatch.setattr(warc, "SENT", sent)
        monkeypatch.setattr(warc, "TASK", task)
        staging = Staging(spark, "test")
        records = warc.read_records(warc.write_archives(pages, staging), staging.path("archives"))
        assert records.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        got = sorted((r["id"], r["record_type"], r["refers_to"]) for r in records.collect())
        want = want or got
        assert got == want == [(i, "response" if i < 7 else "revisit", None if i < 7 else i % 7) for i in range(200)]


def test_archives_of_an_empty_table(spark):
    staging = Staging(spark, "test")
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), staging)
    assert index.count() == 0 and warc.read_records(index, staging.path("archives")).count() == 0


# --- 3 SimHash

def brute_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    for text in (None, "", " \t\n", "One", "One two", "One two three", "É\u00a0b c D\x0bE", "a b " * 50, words(random.Random(1), 40)):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a in values:
        for b in values:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("direct", [1, 24])
def test_links_of_fingerprints(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng, values = random.Random(direct), set()
    for _ in range(12):
        chain = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            values.add(chain)
            for _ in range(rng.randrange(1, 4)):
                chain ^= 1 << rng.randrange(64)
    values = [v - 2 ** 64 if v >= 2 ** 63 else v for v in values]
    ids = list(range(len(values)))
    rows = spark.createDataFrame([(i, v) for i, v in zip(ids, values)] + [(None, values[0]), (0, values[0])], "id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.linked(rows, Staging(spark, "test")).collect()}
    roots = brute_components(values)
    first = {}
    for i, v in zip(ids, values):
        first.setdefault(roots[v], i)
    assert got == {v: first[roots[v]] for v in values}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = components(frame, Staging(spark, "test")).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [61, 80]
    assert components(frame.limit(0), Staging(spark, "test")).count() == 0


def test_one_of_each_keeps_clean_documents(docs):
    near = words(random.Random(5), 300, 10_000)
    texts = [near, near + " end", "other text here now", None, "", "ünique words in a row"]
    kept = simhash.one_of_each(docs(*texts, ids=[4, 2, 9, 1, None, None]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    joined = brute_fingerprint(near) ^ brute_fingerprint(near + " end")
    assert len(left) == (4 if bin(joined).count("1") <= 2 else 5)
    assert (1, None) in left and (None, texts[5]) in left and (9, texts[2]) in left
    assert simhash.one_of_each(docs()).count() == 0


# --- 4 token files

@pytest.mark.parametrize("block", [6, 10, 1 << 20])
def test_token_counts(spark, tmp_path, block):
    rng, want = random.Random(block), set()
    for f in range(4):
        ids, start, number, size = [], 0, 0, 0
        for _ in range(60 if f else 0):
            if rng.random() < 0.2:
                want.add((f, number, start, size, True))
                ids.append(7)
                number, start, size = number + 1, len(ids), 0
            else:
                ids.append(rng.randrange(8, 20))
                size += 1
        if size:
            want.add((f, number, start, size, False))
        np.array(ids, "<u2").tofile(tmp_path / f"{f}.bin")
    files = token_files.list_files(spark, f"file://{tmp_path}")
    got = token_files.count_tokens(files, Staging(spark, "test"), separator=7, block=block).collect()
    assert {(int(r["file"][-5]), r["number"], r["start"], r["n_tokens"], r["closed"]) for r in got} == want and len(got) == len(want)


# --- 5 URLs

def test_hosts_paths_and_listed_rules(spark):
    cases = {None: ("", "", None), "": ("", "", None), "mailto:x": ("", "", None), "http://A.B.ORG": ("a.b.org", "", None),
             "http://Org/x://y?z": ("org", "/x://y", "allow"), "http://example.org/es/1#a?b": ("example.org", "/es/1", "block"),
             "s://m.example.org/en/12": ("m.example.org", "/en/12", "block"), "s://x.com/de/": ("x.com", "/de/", "block"),
             "s://xcom/de/": ("xcom", "/de/", None), "s://notexample.org/es/": ("notexample.org", "/es/", "allow"),
             "s://a.com?x=/de/": ("a.com", "", None), "s://Ä.com/fr/é": ("Ä.com", "/fr/é", "allow")}
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, verdict int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["id"]: r for r in url_rules.judge(pages, none).collect()}
    for i, (url, (host, path, listed)) in enumerate(cases.items()):
        assert (got[i]["host"], got[i]["path"], got[i]["verdict"]) == (host, path, listed or "allow"), url
        assert (got[i]["rule"] is not None) == (listed is not None)
    assert url_rules.judge(pages.limit(0), none).count() == 0


# --- 6 secrets

BASE = {"assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}


def test_secret_spans_equal_full_scans(docs):
    rng = random.Random(4)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "api_key", "apikey", "'", '"', " ", ":", "=", "= ", "abc", "s3cr3t/+x", "AKIA", "AKIA" + "Q" * 16,
            "deadbeef" * 3, "0123456789abcdef" * 2, "é", "\n", "x", "😀", "https://u:p@h", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    texts = [None, "", "ab"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["y" * 3_000_000 + "token=abcdefgh"]
    rows = secret_index.scan(docs(*texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, want = texts[r["row"]["doc_id"]] or "", []
        for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
            want += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
        for k, rule in enumerate(secret_index.MORE):
            want += [(m.start(), 3 + k, m.end(), rule.kind) for m in re.finditer(rule.pattern, text, rule.flags)]
        assert [(s["start"], s["end"], s["kind"]) for s in r["secrets"]] == [(a, b, kind) for a, _, b, kind in sorted(want)]


def test_trigram_queries():
    query = secret_index.trigram_query
    assert query(secret_index.BASE[2]) is None and query(secret_index.Rule("k", "ab|cde")) is None
    assert query(secret_index.Rule("k", "(abc|DEF)[xy]z")) == ("or", (("and", (b"abc", b"bcx", b"cxz")), ("and", (b"abc", b"bcy", b"cyz")),
                                                                    ("and", (b"def", b"efx", b"fxz")), ("and", (b"def", b"efy", b"fyz"))))
    assert query(secret_index.Rule("k", "(abcd)+.?efg*")) == ("and", (b"abc", b"bcd"))


# --- 7 exact deduplication

def test_exact_deduplication(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 8)
    texts = ["hot"] * 40 + ["a", "a", "b", None, "", "A", "x" * 2_000_000, "x" * 2_000_000]
    ids = [*range(38), None, 37, 50, 51, 52, 60, 61, 62, 70, None]
    rows = exact_dedup.annotate(docs(*texts, ids=ids)).collect()
    assert len(rows) == len(texts)
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(sha(t or ""), []).append(i)
    for digest, members in groups.items():
        mine = [r for r in rows if r["digest"] == digest]
        best = max((i for i in members if i is not None), default=None)
        assert sorted(map(str, members)) == sorted(str(r["id"]) for r in mine)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(members))}
        assert [r["id"] for r in mine if r["kept"]] == [best]
    frame = docs(*texts, ids=ids).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    kept = exact_dedup.deduplicate(frame)
    assert kept.columns == frame.columns and kept.count() == len(groups)
    assert exact_dedup.annotate(docs()).count() == 0 and exact_dedup.deduplicate(docs()).count() == 0


# --- 8 BPE

@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64
    import tiktoken
    import public_tokenizers as public
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_tiktoken_and_round_trips(docs, tiktoken_encoding):
    rng = random.Random(6)
    pool = "ab cde'sT  \n\t\x0b\x1c\x85\xa0éßñ123½²Ⅳ_-!?.,<>日本語中文한국어😀👍🏽\u200b\u3000ʰ\u0301אבעربहำ"
    texts = [None, "", "<|endoftext|>", "don't WE'LL", "a" * 100_000, " " * 5000 + "x", "x\n\n\n y"] + [
        "".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    coded = bpe.decode(bpe.encode(docs(*texts), offsets=True)).collect()
    assert len(coded) == len(texts)
    for r in coded:
        text = texts[r["row"]["doc_id"]] or ""
        assert r["ids"] == tiktoken_encoding.encode_ordinary(text)
        assert r["decoded"] == text and bytes(r["decoded_bytes"]) == text.encode()
        covered = "".join(text[a:b] for a, b in zip(r["starts"], r["ends"]) if b - a)
        assert set(text) == set(covered) and all(0 <= a < b <= len(text) for a, b in zip(r["starts"], r["ends"]))


def test_decoding_of_split_characters_and_unknown_ids(spark, tiktoken_encoding):
    ids = tiktoken_encoding.encode_ordinary("😀")
    frame = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [60000, None, 64])], "id long, ids array<int>")
    got = {r["id"]: r["decoded"] for r in bpe.decode(frame).collect()}
    assert got[1] == "😀" and got[2] == "\ufffd" and got[3] == "" and got[4] == tiktoken_encoding.decode([64])


# --- 9 quality

def test_quality_learns_and_scores_every_text(spark, docs):
    rng = random.Random(7)
    texts = [words(rng, 60) if i % 3 else words(rng, 60).replace(" ", "!!! ") for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 1) for i in range(200)] + [(900, 1, 1), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, text int")
    frame = docs(*texts)
    scores = {r["row"]["doc_id"]: r["score"] for r in quality.predict(frame, quality.fit(frame, labels)).collect()}
    assert len(scores) == 302 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300))
    one = quality.fit(frame, labels.filter("quality = 1"))
    assert all(r["score"] > 0.99 for r in quality.predict(frame, one).collect())
    none = quality.fit(frame, labels.limit(0))
    assert {r["score"] for r in quality.predict(frame, none).collect()} == {0.5}


def test_coordinate_descent_separates():
    rows = [(np.array([i % 2, quality.BUCKETS]), np.ones(2)) for i in range(40)]
    sign = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    weights = quality.coordinate_descent(rows, sign)
    assert all(sign[i] * (weights[p] @ v) > 0.9 for i, (p, v) in enumerate(rows))


# --- 10 language

def brute_word(model, word, k):
    """Log of the sum over all segmentations, with whole words and pieces of any length."""
    chance = {p: model.table[i, k] for i, p in enumerate(model.pieces)}
    longest, sums, log = max(map(len, chance)), [1.0], 0.0
    for end in range(1, len(word) + 1):
        now = sum(sums[-n] * chance.get(word[end - n:end], 1e-7 if n == 1 else 0.0) for n in range(1, min(longest, len(sums)) + 1))
        sums = [x / now for x in sums] + [1.0]
        log += np.log(now)
        sums = sums[-longest:]
    return log


def test_language_scores_equal_all_segmentations(spark, docs):
    english, german = "the house and the garden are by the river " * 4, "das haus und der garten sind an dem fluss " * 4
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", "s", 0) for i in range(8)] + [(50, None, "en", "s", 0), (51, "x", None, "s", 0)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["de", "en"]
    tests = ["The garden!", "der Fluss", None, "", "123 ?!", "über" * 30, "日本語", "x" * 100_000, "the der", "unfortunately transportation", "constitutional" * 9]
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(*tests), model).collect()}
    assert [got[i][0] for i in (0, 1)] == ["en", "de"] and [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    for i, text in enumerate(tests):
        found = re.findall("[^\x00-\x60\x7b-\x7f]+", (text or "").lower())
        if found:
            log = np.array([sum(brute_word(model, "▁" + w, k) for w in found) for k in (0, 1)]) + np.log(model.priors)
            chance = np.exp(log - log.max())
            chance /= chance.sum()
            assert got[i][0] == model.languages[int(log.argmax())] and got[i][1] == pytest.approx(chance.max(), rel=1e-6)


def test_language_without_training(spark, docs):
    model = langid.fit(docs())
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs("some text", None), model).collect()} == {("und", 0.0)}


def test_cuts_and_ids_are_alike_with_and_without_characters_beyond_the_plane():
    """Texts without them are cut by smaller classes, and many cuts are encoded as one sequence; ids must not change by either."""
    rng = random.Random(8)
    bits = ["word", "Ünï", "中文", "２３", "12", " ", "  ", "\n", "\x1c", " ", "'ll", "!?", "_", "　", "é"]
    beyond = ["😀", "𝒳", "𐒠", "\U0001d7d8"]
    codec = bpe.codec(*bpe.public_ranks())
    assert codec.cut_any != codec.cut_plane
    texts = ["", *("".join(rng.choice(bits + (beyond if i % 2 else [])) for _ in range(40)) for i in range(200))]
    assert [codec.cut(x) for x in texts] == [codec.cut_any(x) for x in texts]
    cuts = {c for x in texts for c in codec.cut(x)}
    alone = {c: v for c in cuts for v in codec._fill({c}).values()}
    assert codec._fill(cuts) == alone and codec._fill(set()) == {}
    assert [codec.decode(x).decode() for x in codec.encode(texts)] == texts
