"""Mined URL rules against brute force over every combination of tokens, the tokens made independently."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keysift.llm import url_rules

LEAST, GAIN = 20, 0.25  # as documented


def tokens(url):
    if url is None or "://" not in url:
        return frozenset()
    rest = url.split("://", 1)[1]
    rest = rest.split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    labels = host.lower().split(".")
    out = {"name:" + ".".join(labels[-2:])}
    out |= {"host:" + w for label in labels[:-2] for w in label.replace("_", "-").split("-") if w}
    for part in path.lower().split("/"):
        stem, dot, end = part.partition(".")
        if part and not (stem.isdigit() and (not dot or end.isalpha())):
            out.add("path:" + part)
    ending = path.lower().rpartition(".")[2] if "." in path else ""
    if 2 <= len(ending) <= 5 and ending.isalpha():
        out.add("end:" + ending)
    return frozenset(out | {"query:" + k.partition("=")[0] for k in query.split("&") if k})


def combinations(found):
    return (frozenset(c) for n in range(1, len(found) + 1) for c in itertools.combinations(sorted(found), n))


def brute(urls, marks):
    """id -> (verdict, gain) over all combinations."""
    learn = [(tokens(urls[i]), bad) for i, bad in marks.items() if i in urls and tokens(urls[i])]
    total = Counter(bad for _, bad in learn)
    seen = Counter((c, bad) for found, bad in learn for c in combinations(found))
    rules = {}
    for (combo, bad), n in seen.items():
        share = total[bad] / len(learn)
        if n >= LEAST and share < 1:
            gain = (n / (seen[combo, True] + seen[combo, False]) - share) / (1 - share)
            if gain >= GAIN:
                rules[combo, bad] = gain
    out = {}
    for i, url in urls.items():
        hits = [(round(g, 9), bad) for (combo, bad), g in rules.items() if combo <= tokens(url)]
        out[i] = ("block" if max(hits)[1] else "allow", max(hits)[0]) if hits else ("allow", None)
    return out


def judged(spark, urls, marks):
    pages = spark.createDataFrame([(i, u, "t", 1) for i, u in urls.items()], "page_id long, url string, token string, gain int").repartition(3)
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0.5) for i, bad in marks.items()], "doc_id long, quality int, gain double")
    return {r["id"]: r for r in url_rules.judge(pages, labels, rules=()).collect()}


def check(spark, urls, marks):
    got, want = judged(spark, urls, marks), brute(urls, marks)
    assert got.keys() == want.keys()
    for i, (verdict, _) in want.items():
        assert got[i]["verdict"] == verdict, (urls[i], got[i])
    return got, want


def made(seed, n=400):
    rng = random.Random(seed)
    urls, marks = {}, {}
    for i in range(n):
        host, part = rng.choice(["win-big.net", "a.news.net", "shop.win.net", "m.calm_down.net"]), rng.choice(["Go", "art", "x.html"])
        urls[i] = f"http://{host}/{part}/{i}" + rng.choice(["", "?page=2&ref=x", "/", "#top"])
        marks[i] = rng.random() < (0.95 if host == "win-big.net" and part == "Go" else 0.02 if "shop" in host else 0.3)
    return urls | {n: None, n + 1: urls[0], n + 2: "no host", n + 3: "http://"}, {i: b for i, b in marks.items() if i < 300} | {9999: True}


@pytest.mark.parametrize("seed", range(2))
def test_rules_equal_brute_force(spark, seed):
    got, want = check(spark, *made(seed))
    assert {"block", "allow"} == {v for v, _ in want.values()} and any(r["mined"] and r["verdict"] == "allow" for r in got.values())
    for i, (_, gain) in want.items():
        assert (got[i]["mined"] is None) == (gain is None)


def test_index_inside_the_row_and_joined_are_alike(spark, monkeypatch):
    urls, marks = made(4)
    want = {i: tuple(r) for i, r in judged(spark, urls, marks).items()}
    monkeypatch.setattr(url_rules, "INSIDE", 0)
    assert {i: tuple(r) for i, r in judged(spark, urls, marks).items()} == want


@pytest.mark.parametrize("shape", ["http://h.net/a/b/c/d/e/{}/{}", "http://h.net/q/{1}?a=1&b=2&c&d&e&{0}=3"])
def test_the_sixth_segment_or_key_tells(spark, shape):
    urls = {i: shape.format("casino" if i % 2 else "garden", i) for i in range(400)}
    got, want = check(spark, urls, {i: bool(i % 2) for i in range(200)})
    assert sum(v == "block" for v, _ in want.values()) == 200
    assert any("casino" in r["mined"] for r in got.values() if r["verdict"] == "block")


@pytest.mark.parametrize("others", [2_000, 6_000])
def test_support_is_a_number_of_urls_at_every_size(spark, others):
    bad = {i: f"http://x.org/spam/{i}" for i in range(25)}
    few = {100 + i: f"http://x.org/eggs/{i}" for i in range(LEAST - 1)}
    rest = {1000 + i: f"http://x.org/fine/{i}" for i in range(others)}
    urls = bad | few | rest
    got = judged(spark, urls, {i: i < 1000 for i in urls})
    assert {i for i, r in got.items() if r["verdict"] == "block"} == set(bad)


def test_rules_may_be_long(spark):
    """Only all five tokens together tell; each four of them are as often good."""
    urls, marks, i = {}, {}, 0
    names = ["aa", "bb", "cc", "dd", "ee"]
    for left_out in [None, *names]:
        for _ in range(30):
            urls[i] = "http://h.net/" + "/".join(n if n != left_out else "zz" for n in names)
            marks[i], i = left_out is None, i + 1
    got, _ = check(spark, urls, marks)
    assert {len(r["mined"].split()) for r in got.values() if r["verdict"] == "block"} == {5}


def test_tokens_that_always_meet_are_one_item(spark):
    shape = "/".join(f"part{k}" for k in range(40))
    urls = {i: f"http://h.net/{shape if i % 2 else 'other'}/{i}" for i in range(100)}
    got = judged(spark, urls, {i: bool(i % 2) for i in range(100)})
    assert all(r["verdict"] == ("block" if i % 2 else "allow") for i, r in got.items())


def test_labels_of_one_kind_and_empty_tables(spark):
    urls = {i: f"http://h.net/a/{i}" for i in range(60)}
    for marks in ({}, {i: True for i in urls}, {i: False for i in urls}):
        assert all(r["verdict"] == "allow" and r["mined"] is None for r in judged(spark, urls, marks).values())
    assert judged(spark, {}, {1: True, 2: False}) == {}


def test_ids_with_several_labels_are_bad_if_any_is(spark):
    pages = spark.createDataFrame([(i, f"http://h.net/{'bad' if i < 30 else 'ok'}/{i}") for i in range(90)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(90)] + [(i, 0) for i in range(30)] + [(5, None)], "doc_id long, quality int")
    got = url_rules.judge(pages, labels, rules=()).filter(F.col("verdict") == "block").count()
    assert got == 30


def test_learnt_query_equals_brute_force(spark, tmp_path):
    from keysift.llm.catalog import QUERIES
    rng = random.Random(6)
    urls = {i: f"http://{rng.choice(['m.', 'www.', ''])}{rng.choice('ab')}.org/{rng.choice(['es', 'en'])}/{i}{rng.choice(['', '.html', '?x=1'])}" for i in range(400)}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    marks = {i: ("/es/" in u and "?" in u) or ("://m." in u and u.endswith(".html")) for i, u in urls.items()}
    got = {r["page_id"]: r["verdict"] for r in QUERIES["url_rules_learnt"](spark, str(tmp_path)).collect()}
    assert got == {i: v for i, (v, _) in brute(urls, marks).items()}
    assert {i for i, bad in marks.items() if bad} <= {i for i, v in got.items() if v == "block"} < got.keys()


def test_listed_rules_judge_as_the_contract_says(spark):
    contract = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    urls = list(contract) + [f"sub.{rule}" for rule in contract]
    pages = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, none).collect()}
    assert got == {i: (u.removeprefix("sub."), contract[u.removeprefix("sub.")]) for i, u in enumerate(urls)}
