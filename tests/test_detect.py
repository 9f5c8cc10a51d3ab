import base64
import hashlib
import random
import re
import time

import pytest

from keysift.operators.detect import BLOCK, RULES_PER_MASK, candidate_masks, candidate_rules, rule_matches
from keysift.operators.findings import dedup
from keysift.plans import scan_composite, scan_table
from keysift.rules import builtin_pack, pack_from_dict, translate

GHP = "ghp_" + hashlib.sha256(b"a token of our own").hexdigest()[:36].translate(str.maketrans("bdf", "BDF"))
WORD = hashlib.sha256(b"another").hexdigest().translate(str.maketrans("0123456789", "ghijkmnpqr"))
MIXED = base64.b64encode(hashlib.sha256(b"mail").digest(), b"xy").decode().rstrip("=")
MAIL = f"SG.{MIXED[:22]}.{MIXED}"
HOOK = f"https://hooks.slack.com/services/T{'4K7Q2M9X'}/B{'8W3Z6R1VCD'}/{WORD[:24]}"
# (rule, line, column, match) of what each text holds
CASES = {
    "src/main.go": (f'token := "{GHP}"\nstore = "lake"', {("github-pat", 1, 11, GHP)}),
    "notes.txt": (f"one\ntwo {GHP}", {("github-pat", 2, 5, GHP)}),
    "calm.go": ('secret = "example_of_a_value"\npassword = "placeholder-text"', set()),
    "mail.env": (f"\n\nMAIL_KEY={MAIL}", {("sendgrid-api-key", 3, 10, MAIL)}),
    "hook.env": (f"HOOK={HOOK}", {("slack-webhook", 1, 6, HOOK)}),
    "sql.env": ("LAKE=mysql://reader:tr0ub4dor@lake.internal.host:3306/fish",
                {("database-connection", 1, 6, "mysql://reader:tr0ub4dor@"), ("database-connection-mysql", 1, 6, "mysql://reader:tr0ub4dor@lake.internal.host:3306/fish")}),
    "vendor/y.go": (GHP, set()),
    "door.pem": ("-----BEGIN RSA PRIVATE KEY-----\nxyz", set()),
    "bare": (f"SK{hashlib.md5(b'bare').hexdigest()} twilio", set()),
}


def scored(strings):
    """Entropies by the SQL twin."""
    import duckdb

    from checks.twins import entropy
    rows = duckdb.execute(f"SELECT s, {entropy('s')} FROM (SELECT unnest(?) AS s)", [list(strings)]).fetchall()
    return dict(rows)


def test_fixture_findings(texts):
    found = scan_table(texts(*[(p, t) for p, (t, _) in CASES.items()])).collect()
    want = scored({m for _, hits in CASES.values() for *_, m in hits})
    for path, (_, hits) in CASES.items():
        assert {(r.rule_id, r.line, r.column, r.match) for r in found if r.file == path} == hits, path
    assert all(abs(r.entropy - want[r.match]) < 1e-6 for r in found)


def test_context_of_a_match(texts):
    text = f"a\nb\n{GHP}\nd\ne\nf"
    assert scan_table(texts(("f", text))).first().context == text.split("\n")[:5]
    assert scan_table(texts(("f", GHP)), context=None).first().context == []


def test_places_of_very_many_matches(texts):
    """More matches than one block of the running walk holds, some across lines, with wide characters."""
    random.seed(7)
    pack = pack_from_dict({"rules": [{"id": "r", "regex": r"k[\s]*=[\s]*[0-9]+\n?", "keywords": ["k"], "entropy": -9.0}]})
    pieces = []
    for _ in range(3 * BLOCK + 5):
        pieces.append("".join(random.choice(["a", "é", "\U0001f600", "\n", " ", "k", "\r\n"]) for _ in range(random.randrange(9))))
        pieces.append("k" + random.choice(["", "\n", " \n\n"]) + "=" + str(random.randrange(10 ** 6)) + random.choice(["", "\n"]))
    text = "".join(pieces)
    rows = rule_matches(texts(("f", text), ("g", "nothing")), pack, "content").orderBy("start").collect()
    want = list(re.finditer(r"k[ \t\n\f\r]*=[ \t\n\f\r]*[0-9]+\n?", text))
    assert len(rows) == len(want) > 3 * BLOCK
    lines = text.split("\n")
    for row, match in zip(rows, want):
        before = text[:match.start()]
        assert (row.match, row.start, row.end) == (match.group(), match.start(), match.end())
        assert row.line == before.count("\n") + 1
        assert row.column == len(before.rpartition("\n")[2]) + 1
        last = text[:match.end() - 1].count("\n") + 1
        assert row.context == lines[max(row.line - 3, 0):last + 2]


def test_more_rules_than_one_mask_holds(texts):
    count = 2 * RULES_PER_MASK + 3
    pack = pack_from_dict({"rules": [{"id": f"r{i}", "regex": f"k{i}x[0-9]+", "keywords": [f"K{i}X"], "entropy": -9.0}
                                     for i in range(count)]})
    found = scan_table(texts(*[(str(i), f"k{i}x{i}") for i in range(count)]), pack).collect()
    assert {(r.file, r.rule_id) for r in found} == {(str(i), f"r{i}") for i in range(count)}


def test_candidates_need_a_keyword_anywhere_in_any_case(texts):
    names = [r.id for r in builtin_pack().rules]
    frame = texts(("a", "AWS_Secret and GHP_"), ("b", "nothing"), ("c", "x" * 5000 + " \u212aey"))
    rows = candidate_rules(frame, builtin_pack(), "content").collect()
    assert {(r.path, names[r.rule_idx]) for r in rows} == {
        ("a", "aws-secret-key"), ("a", "generic-secret"), ("a", "github-pat"), ("c", "generic-api-key")}


def test_keyless_rules(texts):
    text = "SK0123456789aBcdef0123456789abcdef".replace("aB", "ab")
    frame = texts(("a", f"id {text}"))
    rules = [{"id": "twilio", "regex": "SK[a-f0-9]{32}", "entropy": 3.0}]
    assert scan_table(frame, pack_from_dict({"rules": rules})).count() == 1
    mixed = pack_from_dict({"rules": rules + [{"id": "o", "regex": "zzz", "keywords": ["zzz"]}]})
    assert scan_table(frame, mixed).count() == 0
    assert scan_table(frame, mixed, keyless="always").count() == 1


def test_empty_pack_finds_nothing(texts):
    assert scan_table(texts(("a", GHP)), pack_from_dict({"rules": []})).count() == 0


def test_odd_pattern_and_column_names(texts, spark):
    pack = pack_from_dict({"rules": [{"id": "q", "regex": r"""tok['"\\]+[%_]\w+""", "keywords": ["tok'"], "entropy": -9.0}]})
    frame = texts(("a", r"""x tok'"\%abc """)).withColumnRenamed("content", "the text")
    assert scan_table(frame, pack, text="the text").first().match == r"""tok'"\%abc"""


@pytest.mark.parametrize("lines", [0, 1, 4])
def test_companions_equal_brute_force(spark, lines):
    """Repeated paths too: texts with the same path never lend each other a companion."""
    random.seed(lines)
    pack = pack_from_dict({"rules": [{"id": "g", "regex": "g[0-9]+", "keywords": ["g"], "entropy": -9.0, "required": [
        {"id": "u", "regex": "u=[a-z]", "withinLines": lines}, {"id": "w", "regex": "w!", "withinLines": lines + 1}]}]})
    rows = [(random.choice(["p", "q", None]), [random.choice(["g1", "u=x", "w!", "", "", "g2 u=y"]) for _ in range(30)]) for _ in range(40)]
    frame = spark.createDataFrame([(p, "\n".join(t)) for p, t in rows], "path string, content string")
    got = sorted((r.file, r.line, r.match) for r in scan_composite(frame, pack).collect())

    def near(text, i, part, distance):
        return any(part in text[j] for j in range(max(0, i - distance), min(len(text), i + distance + 1)))
    want = [(p or "", i + 1, line[:2]) for p, t in rows for i, line in enumerate(t) if line.startswith("g")
            and near(t, i, "u=", lines) and near(t, i, "w!", lines + 1)]
    assert got == sorted(want) and want


def test_composite_rule(texts):
    pack = pack_from_dict({"rules": [{"id": "g", "regex": "ghp_[0-9a-zA-Z]{36}", "keywords": ["ghp_"], "required": [
        {"id": "user", "regex": "user=[a-z]+", "withinLines": 2}]}]})
    near, far = f"user=x\n\n{GHP}", f"user=x\n\n\n{GHP}"
    assert [r.file for r in scan_composite(texts(("near", near), ("far", far)), pack).collect()] == ["near"]


def test_offsets_reproduce_the_match(texts):
    rows = rule_matches(texts(*[(p, t) for p, (t, _) in CASES.items()]), builtin_pack(), "content").collect()
    assert rows and all(CASES[r.path][0][r.start:r.end] == r.match for r in rows)


def test_missing_values_and_empty_keywords(spark):
    frame = spark.createDataFrame([(None, GHP), ("a", None), (None, f"x{GHP}")], "path string, content string")
    assert sorted((r.file, r.column) for r in dedup(scan_table(frame)).collect()) == [("", 1), ("", 2)]
    pack = pack_from_dict({"rules": [{"id": "e", "regex": "ghp_", "keywords": [""]},
                                     {"id": "k", "regex": "ghp_", "keywords": ["ghp", ""], "entropy": -1.0}]})
    assert {r.rule_id for r in scan_table(frame, pack).collect()} == {"k"}


def test_starts_without_an_end_stay_cheap(texts):
    """Many starts and no end must not be read to the end of the text each."""
    lines = [f"redis://10.0.0.{i % 250}:6379/{i}" for i in range(60_000)]
    log, closed = "\n".join(lines), "\n".join(lines) + " me@x and redis://h:1"
    start = time.time()
    found = rule_matches(texts(("log", log), ("closed", closed)), builtin_pack(), "content", context=None).collect()
    assert time.time() - start < 60
    names = [r.id for r in builtin_pack().rules]
    assert [(r.path, names[r.rule_idx], r.start, r.match[-3:]) for r in found] == [
        ("closed", "database-connection", 0, "me@")]


def test_endings():
    want = {"a@": "@", "(a@|b@)": "@", "a@|b": "", "a@+": "", "a@$": "", "(?i)ab": "", "(?i)a@": "@", "[^b]+(x@)?": "",
            r"a\.": "", "a(?:b@)": "@"}
    assert {p: translate(p).ending for p in want} == want
    assert {r.rule.id for r in builtin_pack().compiled() if r.ending} == {
        "azure-storage-key", "generic-private-key", "database-connection"}


def test_the_gate_stays_small_and_equals_a_plain_search(spark, capsys):
    """No generated method is too large for the compiler, with two hundred rules as with one; masks are those of a plain search."""
    random.seed(3)
    words = ["".join(random.choices("abkey_-:/wd", k=random.randrange(2, 7))) for _ in range(400)]
    for n in (1, 61, 200):
        pack = pack_from_dict({"rules": [{"id": f"r{i}", "regex": "x[0-9]+", "keywords": random.sample(words, random.randrange(0, 4))} for i in range(n)]})
        rules = pack.compiled("always")
        texts = [(i, " ".join(random.choices(words, k=random.randrange(0, 12))).upper()) for i in range(60)] + [(60, None), (61, "")]
        frame = spark.createDataFrame(texts, "i int, content string")
        masks = candidate_masks(frame, "content", rules)
        got = {r["i"]: [k for k in range(len(rules)) if r["masks"][k // RULES_PER_MASK] >> k % RULES_PER_MASK & 1] for r in masks.collect()}
        want = {i: [k for k, r in enumerate(rules) if not r.keywords or any(w in t.lower() for w in r.keywords)] if t is not None
                else [k for k, r in enumerate(rules) if not r.keywords] for i, t in texts}
        assert got == {i: hits for i, hits in want.items() if hits}
        masks.explain("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert all(x < 8000 for x in sizes)
