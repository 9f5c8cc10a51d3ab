import duckdb
import pytest
from pyspark.sql import functions as F

from keysift.rules import (PatternError, builtin_pack, load_pack, pack_from_dict, rejected_rules_frame,
                           rules_frame, translate)


def test_builtin_pack():
    pack = builtin_pack()
    assert len(pack.rules) == 53 and not pack.rejected
    assert sum(not r.keywords for r in pack.rules) == 5
    assert len(pack.compiled()) == 48 and len(pack.compiled("always")) == 53
    assert sorted(r.severity for r in pack.rules).count("critical") == 15
    assert pack.stopwords == ["example", "placeholder"]


def test_defaults_and_file(tmp_path):
    file = tmp_path / "rules.toml"
    file.write_text('[[allowlist]]\npaths = ["vendor/"]\n[[rules]]\nid = "t"\nregex = "test_[a-z]+"\n'
                    'keywords = ["test_"]\n[extend]\nuseDefault = true\n')
    pack = load_pack(file)
    assert [(r.id, r.severity, r.entropy) for r in pack.rules] == [("t", "medium", 3.0)]
    assert pack.allowlist[0].paths == ("vendor/",)
    assert len(load_pack(file, apply_extend=True).rules) == 54
    with pytest.raises(Exception):
        file.write_text("not toml [")
        load_pack(file)
    with pytest.raises(OSError):
        load_pack(tmp_path / "missing.toml")


def test_frames_and_rejects(spark):
    pack = pack_from_dict({"rules": [{"id": "ok", "regex": "a+"}, {"id": "look", "regex": "(?=a)"},
                                     {"id": "open", "regex": "(a"}, {"id": "empty", "regex": "a*"}, {"id": "none"}]})
    assert rules_frame(spark, pack).count() == 5
    assert {r.id for r in rejected_rules_frame(spark, pack).collect()} == {"look", "open", "empty", "none"}
    assert [r.rule.id for r in pack.compiled()] == ["ok"]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", "a**", "(a", "a)", "[z-a]", r"\1", "a{1001}", "x++", "+a",
                                     "[[:nope:]]", r"\p{Nope}", r"\Z", "[a"])
def test_refused_patterns(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


TEXTS = ["éAKIA7 AKIA8", "a\x0bb c", "end\n", "end", "x\ry\nz", "\u212aey ſecret KEY", "a[b&&c]", "AbC-_9", "tab\tx",
         "line1\nline2\n", "\u2028x", "x{,5}y", "ba.b a.bb", "naïve über", "", "aXbX", "foo_bar-baz", "0123 ab\nCD"]
PATTERNS = [r"\bAKIA", r"\BKIA", r"a\sb", r"[\s]", r"\S+", r"end$", r"(?m)^line\d$", r"x.y", r"(?s)x.y", r"(?i)key|secret",
            r"[a[&]+", r"[A-Za-z0-9-_]+", r"[^\W]+", r"[\D]+", r"(?i)[k]ey", r"\Qa.b\E+", r"x{,5}", r"[[:alpha:]]+",
            r"[^[:space:]]+", r"(?P<n_1>a|b)(X)", r"(?U)a.*X", r"(?i:ab)c", r"\x61|\x{63}", r"\pL+", r"\p{Lu}", r"\P{Ll}",
            r"\w+?-", r"(?i)\w+", r"^\d+", r"a|b|", r"[]a]+", r"\.|\[", r"(?i)(?-i)KEY", r"\d{2,3}", r"[^\n]+$"]


def test_translation_matches_like_re2(spark):
    """Spark with the translated pattern and DuckDB with the original find the same text."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").coalesce(1)
    found = frame.select("i", *[F.regexp_extract_all("t", F.lit(translate(p).text), F.lit(0)).alias(f"p{k}")
                                for k, p in enumerate(PATTERNS)]).orderBy("i").collect()
    db = duckdb.connect()
    for row, text in zip(found, TEXTS):
        for k, pattern in enumerate(PATTERNS):
            expected = db.execute("SELECT regexp_extract_all(?, ?)", [text, pattern]).fetchall()[0][0]
            assert [m for m in row[f"p{k}"] if m] == [m for m in expected if m], (pattern, text)
