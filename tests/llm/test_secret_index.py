"""Rules of any flags find in the index what their expressions find in every text."""

import re

import pytest

from keysift.llm import secret_index
from keysift.llm.secret_index import Rule, scan

TEXTS = ["ÉTÉ chaud", "été", "ſecret=1", "SECRET", "seCret", "Key=abc", "key=abc", "KEY", "fİnd", "fınd", "FIND", "find", "straße STRASSE", "σίγμας ΣΊΓΜΑΣ",
         "xkey", "abcKEYdef", "", None, "x" * 200_000 + " ſecret key", "ﬁne line", "µm μm", "pass-ſ-word", "AKKA", "aKKa"]
PATTERNS = [("été", re.I), ("secret", re.I), ("key", re.I), ("(?i)find", 0), ("(?i:key)=", 0), ("x(?i:ke)y", 0), ("k", re.I), ("(?:ab)?ckey", re.I), ("[ks]ey", re.I),
            ("(?:key|été)", re.I), ("straße", re.I), ("σίγμας", re.I), ("µm", re.I), ("(?i)a(?-i:kk)a", 0), ("(?i)akka", 0), ("(?a:(?i:key))", 0), ("key", re.I | re.A),
            ("pass.(?i:s).word", 0), ("(?i:se)cret", re.A), ("se{1,2}cret", re.I), ("été", 0), ("(?i)ﬁ", 0)]


@pytest.mark.parametrize("pattern, flags", PATTERNS)
def test_queries_miss_nothing(pattern, flags):
    import pyarrow as pa
    index = secret_index.Index((Rule("x", pattern, flags=flags),))
    got = index.search(pa.array(TEXTS, pa.string()))
    want = [[{"kind": "x", "start": m.start(), "end": m.end()} for m in re.finditer(pattern, t or "", flags)] for t in TEXTS]
    assert got == want


def test_rules_that_fold_ascii_only_still_ask_for_trigrams():
    for rule in secret_index.BASE[:2]:
        assert secret_index.trigram_query(rule) is not secret_index.ALL
    assert secret_index.trigram_query(Rule("x", "apple", flags=re.I)) is not secret_index.ALL


def test_empty_tables_and_clashing_names(spark):
    schema = "row int, secrets string, text string, found int"
    assert scan(spark.createDataFrame([], schema)).count() == 0
    got = scan(spark.createDataFrame([(1, "s", "token=abcdef12", 2), (1, "s", "token=abcdef12", 2)], schema)).collect()
    assert [(r["row"]["row"], r["row"]["secrets"], r["secrets"][0]["kind"]) for r in got] == [(1, "s", "assign")] * 2
