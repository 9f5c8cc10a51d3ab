import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keysift.operators import allow, baseline, findings as fnd, gates, history, verification as ver
from keysift.plans import files_scanned, scan_files, scan_roots, scan_table
from keysift.rules import builtin_pack, pack_from_dict
from keysift.sources import expand_archives, read_files, skipped_files
from keysift.sources.files import list_files

GHP = "ghp_" + hashlib.sha256(b"a token of our own").hexdigest()[:36].translate(str.maketrans("bdf", "BDF"))


def truth(spark, strings, column):
    frame = spark.createDataFrame([(s,) for s in strings], "s string").coalesce(1)
    return [r[0] for r in frame.select(column(F.col("s"))).collect()]


def test_extensions_and_paths(spark):
    paths = ["test.go", "config.txt", "image.jpg", "a/package-lock.json", "bundle.min.js", "program.exe", "my-yarn.lock",
             "a.d/noext", "X.PNG"]
    assert truth(spark, paths, gates.is_scannable_path) == [True, True, False, False, False, False, False, True, False]
    assert truth(spark, ["a.exe", "b.so", "c.dylib", "d.jpg", "e.o", "f.go", "g.docx"], gates.is_skipped_in_image) \
        == [True, True, True, True, True, False, False]
    assert truth(spark, ["a/.git/x", ".git/x", ".gitignore", "a.git/x"], gates.is_inside_git) == [True, True, False, False]
    allowed = truth(spark, ["vendor/github.com/test/lib.go", "node_modules/express/index.js", "src/main.go"],
                    lambda p: allow.is_allowed_path(p, builtin_pack()))
    assert allowed == [True, True, False]


def test_binary(spark):
    contents = [b"text", b"a\nb\r\t", b"", b"a\0b", b"\x01" * 31 + b"a" * 69, b"\x01" * 30 + b"a" * 70,
                b"a" * 1024 + b"\x01" * 900]
    frame = spark.createDataFrame([(bytearray(c),) for c in contents], "c binary").coalesce(1)
    assert [r[0] for r in frame.select(gates.is_binary(F.col("c"))).collect()] \
        == [False, False, False, True, True, False, False]


def test_inline_allow(spark):
    lines = ["x # keysift:allow", "x // KEYSIFT:allow", "/* keysift:allow */", "<!-- keysift:allow -->",
             "{% comment %}keysift:allow", "{%  comment %}keysift:allow", "{{ /* keysift:allow */ }}", "{{ keysift:allow */ }}",
             "keysift:allow", "x", "/* keysift:allow"]
    assert truth(spark, lines, allow.has_inline_allow) == [True] * 8 + [False] * 3
    assert truth(spark, ["x # mine"], lambda s: allow.has_inline_allow(s, ("mine",))) == [True]


def test_stopwords(spark):
    words = ["example", "EXAMPLE", "an_example", "db.example.com", "notexample", "examples", "myexample example"]
    assert truth(spark, words, lambda s: allow.has_stopword(s, "example")) == [True, True, True, True, False, False, False]


def test_allowed_commits(spark):
    pack = pack_from_dict({"allowlist": [{"commits": ["abc", "def456"]}]})
    frame = spark.createDataFrame([("abc999",), ("def456",), ("def4",), ("xyz",)], "commit string")
    assert sorted(r.commit for r in allow.drop_allowed_commits(frame, pack).collect()) == ["def4", "xyz"]


def finding_rows(spark, rows):
    base = spark.createDataFrame(rows, "fingerprint string, severity string, file string")
    empty = {c: F.lit("") for c in ("rule_id", "description", "match", "account", "message", "commit", "raw")}
    return base.select("*", *[v.alias(c) for c, v in empty.items()], F.lit(1).alias("line"), F.lit(1).alias("column"),
                       F.lit(None).cast("boolean").alias("verified"))


def test_dedup_counts_and_files(spark):
    rows = finding_rows(spark, [("abc", "high", "f1"), ("abc", "high", "f1"), ("def", "critical", "f2"), ("g", "medium", "f1")])
    assert fnd.dedup(rows).count() == 3
    assert {r.severity: r.findings for r in fnd.severity_counts(rows).collect()} == {"high": 2, "critical": 1, "medium": 1}
    assert {r.file: (r.findings, r.high) for r in fnd.file_summary(rows).collect()} == {"f1": (3, 2), "f2": (1, 0)}
    assert fnd.filter_severity(rows, ["HIGH"]).count() == 2 and fnd.filter_severity(rows, []).count() == 4
    assert fnd.report_summary(rows).first().summary == "Found 4 secrets"
    assert fnd.failed_gate(rows).first().failed


@pytest.mark.parametrize("key", ["fingerprint", "stable_key"])
def test_baseline_cases(spark, key):
    name = {"fingerprint": "fingerprint", "stable_key": "file"}[key]  # the stable key follows the file here
    old = finding_rows(spark, [("old1", "medium", "old1"), ("old2", "low", "old2"), ("old2", "low", "old2")])
    new = finding_rows(spark, [("old1", "medium", "old1"), ("new1", "high", "new1"), ("new1", "high", "new1")])
    old = baseline.baseline_rows(old)
    assert sorted(r[name] for r in baseline.new_findings(new, old, key).collect()) == ["new1", "new1"]
    assert [r[name] for r in baseline.existing_findings(new, old, key).collect()] == ["old1"]
    assert [r[name] for r in baseline.resolved_findings(new, old, key).collect()] == ["old2"]
    compared = baseline.compare_with_baseline(new, old, key)
    assert sorted((r[name], r.status) for r in compared.collect()) == [
        ("new1", "new"), ("new1", "new"), ("old1", "existing"), ("old2", "resolved")]
    totals = baseline.baseline_totals(compared).first()
    assert (totals.total, totals.new, totals.existing, totals.resolved) == (4, 2, 1, 1)
    cells = {(r.status, r.severity): r.findings for r in baseline.baseline_statistics(compared).collect()}
    assert cells[(None, None)] == 4 and cells[("resolved", "low")] == 1 and cells[(None, "high")] == 2
    assert baseline.new_findings(new, None).count() == 3
    assert {r.status for r in baseline.compare_with_baseline(new, None).collect()} == {"new"}


def test_a_second_secret_of_a_file_is_new(spark, texts):
    """Both begin with the same bytes; moving down does not make the first one new."""
    old = baseline.baseline_rows(scan_table(texts(("f", 'password="aB3dE5gH7jK9mN1pQ2rS4tU6"'))))
    new = scan_table(texts(("f", '\npassword="aB3dE5gH7jK9mN1pQ2rS4tU6"\npassword="zY8xW6vU4tS2rQ1pO9nM7lK5"')))
    for compared in (baseline.compare_with_baseline(new, old, "stable_key"),):
        assert sorted((r.line, r.status) for r in compared.collect()) == [(2, "existing"), (3, "new")]
    assert [r.line for r in baseline.new_findings(new, old, "stable_key").collect()] == [3]
    assert baseline.resolved_findings(new, old, "stable_key").count() == 0


def test_baseline_files(spark, texts, tmp_path):
    found = scan_table(texts(("a", GHP), ("b", f"x {GHP}")))
    baseline.save_baseline(found, str(tmp_path / "base"))
    stored = baseline.load_baseline(spark, str(tmp_path / "base"))
    assert baseline.new_findings(found, stored).count() == 0 and stored.count() == 2
    doc = tmp_path / "base.json"
    doc.write_text('{"version": "1.0", "generated_at": "2024-01-01T00:00:00Z", "findings": [\n{"rule_id": "r", "fingerprint":'
                   ' "f", "match": "m", "file": "x", "line": 3, "severity": "high"}]}')
    assert [tuple(r) for r in baseline.load_baseline_json(spark, str(doc)).collect()] == [("r", "f", "m", "x", 3, "high")]
    doc.write_text("{broken")
    with pytest.raises(Exception):
        baseline.load_baseline_json(spark, str(doc)).collect()


def test_history_equals_plain_scan(spark):
    """Also with one content in most commits, which the salt spreads, and with a given digest."""
    random.seed(1)
    contents = [f"line\nx={GHP}", "password=\"aB3dE5gH7jK9mN1pQ3s\"", "clean", f"{GHP} {GHP}"]
    rows = [(f"c{i}", i, f"f{j}", contents[0] if random.random() < .7 else random.choice(contents))
            for i in range(20) for j in range(5)]
    frame = spark.createDataFrame(rows, "commit string, commit_seq int, file string, content string")
    pack = builtin_pack()
    plain = scan_table(frame, pack, path="file", commit="commit")
    columns = [c for c in plain.columns]
    want = sorted(map(str, plain.select(columns).collect()))
    assert sorted(map(str, history.scan_history(frame, pack).select(columns).collect())) == want
    hashed = frame.withColumn("blob", F.sha1("content"))
    assert sorted(map(str, history.scan_history(hashed, pack, digest="blob").select(columns).collect())) == want
    assert history.commit_range(frame, 3, 5).select("commit").distinct().count() == 2


def test_changed_and_roots(texts):
    a, b = texts(("x", GHP), ("y", GHP)), texts(("x", GHP))
    assert history.only_changed(a, texts(("y", ""), ("y", ""), ("gone", ""))).count() == 1
    assert scan_roots([a, b]).count() == 3


def test_files_on_disk(spark, tmp_path):
    for name, body in {"a.txt": GHP.encode(), "b.jpg": GHP.encode(), "c.bin2": b"\0" + GHP.encode(),
                       "sub dir/d é.env": b"\xff\xfe bad \x80\n" + GHP.encode(), ".git/config": GHP.encode(),
                       "vendor/v.go": GHP.encode(), ".env": GHP.encode(), "_x/_y": GHP.encode(), "big.txt": b"x" * 5000 + GHP.encode()}.items():
        target = tmp_path / "root" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    files = read_files(spark, str(tmp_path / "root"), max_bytes=4000, relative=True)
    assert {r.path for r in files.select("path").collect()} == {"a.txt", "c.bin2", "sub dir/d é.env", "vendor/v.go", ".env", "_x/_y"}
    listed = list_files(spark, str(tmp_path / "root"), relative=True)
    assert {(r.path, r.reason) for r in skipped_files(listed, builtin_pack(), 4000).collect()} == {
        ("b.jpg", "extension"), (".git/config", "git folder"), ("big.txt", "size"), ("vendor/v.go", "path allowlist")}
    assert {(r.path, r.reason) for r in skipped_files(files).collect()} == {("c.bin2", "binary")}
    found = scan_files(files, max_bytes=4000).collect()
    assert {(r.file, r.line, r.column) for r in found} == {("a.txt", 1, 1), ("sub dir/d é.env", 2, 1), (".env", 1, 1), ("_x/_y", 1, 1)}
    assert files_scanned(files).first()[0] == 5
    assert read_files(spark, f"file://{tmp_path}/root/.env").first().path == f"{tmp_path}/root/.env"
    with pytest.raises(Exception, match="FileNotFound"):
        list_files(spark, str(tmp_path / "nothing"))


def test_provider(spark):
    secrets = ["ghp_x", "gho_x", "xoxb-1", "sk_live_1", "sk-ant-api-1", "sk-1", "ghp_", "other", "sk_live_", "ghr_1"]
    assert truth(spark, secrets, ver.detect_provider) == ["github", "github", "slack", "stripe", "openai", "", "", "", "", ""]
    assert truth(spark, ["sk-ant-api-1"], lambda s: ver.detect_provider(s, fixed=True)) == ["anthropic"]


def test_verification(spark):
    rules = ["github-pat", "github-pat", "stripe-test-secret", "slack-bot-token", "openai-api-key", "aws-access-key",
             "anthropic-api-key"]
    rows = [(r, f"secret{i}", f"f{i}") for i, r in enumerate(rules)]
    found = (finding_rows(spark, [(f, "high", f) for _, _, f in rows]).drop("rule_id", "raw")
             .join(spark.createDataFrame(rows, "rule_id string, raw string, fingerprint string"), "fingerprint"))
    answers = spark.createDataFrame(
        [("github-pat", "secret0", 200, '{"login":"me"}', None), ("github-pat", "secret1", 403, "", None),
         ("stripe-test-secret", "secret2", 500, "", None), ("slack-bot-token", "secret3", 500, "<oops>", None),
         ("openai-api-key", "secret4", 0, "", "no route")],
        "rule_id string, raw string, http_status int, body string, transport_error string")
    answers = answers.withColumn("secret_sha256", F.sha2("raw", 256)).drop("raw")
    done = {r.fingerprint: r for r in ver.verify_findings(found, answers).collect()}
    got = {k: (r.verified, r.account, r.message, r.verification_status) for k, r in done.items()}
    assert got["f0"] == (True, "me", "GitHub token valid for user: me", "valid")
    assert got["f1"] == (False, "", "GitHub token has been revoked or rate limited", "revoked")
    assert got["f2"] == (False, "", "", "unknown")
    assert got["f3"] == (False, "", "", "error") and got["f4"] == (False, "", "", "error")
    assert got["f5"] == (False, "", "", None)
    assert got["f6"] == (None, "", "", None)
    kept = {r.fingerprint for r in ver.verify_findings(found, answers, "valid").collect()}
    assert kept == {"f0", "f5", "f6"}


def test_archive_by_path_only(spark, tmp_path):
    import io
    import tarfile
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    layer = io.BytesIO()
    with tarfile.open(fileobj=layer, mode="w") as out:
        entry = tarfile.TarInfo("etc/.env")
        entry.size = len(GHP)
        out.addfile(entry, io.BytesIO(GHP.encode()))
    with tarfile.open(folder / "image é.tar", "w") as out:
        entry = tarfile.TarInfo("one/layer.tar")
        entry.size = len(layer.getvalue())
        out.addfile(entry, io.BytesIO(layer.getvalue()))
    for path in (f"{folder}/image é.tar", f"file:{folder}/image é.tar", f"file://{folder}/image é.tar"):
        rows = expand_archives(spark.createDataFrame([(path,)], "path string")).collect()
        assert {(r.layer is None, r.path, r.error) for r in rows} == {(True, None, None), (False, None, None), (False, "etc/.env", None)}
    missing = expand_archives(spark.createDataFrame([(f"{folder}/none.tar",)], "path string")).collect()
    assert [bool(r.error) for r in missing] == [False, True]


def _crowd(spark):
    """(big, small): one key in most rows, null keys, keys on one side only, small keys that repeat."""
    big = [("hot" if i % 3 else f"k{i % 20}" if i % 2 else None, f"f{i}") for i in range(200)] + [("lone", "g")] * 2
    small = [("hot", 1), ("hot", 2), *((f"k{i}", i) for i in range(12)), ("other", 0), (None, 7)]
    return spark.createDataFrame(big, "key string, file string"), spark.createDataFrame(small, "key string, n int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [0, 20, 100_000])
def test_salted_join_equals_plain_join(spark, monkeypatch, how, hot):
    monkeypatch.setattr(history, "HOT", hot)
    big, small = _crowd(spark)
    got = history.salted_join(big, small, "key", ["file"], how=how)
    assert sorted(map(str, got.select("key", "file", "n").collect())) == sorted(map(str, big.join(small, "key", how).select("key", "file", "n").collect()))


def test_only_crowded_keys_go_out_many_times(spark, monkeypatch):
    """The side that is given out may be broadcast, so it must not grow by the number of salts."""
    monkeypatch.setattr(history, "HOT", 100)
    big, small = _crowd(spark)
    seen = []
    monkeypatch.setattr(type(small), "join", lambda left, right, *a, f=type(small).join: seen.append(right) or f(left, right, *a))
    history.salted_join(big, small, "key", ["file"])
    assert seen[-1].groupBy("key").count().filter("count > 1").collect() == [("hot", 2 * history.SALTS)]


def test_answers_go_out_once_each(spark, monkeypatch):
    found = finding_rows(spark, [(f"f{i}", "high", f"f{i}") for i in range(30)]).withColumns({"rule_id": F.lit("github-pat"), "raw": F.col("file")})
    answers = found.select("rule_id", F.sha2("raw", 256).alias("secret_sha256"), F.lit(200).alias("http_status"), F.lit("").alias("body"),
                           F.lit(None).cast("string").alias("transport_error"))
    sizes = []
    monkeypatch.setattr(type(found), "join", lambda left, right, *a, f=type(found).join: sizes.append(right.count()) or f(left, right, *a))
    done = ver.verify_findings(found, answers)
    assert sizes == [30] and done.filter("verified").count() == 30
