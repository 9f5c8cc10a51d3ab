"""Documents taken apart again, ranks in files, files of unknown length, and paths with other separators."""

import json

import pytest
from pyspark.sql import functions as F

from keysift.operators.findings import findings_by_file
from keysift.operators.gates import gate_files, gate_image_files, slashes
from keysift.plans import scan_files, scan_image_files, scan_table
from keysift.rules import builtin_pack
from keysift.sinks import Malformed, document_items, parsed_items, write_json, write_sarif
from keysift.sources import skipped_files, skipped_image_files

TOKEN = "AKIAQ7RSTUVWXYZ2K4L"


def findings(spark, *texts):
    return scan_table(spark.createDataFrame(list(texts), "path string, content string").repartition(5))


def whole(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


@pytest.mark.parametrize("texts", [[], [("a", f"k={TOKEN}A")], [("hot", "\n".join(f"k={TOKEN}{c}" for c in "ABCDEFGHIJKLMN")), ("z,\n]}", f"[{TOKEN}B")]])
def test_documents_come_apart_as_they_were(spark, tmp_path, texts):
    found = findings(spark, *texts)
    for name, write, field in (("json", write_json, "findings"), ("sarif", write_sarif, "results")):
        write(found, str(tmp_path / name))
        document = whole(tmp_path / name)
        items = document[field] if name == "json" else document["runs"][0][field]
        got = document_items(spark, str(tmp_path / name)).orderBy("place").collect()
        assert [json.loads(r["item"]) for r in got] == items
        assert len(got) == found.count()


def test_an_empty_first_range_leaves_no_comma(spark, tmp_path):
    from keysift.sinks.report import _document
    line = lambda text: spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))
    items = spark.createDataFrame([("f", i, 1, "r", str(i)) for i in range(6)], "file string, line int, column int, rule_id string, item string")
    _document(line("["), items.repartition(4).filter("line > 0"), line("]")).write.text(str(tmp_path / "d"))
    assert whole(tmp_path / "d") == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("lines", [[], ["["], ["[", ",1", "]"], ["[", "1", "2", "]"], ["{", "1", "]"], ["[", "1", ",2"]])
def test_broken_documents_raise(spark, tmp_path, lines):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-00000.txt").write_text("".join(f"{x}\n" for x in lines))
    with pytest.raises(Malformed):
        document_items(spark, str(tmp_path / "d"))


def test_elements_that_are_no_json_raise(spark, tmp_path):
    (tmp_path / "part-00000.txt").write_text('[\n{"a":1}\n,{"a":\n]\n')
    with pytest.raises(Exception, match="MALFORMED"):
        parsed_items(document_items(spark, str(tmp_path)), "a int").collect()


def test_ranks_of_a_hot_file(spark):
    hot = "\n".join(f"x={TOKEN}{chr(65 + i % 26)} y={TOKEN}{chr(90 - i % 26)}" for i in range(120))
    found = findings(spark, ("hot", hot), ("a", f"k={TOKEN}A"), ("zz", f"k={TOKEN}A\n{TOKEN}B"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r.asDict() for r in findings_by_file(found).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((r["file"], r["line"], r["column"], r["rule_id"], r["match"]) for r in found.collect())
    got.sort(key=lambda r: r["place"])
    assert [(r["file"], r["line"], r["column"], r["rule_id"], r["match"]) for r in got] == want
    assert [r["place"] for r in got] == list(range(1, len(want) + 1))
    for name in ("hot", "a", "zz"):
        ranks = [r["rank"] for r in got if r["file"] == name]
        assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert findings_by_file(found.limit(0)).count() == 0


def files(spark):
    rows = [("a.env", None, f"k={TOKEN}A"), ("b.env", 10, f"k={TOKEN}B"), ("big.env", None, "y" * 500), ("c.a", None, f"k={TOKEN}C"), ("none.env", None, None), (None, None, "z")]
    return spark.createDataFrame([(p, n, None if c is None else bytearray(c.encode())) for p, n, c in rows], "path string, length long, content binary")


def test_files_of_unknown_length_are_judged_by_their_content(spark):
    assert [r["file"] for r in scan_files(files(spark), max_bytes=100).orderBy("file").collect()] == ["a.env", "b.env", "c.a"]
    skipped = {r["path"]: r["reason"] for r in skipped_files(files(spark), builtin_pack(), max_bytes=100).collect()}
    assert skipped == {"big.env": "size"}
    kept = {r["path"] for r in gate_files(files(spark), max_bytes=100).collect()}
    assert kept | skipped.keys() == {"a.env", "b.env", "big.env", "c.a", "none.env", None}
    assert {r["path"] for r in gate_files(files(spark).drop("content"), max_bytes=100).collect()} >= {"big.env"}  # nothing says that it is large


def test_image_files_left_out_are_listed(spark):
    kept = {r["path"] for r in gate_image_files(files(spark), max_bytes=100).collect()}
    skipped = {r["path"]: r["reason"] for r in skipped_image_files(files(spark), max_bytes=100).collect()}
    assert skipped == {"big.env": "size", "c.a": "extension"} and kept | skipped.keys() == {r["path"] for r in files(spark).collect()}
    assert {r["file"] for r in scan_image_files(files(spark)).collect()} == {"a.env", "b.env"}


def test_other_separators(spark, tmp_path):
    rows = spark.createDataFrame([("src\\vendor\\x\\a.go",), ("src\\.git\\config",), ("a\\b.txt",), (None,)], "path string")
    assert [r[0] for r in rows.select(slashes(F.col("path"))).collect()] == ["src/vendor/x/a.go", "src/.git/config", "a/b.txt", None]
    texts = [("src\\vendor\\x\\a.go", f"k={TOKEN}A"), ("src\\b.env", f"k={TOKEN}B")]
    found = findings(spark, *texts)
    assert [r["file"] for r in found.collect()] == ["src\\b.env"]  # vendored files are on the path allowlist
    write_sarif(found, str(tmp_path / "s"))
    place = whole(tmp_path / "s")["runs"][0]["results"][0]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "src/b.env"
    inside = spark.createDataFrame([("src\\.git\\config", 3, bytearray(b"abc"))], "path string, length long, content binary")
    assert gate_files(inside).count() == 0 and skipped_files(inside).first()["reason"] == "git folder"


def test_late_dedup_moves_no_contexts(spark, monkeypatch):
    from keysift.operators import findings as fnd
    texts = [("a", f"k={TOKEN}A\nsecond"), ("b", f"k={TOKEN}B"), ("a", f"k={TOKEN}A\nother context"), ("a", f"k={TOKEN}A\nsecond")]
    found = findings(spark, *texts)
    want = sorted(r["fingerprint"] for r in fnd.dedup(found).collect())
    for most in (fnd.DROPPED, 0):
        monkeypatch.setattr(fnd, "DROPPED", most)
        late = fnd.dedup_late(found)
        assert sorted(r["fingerprint"] for r in late.collect()) == want and late.columns == found.columns
        plan = late._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert ("Exchange hashpartitioning" not in plan) == (most > 0)
        contexts = {r["file"]: tuple(r["context"]) for r in late.collect()}
        assert contexts["a"] in {("k=" + TOKEN + "A", "second"), ("k=" + TOKEN + "A", "other context")}
    assert fnd.dedup_late(found.limit(0)).count() == 0


def test_frames_written_side_by_side(spark):
    from keysift.sources import materialized_together
    one, two = materialized_together(spark.range(5), spark.range(7).toDF("x"))
    assert (one.count(), two.count(), two.columns) == (5, 7, ["x"])
