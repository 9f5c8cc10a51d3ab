"""Tables published in versions, the memo of history scans, and baselines kept by them."""

import pytest
from pyspark.sql import functions as F

from keysift.operators import baseline, history
from keysift.plans import scan_table
from keysift.rules import builtin_pack, pack_from_dict
from keysift.sources import Conflict, Published

TOKEN = "AKIAQ7RSTUVWXYZ2K4L"


def test_versions_are_whole(spark, tmp_path):
    table = Published(spark, f"{tmp_path}/t")
    assert table.version() == 0 and table.parts() == {} and table.read("a") is None
    assert table.replace(a=spark.range(3)) == 1
    table.write(spark.range(100))  # a writer that died before it published
    assert table.read("a").count() == 3
    assert table.append(a=spark.range(10, 12), b=spark.range(1)) == 2
    assert sorted(r[0] for r in table.read("a").collect()) == [0, 1, 2, 10, 11] and table.read("b").count() == 1
    assert table.replace(a=spark.range(1)) == 3
    assert table.read("a").count() == 1 and table.read("a", version=1).count() == 3 and table.read("b") is None


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = Published(spark, f"{tmp_path}/t"), Published(spark, f"{tmp_path}/t")
    one.replace(a=spark.range(2))
    after = two.version()
    folder = two.write(spark.range(9))
    one.append(a=spark.range(5, 6))
    with pytest.raises(Conflict):
        two.publish({"a": [folder]}, after)
    assert one.read("a").count() == 3
    assert not [p.name for p in (tmp_path / "t" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def commits(spark, *rows):
    return spark.createDataFrame([(c, f, t) for c, f, t in rows], "commit string, file string, content string").repartition(3)


def found(frame):
    return sorted((r["commit"], r["file"], r["line"], r["match"], r["fingerprint"], tuple(r["context"])) for r in frame.collect())


def test_a_second_run_matches_only_new_contents(spark, tmp_path):
    pack, memo = builtin_pack(), f"{tmp_path}/memo"
    first = [("c1", "a.env", f"k={TOKEN}A"), ("c1", "b.txt", "nothing here"), ("c2", "a.env", f"k={TOKEN}A"), ("c2", "n.env", None)]
    later = [("c3", "a.env", f"new\nk={TOKEN}B"), ("c3", "c.env", f"k={TOKEN}A"), (None, None, f"k={TOKEN}C")]
    assert found(history.scan_history_incremental(commits(spark, *first), pack, memo)) == found(history.scan_history(commits(spark, *first), pack))
    table = Published(spark, f"{memo}/{history.pack_version(pack)}")
    assert table.read("seen").count() == 2  # contents without a match are seen too
    both = commits(spark, *first, *later)
    assert found(history.scan_history_incremental(both, pack, memo)) == found(history.scan_history(both, pack))
    assert table.version() == 2 and table.read("seen").count() == 4
    new = table.parts()["matches"][1]
    assert spark.read.parquet(f"{memo}/{history.pack_version(pack)}/{new}").count() == 2
    assert found(history.scan_history_incremental(both, pack, memo)) == found(history.scan_history(both, pack))
    assert table.version() == 2  # nothing new, nothing published


def test_other_rules_have_a_memo_of_their_own(spark, tmp_path):
    pack = pack_from_dict({"rules": [{"id": "r", "regex": "zz[0-9]+", "keywords": ["zz"], "entropy": -9.0}]})
    rows = commits(spark, ("c", "f", f"zz12 {TOKEN}A"))
    memo = f"{tmp_path}/memo"
    assert [m[3] for m in found(history.scan_history_incremental(rows, pack, memo))] == ["zz12"]
    assert [m[3] for m in found(history.scan_history_incremental(rows, builtin_pack(), memo))] == [f"{TOKEN}A"]
    assert history.pack_version(pack) != history.pack_version(pack, context=None)


def test_a_blob_hash_and_empty_histories(spark, tmp_path):
    rows = commits(spark, ("c1", "f", f"k={TOKEN}A"), ("c2", "g", f"k={TOKEN}A")).withColumn("blob", F.lit("h1"))
    got = found(history.scan_history_incremental(rows, builtin_pack(), f"{tmp_path}/m", digest="blob"))
    assert [(c, f) for c, f, *_ in got] == [("c1", "f"), ("c2", "g")]
    assert history.scan_history_incremental(rows.limit(0), builtin_pack(), f"{tmp_path}/none").count() == 0


def test_listed_commits(spark):
    rows = spark.createDataFrame([("abcdef",), ("abc",), ("bcd",), (None,), ("",)], "commit string")
    listed = spark.createDataFrame([("abcd",), ("b",), ("",), ("abcdefg",), ("abcd",), (None,)], "prefix string")
    kept = history.drop_listed_commits(rows, listed)
    assert sorted(str(r[0]) for r in kept.collect()) == ["", "None", "abc"] and kept.columns == ["commit"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert history.drop_listed_commits(rows, listed.limit(0)).count() == 5


def findings(spark, *texts):
    return scan_table(spark.createDataFrame(list(texts), "path string, content string"))


def test_baselines_are_published_whole(spark, tmp_path):
    root = f"{tmp_path}/base"
    with pytest.raises(FileNotFoundError):
        baseline.published_baseline(spark, root)
    old = findings(spark, ("a", f"k={TOKEN}A"), ("b", f"k={TOKEN}B"))
    new = findings(spark, ("a", f"k={TOKEN}A"), ("c", f"k={TOKEN}C"))
    baseline.publish_baseline(old, root)
    kept = baseline.published_baseline(spark, root)
    baseline.publish_baseline(new.limit(0), root)
    assert [r["file"] for r in baseline.new_findings(new, kept).collect()] == ["c"]
    assert baseline.published_baseline(spark, root).count() == 0 and baseline.published_baseline(spark, root, version=1).count() == 2


def test_bucketed_baselines_stay_where_they_are(spark, tmp_path):
    old = findings(spark, ("a", f"k={TOKEN}A"), ("b", f"k={TOKEN}B"), ("a", f"k={TOKEN}A"))
    new = findings(spark, ("a", f"k={TOKEN}A"), ("c", f"k={TOKEN}C"))
    baseline.save_bucketed(old, "kept_findings", f"{tmp_path}/kept", buckets=4)
    compared = baseline.compare_with_bucketed(new, "kept_findings")
    assert sorted((r["file"], r["status"]) for r in compared.collect()) == [("a", "existing"), ("b", "resolved"), ("c", "new")]
    plan = compared._jdf.queryExecution().sparkPlan().toString()
    executed = compared._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and executed.count("Exchange hashpartitioning") == 1  # that of the findings
    spark.sql("DROP TABLE kept_findings")


@pytest.mark.parametrize("few", [0, 100_000])
def test_many_unseen_contents_equal_few(spark, tmp_path, monkeypatch, few):
    """With many unseen contents only texts with a candidate rule are brought together."""
    monkeypatch.setattr(history, "FEW", few, raising=False)
    gated = []
    monkeypatch.setattr(history, "candidate_masks", lambda df, *a, f=history.candidate_masks: gated.append(df) or f(df, *a))
    pack, memo = builtin_pack(), f"{tmp_path}/memo"
    first = [("c1", f"f{i}", f"text {i}\nx={TOKEN}{i % 3}" if i % 2 else f"plain {i}") for i in range(20)]
    schema = "commit string, file string, content string"
    for rows in (first, [*first, ("c2", "g", f"new\nx={TOKEN}Z"), ("c2", "f1", first[1][2]), ("c2", "n", None)]):
        frame = spark.createDataFrame(rows, schema)
        got = found(history.scan_history_incremental(frame, pack, memo))
        gate = gated[0]._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in gate) == (few > 0)
        gated.clear()
        assert got == found(history.scan_history(frame, pack)) and got
        gated.clear()
