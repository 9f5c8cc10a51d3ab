"""Changed files through digests of folders, against a plain comparison."""

import random

import pytest

from keysift.operators.merkle import changed_paths, file_digests, tree


def snapshot(spark, files):
    return tree(file_digests(spark.createDataFrame([(p, None if c is None else bytearray(c.encode())) for p, c in files], "path string, content binary").repartition(3)))


def plain(old, new):
    old, new = ({p.replace("\\", "/"): c for p, c in x} for x in (old, new))
    return {(p, "added" if p not in old else "removed" if p not in new else "modified") for p in old.keys() | new.keys()
            if p not in old or p not in new or old[p] != new[p]}


def changes(old, new, **more):
    return {tuple(r) for r in changed_paths(old, new, **more).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_comparison(spark, seed):
    rng = random.Random(seed)
    paths = sorted({"/".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".x"]) for _ in range(60)})
    old = [(p, rng.choice("xyz")) for p in paths if rng.random() < 0.9]
    new = [(p, c if rng.random() < 0.8 else rng.choice(["", "new", None])) for p, c in old if rng.random() < 0.9] + [("fresh/one", "1"), ("top", "2")]
    assert changes(snapshot(spark, old), snapshot(spark, new)) == plain(old, new)


def test_folders_without_a_change_are_not_entered(spark):
    old = [(f"same/{i % 5}/{i}", "x") for i in range(50)] + [("other/deep/er/file", "a"), ("other/deep/still", "b"), ("top", "t")]
    new = [(p, "A" if p == "other/deep/er/file" else c) for p, c in old]
    seen = []
    assert changes(snapshot(spark, old), snapshot(spark, new), seen=seen) == {("other/deep/er/file", "modified")}
    entered = {r["path"] for level in seen for r in level.collect()}
    assert entered == {"", "same", "other", "top", "other/deep", "other/deep/er", "other/deep/still", "other/deep/er/file"}


def test_equal_trees_end_at_the_root(spark):
    files, seen = [("a/b", "1"), ("c", "2"), ("a/b", "1")], []
    assert changes(snapshot(spark, files), snapshot(spark, files[::-1]), seen=seen) == set()
    assert [level.count() for level in seen] == [1]


def test_a_folder_that_becomes_a_file_and_odd_paths(spark):
    old = [("a/b", "1"), ("win\\dir\\f", "w"), ("n", None)]
    new = [("a", "1"), ("win/dir/f", "w"), ("n", "")]
    assert changes(snapshot(spark, old), snapshot(spark, new)) == {("a/b", "removed"), ("a", "added"), ("n", "modified")}


def test_moved_contents_are_changes(spark):
    assert changes(snapshot(spark, [("a/x", "1"), ("b/y", "2")]), snapshot(spark, [("a/x", "2"), ("b/y", "1")])) == {("a/x", "modified"), ("b/y", "modified")}


def test_empty_snapshots(spark):
    none = snapshot(spark, [("a", "1")]).limit(0)
    some = snapshot(spark, [("a/b", "1"), ("c", "2")])
    assert changes(none, none) == set()
    assert changes(none, some) == {("a/b", "added"), ("c", "added")} and changes(some, none) == {("a/b", "removed"), ("c", "removed")}
