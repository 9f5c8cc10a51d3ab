"""Scanning commit histories and change sets held as tables."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keysift.operators.allow import drop_allowed_commits, is_allowed_path
from keysift.operators.detect import candidate_masks, rule_matches
from keysift.operators.findings import as_findings, gate_matches
from keysift.rules.pack import RulePack
from keysift.sources.published import Published
from keysift.sources.staging import materialized

SALTS = 32
#: A key with more rows than this is dealt into ``SALTS`` parts.
HOT = 100_000
#: No more digests than this are broadcast.
FEW = 100_000


def salted_join(big: DataFrame, small: DataFrame, key: str | list[str], spread: list[str | Column], salts: int = SALTS,
                how: str = "inner") -> DataFrame:
    """Join in which one key may hold a large share of ``big``, which is read twice.

    The keys with more than ``HOT`` rows are counted first, no more than ``big`` has rows / ``HOT``.  Only their rows of ``small`` go out once per salt, and
    only their rows of ``big`` get a salt from the ``spread`` columns; so ``small`` is neither shuffled nor broadcast many times over.  Rows of ``big``
    with a null key meet nothing and are spread widely.  A stream is not counted.
    """
    keys = [key] if isinstance(key, str) else key
    unmet = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    wide = F.pmod(F.xxhash64(*spread), F.lit(1 << 30)).cast("int")
    salt, copies = F.lit(0), F.array(F.lit(0))
    if not big.isStreaming:
        counted = big.filter(~unmet).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT)
        crowded = materialized(counted.select(*keys, F.lit(True).alias("_hot")))
        if not crowded.isEmpty():
            big, small = big.join(crowded, keys, "left"), small.join(crowded, keys, "left")
            salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(salt)
            copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(copies)
            small = small.withColumn("_salt", F.explode(copies)).drop("_hot")
    left = big.withColumn("_salt", F.when(unmet, wide).otherwise(salt)).drop("_hot")
    right = small if "_salt" in small.columns else small.withColumn("_salt", F.lit(0))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def commit_range(commit_files: DataFrame, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Commits after ``after`` up to and including ``upto`` in sequence order."""
    kept = commit_files
    if after is not None:
        kept = kept.filter(F.col("commit_seq") > after)
    return kept if upto is None else kept.filter(F.col("commit_seq") <= upto)


def scan_history(commit_files: DataFrame, pack: RulePack, digest: str | None = None, **detect) -> DataFrame:
    """Findings of every (commit, file), with each different content matched once.

    Only contents with a candidate rule are shuffled, one per digest after combining; the second
    exchange carries digests and small match rows.  A content present in very many commits is
    spread by salt when its matches go back to them; the digests are written once to the shared folder.  ``digest`` names a column that already
    identifies the content, such as a blob hash; the places are then found without reading it.
    """
    rules = pack.compiled(detect.get("keyless", "never"))
    named = commit_files.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("commit", "file")})
    wanted = drop_allowed_commits(named, pack).filter(~is_allowed_path(F.col("file"), pack))
    identity = F.col(digest) if digest else F.sha2("content", 256)
    texts = wanted.select("content", F.col(digest).alias("digest")) if digest else wanted.select("content")
    candidates = candidate_masks(texts, "content", rules).select(
        "content", F.col("digest") if digest else identity.alias("digest"))
    contents = candidates.groupBy("digest").agg(F.first("content").alias("content"))
    matches = gate_matches(rule_matches(contents, pack, "content", **detect), pack)
    places = materialized(wanted.select("commit", "file", identity.alias("digest")))
    placed = salted_join(places, matches, "digest", ["commit", "file"])
    return as_findings(placed, "file", commit="commit")


def pack_version(pack: RulePack, **detect) -> str:
    """A digest of everything that a match depends on but the text."""
    told = json.dumps([[repr(r) for r in pack.rules], repr(pack), sorted((k, repr(v)) for k, v in detect.items())])
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def scan_history_incremental(commit_files: DataFrame, pack: RulePack, memo: str, digest: str | None = None, **detect) -> DataFrame:
    """``scan_history`` that remembers, in the shared folder ``memo``, the matches of every content it has seen.

    A run matches only contents whose digest no earlier run has seen under the same rules, and publishes their matches and digests, those without a
    match too, in one step; if two runs publish at once, one raises ``Conflict`` and may be repeated.  Findings of all given commits are returned,
    known contents being given back from the memo by the salted join.  Up to ``FEW`` unseen digests are broadcast, and no other text is moved; with more,
    the texts without a candidate rule stay where they are and the others meet the unseen digests where equal contents are brought together.
    """
    spark = commit_files.sparkSession
    named = commit_files.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("commit", "file")})
    wanted = drop_allowed_commits(named, pack).filter(~is_allowed_path(F.col("file"), pack))
    identity = F.col(digest) if digest else F.sha2("content", 256)
    places = materialized(wanted.select("commit", "file", identity.alias("digest")))
    kept = Published(spark, f"{memo.rstrip('/')}/{pack_version(pack, **detect)}")
    version = kept.version()
    before = kept.parts(version)
    seen = kept.read("seen", version)
    unseen = places.select("digest").filter("digest IS NOT NULL").distinct()
    unseen = materialized(unseen if seen is None else unseen.join(seen, "digest", "left_anti"))
    if not unseen.isEmpty():
        texts, rules = wanted.select("content", identity.alias("digest")), pack.compiled(detect.get("keyless", "never"))
        if unseen.count() <= FEW:  # the size is checked
            candidates = candidate_masks(texts.join(F.broadcast(unseen), "digest", "left_semi"), "content", rules)
        else:  # only candidates move; an inner join with distinct digests, since a semi join would be pushed below the gate
            candidates = candidate_masks(texts, "content", rules).join(unseen.hint("merge"), "digest")
        contents = candidates.groupBy("digest").agg(F.first("content").alias("content"))
        matches = gate_matches(rule_matches(contents, pack, "content", **detect), pack)
        new = {"seen": kept.write(unseen), "matches": kept.write(matches)}
        version = kept.publish({k: [*before.get(k, []), v] for k, v in new.items()}, version)
    known = kept.read("matches", version)
    if known is None:  # nothing was ever seen
        return scan_history(commit_files.limit(0), pack, digest, **detect)
    return as_findings(salted_join(places, known, "digest", ["commit", "file"]), "file", commit="commit")


def commits_scanned(commit_files: DataFrame) -> DataFrame:
    return commit_files.agg(F.countDistinct("commit").alias("commits_scanned"))


def only_changed(files: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Files named in ``changed``; its paths are made distinct before they are shuffled or broadcast."""
    return files.join(changed.select(path).distinct(), path, "left_semi")


def drop_listed_commits(commits: DataFrame, listed: DataFrame, commit: str = "commit", prefix: str = "prefix") -> DataFrame:
    """Commits that no prefix in the table ``listed`` begins, for lists too large to be literals of a plan.

    One equi-join for each length of a prefix that occurs; an empty prefix names no commit, and a commit without a hash is kept.
    """
    prefixes = materialized(listed.select(F.col(prefix).alias("prefix")).filter("prefix <> ''").distinct())
    lengths = [r[0] for r in prefixes.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # no longer than a hash
    kept = commits
    for n in lengths:
        of_length = prefixes.filter(F.length("prefix") == n).select(F.col("prefix").alias("_prefix"))
        kept = (kept.withColumn("_prefix", F.left(F.col(commit), F.lit(n))).join(of_length, "_prefix", "left_anti").drop("_prefix"))
    return kept


__all__ = ["commit_range", "commits_scanned", "drop_listed_commits", "only_changed", "pack_version", "salted_join",
           "scan_history", "scan_history_incremental"]
