"""From matches to findings: gates on the secret, rule metadata, identity, and small summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from keysift.functions.entropy import adjusted_entropy
from keysift.functions.text import fingerprint, redact
from keysift.operators.allow import is_globally_allowed, is_rule_allowed
from keysift.rules.pack import RulePack
from keysift.sources.staging import Staging

FINDING_COLUMNS = ("rule_id", "description", "match", "file", "line", "column", "severity", "tags",
                   "entropy", "fingerprint", "verified", "account", "message", "commit", "context", "raw")
RULE_METADATA = ("array<struct<rule_id: string, description: string, severity: string, tags: array<string>, "
                 "threshold: double, validate: string>>")
DROPPED = 1_000_000
REPORT_ORDER = ("file", "line", "column", "rule_id")


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose value later filters read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def rule_metadata(pack: RulePack, rule_idx: Column) -> Column:
    """The rule's metadata as a struct.

    A pack is a small driver-side object; it goes in as one literal that the optimizer folds to
    an array, so that no join is needed.
    """
    entries = json.dumps([{"rule_id": r.id, "description": r.description, "severity": r.severity,
                           "tags": r.tags, "threshold": r.entropy, "validate": r.validate} for r in pack.rules])
    return F.element_at(F.from_json(F.lit(entries), RULE_METADATA), rule_idx + 1)


def with_rule_metadata(df: DataFrame, pack: RulePack) -> DataFrame:
    rule = rule_metadata(pack, F.col("rule_idx"))
    return df.select("*", *[rule[c].alias(c) for c in
                            ("rule_id", "description", "severity", "tags", "threshold", "validate")])


def with_entropy(matches: DataFrame) -> DataFrame:
    return with_once(matches, "entropy", adjusted_entropy(F.col("match")))


def entropy_gate(matches: DataFrame) -> DataFrame:
    """Keep matches that reach their rule's threshold; needs ``entropy`` and ``threshold``."""
    return matches.filter(F.col("entropy") >= F.col("threshold"))


def gate_matches(matches: DataFrame, pack: RulePack) -> DataFrame:
    """All gates on a match: rule allowlist, global allowlist, inline comment, entropy."""
    secret = F.col("match")
    kept = matches
    if "inline_allow" in matches.columns:
        kept = kept.filter(~F.col("inline_allow")).drop("inline_allow")
    kept = kept.filter(~is_rule_allowed(secret, F.col("rule_idx"), pack)
                       & ~is_globally_allowed(secret, pack))
    return entropy_gate(with_entropy(with_rule_metadata(kept, pack)))


def as_findings(matches: DataFrame, file: str, commit: str | None = None, verify: bool = False,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """The finding columns; with ``verify`` rules that name a validator start as not verified."""
    name = F.col(file)
    verified = F.when(F.col("validate") != "", F.lit(False)) if verify else F.lit(None).cast("boolean")
    computed = {
        "file": name, "verified": verified, "account": F.lit(""), "message": F.lit(""),
        "commit": F.col(commit) if commit else F.lit(""), "raw": F.col("match"),
        "fingerprint": fingerprint(F.col("rule_id"), name, F.col("line"), F.col("column"), F.col("match")),
        "context": (F.col("context") if "context" in matches.columns
                    else F.array().cast("array<string>")),
    }
    return matches.select(*[computed.get(c, F.col(c)).alias(c) for c in FINDING_COLUMNS],
                          *[c for c in keep if c not in FINDING_COLUMNS])


def dedup(findings: DataFrame) -> DataFrame:
    """One row per fingerprint; only findings are shuffled, combined before the exchange."""
    return findings.dropDuplicates(["fingerprint"])


def dedup_late(findings: DataFrame, staging: Staging | None = None) -> DataFrame:
    """``dedup`` for findings with long contexts: only (fingerprint, address) is exchanged, the wide rows stay where they were written.

    The rows are written once to the shared folder, each with an address; of equal fingerprints the first address stays.  If a count proves the others to be at
    most ``DROPPED``, they are broadcast and taken out where they lie; more are taken out by a join on the address.
    """
    staging = staging or Staging(findings.sparkSession, "dedup")
    stored = staging.write(findings.withColumn("_address", F.monotonically_increasing_id()), "rows")
    firsts = stored.groupBy("fingerprint").agg(F.min("_address").alias("_address"), F.count("*").alias("_n"))
    repeated = staging.write(firsts.filter("_n > 1"), "repeated")  # one row for each fingerprint that repeats
    some = stored.select("fingerprint", "_address").join(repeated.select("fingerprint", F.col("_address").alias("_first")), "fingerprint")
    dropped = staging.write(some.filter(F.col("_address") > F.col("_first")).select("_address"), "dropped")
    few = dropped.count() <= DROPPED  # the size is checked
    return stored.join(F.broadcast(dropped) if few else dropped.hint("merge"), "_address", "left_anti").drop("_address")


def filter_severity(findings: DataFrame, severities: list[str]) -> DataFrame:
    """No severities means no filter."""
    if not severities:
        return findings
    return findings.filter(F.lower("severity").isin([s.strip().lower() for s in severities]))


def redacted(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"match": redact(F.col("match")), "raw": F.lit("")})


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def file_summary(findings: DataFrame) -> DataFrame:
    """One row per file: counts instead of lists, so a file with very many findings stays one small row.

    The findings of a file in order are ``findings_by_file``.
    """
    severities = ("critical", "high", "medium", "low")
    return findings.groupBy("file").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.lower("severity") == s).alias(s) for s in severities],
        F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def findings_by_file(findings: DataFrame, staging: Staging | None = None) -> DataFrame:
    """The findings with ``place``, their number in report order from 1, and ``rank``, their number within the file.

    They are sorted once over ranges and written to the shared folder; a range's first place is the number of rows in the ranges before it, so a file with very
    many findings spans ranges and is no task of its own.  Equal places in a file are ordered by the match.
    """
    staging = staging or Staging(findings.sparkSession, "ranks")
    order = (*REPORT_ORDER, "match", "fingerprint")
    ordered = staging.write(findings.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_at", 33), F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row for each range
    placed = ordered.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("place", F.col("_before") + at + 1)
    starts = placed.groupBy("file").agg(F.min("place").alias("_first"))
    return (placed.join(starts, "file").withColumn("rank", F.col("place") - F.col("_first") + 1)
            .select(*findings.columns, "place", "rank"))


def report_summary(findings: DataFrame, files_scanned: DataFrame | None = None,
                   commits_scanned: DataFrame | None = None) -> DataFrame:
    """One row with totals and the summary line; the scanned counts are one-row frames."""
    names = ("findings", "files_scanned", "commits_scanned")
    parts = [findings.agg(F.count("*").alias("findings"))]
    parts += [frame.toDF(name) for frame, name in zip((files_scanned, commits_scanned), names[1:]) if frame is not None]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    total = rows.agg(*[F.coalesce(F.max(n) if n in rows.columns else F.lit(None), F.lit(0)).cast("bigint").alias(n)
                       for n in names])
    return total.withColumn("summary", F.concat_ws(
        ", ", F.format_string("Found %d secrets", "findings"),
        F.when(F.col("files_scanned") > 0, F.format_string("scanned %d files", "files_scanned")),
        F.when(F.col("commits_scanned") > 0, F.format_string("scanned %d commits", "commits_scanned"))))


def failed_gate(findings: DataFrame) -> DataFrame:
    """One row: did any finding remain?"""
    return findings.agg(F.count("*").alias("findings")).withColumn("failed", F.col("findings") > 0)
