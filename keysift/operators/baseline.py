"""Comparing findings with a saved baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.functions.text import stable_fingerprint
from keysift.operators.history import salted_join
from keysift.sources.published import Published
from keysift.sources.staging import materialized_together

SALTS = 16
BASELINE_VERSION = "1.0"
BASELINE_COLUMNS = ("rule_id", "fingerprint", "match", "file", "line", "severity")
BASELINE_SCHEMA = ("version string, generated_at timestamp, findings array<struct<rule_id: string, "
                   "fingerprint: string, match: string, file: string, line: int, severity: string>>")


def baseline_rows(findings: DataFrame) -> DataFrame:
    return findings.select(*BASELINE_COLUMNS)


def with_stable_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("stable_fingerprint", stable_fingerprint(
        F.col("rule_id"), F.col("file"), F.col("match")))


def save_baseline(findings: DataFrame, path: str) -> None:
    """Parquet rows with version and time: a baseline as large as the findings stays distributed."""
    (baseline_rows(findings).withColumns({"version": F.lit(BASELINE_VERSION),
                                          "generated_at": F.current_timestamp()})
     .write.mode("overwrite").parquet(path))


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*BASELINE_COLUMNS)


def publish_baseline(findings: DataFrame, root: str) -> int:
    """Makes ``findings`` the next version of the baseline at ``root``, in one step; readers see the one before until then."""
    return Published(findings.sparkSession, root).replace(baseline=baseline_rows(findings))


def published_baseline(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The baseline at ``root``, its current version unless told; without any an error, so that a wrong path does not pass for an empty baseline."""
    found = Published(spark, root).read("baseline", version)
    if found is None:
        raise FileNotFoundError(f"no baseline at {root}")
    return found.select(*BASELINE_COLUMNS)


def save_bucketed(findings: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """The baseline as a table of the catalog, one row for each fingerprint, bucketed and sorted by it, so that comparing does not move it."""
    once = baseline_rows(findings).dropDuplicates(["fingerprint"])
    # one file for each bucket, so that Spark reads the buckets as sorted
    (once.repartition(buckets, "fingerprint").write.bucketBy(buckets, "fingerprint").sortBy("fingerprint").mode("overwrite")
     .option("path", path).saveAsTable(table))


def compare_with_bucketed(findings: DataFrame, table: str) -> DataFrame:
    """``compare_with_baseline`` against a table of ``save_bucketed``, for findings with one row for each fingerprint (see ``dedup``).

    Only the findings are exchanged, into the table's buckets; the baseline is read where it lies.
    """
    was = findings.sparkSession.table(table).select(*[F.col(c).alias(f"_{c}") for c in BASELINE_COLUMNS])
    met = findings.hint("merge").join(was, F.col("fingerprint") == F.col("_fingerprint"), "full")
    status = F.when(F.col("_fingerprint").isNull(), "new").when(F.col("fingerprint").isNull(), "resolved").otherwise("existing")
    shown = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in BASELINE_COLUMNS else F.col(c) for c in findings.columns]
    return met.select(*shown, status.alias("status"))


def load_baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """A baseline kept as one JSON document; a broken one raises."""
    return (spark.read.schema(BASELINE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
            .json(path).select(F.inline("findings")))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """With the comparison key: the fingerprint, or ``stable_key`` over rule, file and the whole match, which moved lines do not change.

    The stable fingerprint reads only the first bytes of a match and would take a new secret for a known one.
    """
    if key not in ("fingerprint", "stable_key"):
        raise ValueError(f"key must be fingerprint or stable_key, not {key!r}")
    if key == "fingerprint":
        return df
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_id", "file", "match")]
    return df.withColumn("stable_key", F.sha2(F.to_json(F.array(*parts)), 256))


def _known(baseline: DataFrame, key: str) -> DataFrame:
    """The keys alone, distinct: narrow rows for the join, one per key however often it repeats."""
    return _keyed(baseline, key).select(key).distinct()


def new_findings(findings: DataFrame, baseline: DataFrame | None, key: str = "fingerprint") -> DataFrame:
    if baseline is None:
        return findings
    return _keyed(findings, key).join(_known(baseline, key), key, "left_anti").select(*findings.columns)


def existing_findings(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    return _keyed(findings, key).join(_known(baseline, key), key, "left_semi").select(*findings.columns)


def resolved_findings(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Baseline rows no longer found, once per key: of several rows the first in order of line, severity and match."""
    gone = _keyed(baseline, key).join(_known(findings, key), key, "left_anti")
    first = F.min(F.struct("line", "severity", "match", "rule_id", "fingerprint", "file")).alias("_row")
    return gone.groupBy(key).agg(first).select(*[F.col("_row")[c].alias(c) for c in BASELINE_COLUMNS])


def compare_with_baseline(findings: DataFrame, baseline: DataFrame | None,
                          key: str = "fingerprint") -> DataFrame:
    """The findings with ``status`` new or existing, and the baseline's vanished ones as resolved, once per key.

    Repeated current findings all stay.  One key may stand for a large share of them (one file of a base image in very many images),
    so the known keys of such go out once per salt and their findings are spread by all their columns; nothing is joined full outer, which could not be split.
    The baseline is read once and written to the shared folder as a row for each key; so are the findings, which are read twice.
    """
    if baseline is None:
        return findings.withColumn("status", F.lit("new"))
    first = F.min(F.struct("line", "severity", "match", "rule_id", "fingerprint", "file")).alias("_row")
    findings, once = materialized_together(findings, _keyed(baseline, key).groupBy(F.col(key).alias("_key")).agg(first))
    keyed = _keyed(findings, key)
    known = once.select(F.col("_key").alias(key), F.lit(True).alias("_seen"))
    spread = [*[c for c in findings.columns if not c.startswith("_")], F.monotonically_increasing_id()]
    found = (salted_join(keyed, known, key, spread, SALTS, "left")
             .select(*findings.columns, F.when(F.col("_seen"), "existing").otherwise("new").alias("status")))
    now = keyed.select(F.col(key).alias("_key")).distinct()
    gone = once.join(now, "_key", "left_anti").select(*[F.col("_row")[c].alias(c) for c in BASELINE_COLUMNS], F.lit("resolved").alias("status"))
    return found.unionByName(gone, allowMissingColumns=True)


def baseline_statistics(statuses: DataFrame) -> DataFrame:
    """Totals per status and per severity in one grouping: rows (status, severity, findings).

    A null status or severity stands for all of them.
    """
    return statuses.cube("status", "severity").agg(F.count("*").alias("findings"))


def baseline_totals(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count("*").alias("total"),
                        *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "existing", "resolved")])
