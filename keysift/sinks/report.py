"""Reports: JSON Lines, CSV, one JSON object, SARIF and a plain listing.

Rows are rendered where they are.  The two formats that are a single document are written as
ordered part files whose concatenation is that document: an opening line, one line per finding,
a closing line.  No finding ever passes through the driver or through one collected array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.functions.text import clip_match, fingerprint_short, truncate
from keysift.operators.findings import REPORT_ORDER, redacted, report_summary
from keysift.operators.gates import slashes
from keysift.sources.staging import materialized

VERSION = "0.1.0"
TOOL = "keysift"
RULE_URI = "urn:keysift:rule:"

# The SARIF document.
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SCORES = {"critical": "9.5", "high": "8.0", "medium": "6.5", "low": "4.0"}
OTHER_LEVEL, OTHER_SCORE = "warning", "6.5"
SNIPPET_LIMIT = 100
ZERO_TIME = "0001-01-01T00:00:00Z"


def _lookup(values: dict[str, str], key: Column, other: str) -> Column:
    found = F.lit(other)
    for name, value in values.items():
        found = F.when(key == name, value).otherwise(found)
    return found


def severity_level(severity: Column) -> Column:
    return _lookup(LEVELS, F.lower(severity), OTHER_LEVEL)


def severity_score(severity: Column) -> Column:
    return _lookup(SCORES, F.lower(severity), OTHER_SCORE)


# -- rows -----------------------------------------------------------------------------

def json_rows(findings: DataFrame, redact: bool = False) -> DataFrame:
    """The fields of a finding in report order; empty optional ones are null and left out of JSON."""
    shown = redacted(findings) if redact else findings
    optional = {c: F.nullif(F.col(c), F.lit("")) for c in ("account", "message", "commit", "raw")}
    return shown.select(
        F.lit("").alias("id"), "rule_id", "description", "match", "file", "line", "column", "severity", "tags",
        "entropy", "fingerprint", F.lit(ZERO_TIME).alias("timestamp"), "verified",
        optional["account"].alias("account"), optional["message"].alias("message"),
        optional["commit"].alias("commit"), F.lit(ZERO_TIME).alias("date"),
        F.when(F.size("context") > 0, F.col("context")).alias("context"), optional["raw"].alias("raw"))


def csv_rows(findings: DataFrame, redact: bool = False) -> DataFrame:
    shown = redacted(findings) if redact else findings
    return shown.select(
        F.col("rule_id").alias("Rule ID"), F.col("description").alias("Description"),
        F.col("match").alias("Match"), F.col("file").alias("File"), F.col("line").alias("Line"),
        F.col("column").alias("Column"), F.col("severity").alias("Severity"),
        F.array_join("tags", ",").alias("Tags"), F.format_string("%.2f", "entropy").alias("Entropy"),
        fingerprint_short(F.col("fingerprint")).alias("Fingerprint"),
        F.coalesce(F.col("verified").cast("string"), F.lit("")).alias("Verified"))


def listing(findings: DataFrame, redact: bool = False) -> DataFrame:
    """What a person reads per finding, with long matches shortened in the middle."""
    shown = redacted(findings) if redact else findings
    return shown.select(
        "file", F.upper("severity").alias("severity"), "rule_id", "line", "column",
        clip_match(F.col("match")).alias("match"), "description",
        F.array_join("tags", ", ").alias("tags"), F.format_string("%.2f", "entropy").alias("entropy"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule seen, described by its first finding in report order."""
    first = F.min_by(F.struct("description", "severity", "tags"), F.struct(*REPORT_ORDER))
    return findings.groupBy("rule_id").agg(first.alias("first")).select(
        "rule_id", F.col("first.description").alias("description"),
        severity_level(F.col("first.severity")).alias("level"),
        severity_score(F.col("first.severity")).alias("score"), F.col("first.tags").alias("tags"))


def _text(value: Column | str) -> Column:
    return F.struct((F.col(value) if isinstance(value, str) else value).alias("text"))


def _rule_json() -> Column:
    return F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
        _text("description").alias("shortDescription"), _text("description").alias("fullDescription"),
        F.struct("level").alias("defaultConfiguration"), _text("description").alias("help"),
        F.concat(F.lit(RULE_URI), "rule_id").alias("helpUri"),
        F.struct(F.lit("high").alias("precision"), F.col("score").alias("security-severity"), "tags")
        .alias("properties")))


def sarif_results(findings: DataFrame, redact: bool = False) -> DataFrame:
    """One row per finding: the values of its SARIF result and the rendered ``result``."""
    shown = redacted(findings) if redact else findings
    rows = shown.select(
        *REPORT_ORDER, severity_level(F.col("severity")).alias("level"),
        F.concat("description", F.lit(": "), "match").alias("message"),
        truncate(F.col("match"), SNIPPET_LIMIT).alias("snippet"), "fingerprint")
    place = F.struct(
        F.struct(slashes(F.col("file")).alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"),
                 _text("snippet").alias("snippet")).alias("region"))
    return rows.withColumn("result", F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level", _text("message").alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))))


def report_metrics(findings: DataFrame, files_scanned: DataFrame | None = None,
                   commits_scanned: DataFrame | None = None, scan_time: str = "") -> DataFrame:
    """One row: everything of the JSON report but the findings, and its rendered ``metrics``."""
    totals = report_summary(findings, files_scanned, commits_scanned)
    if scan_time:
        totals = totals.withColumn("summary", F.concat_ws(", ", "summary", F.lit(f"in {scan_time}")))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return totals.withColumn("metrics", F.to_json(F.struct(
        "files_scanned", F.nullif("commits_scanned", F.lit(0)).alias("commits_scanned"),
        F.lit(scan_time).alias("scan_time"), stamp.alias("scanned_at"), F.lit(VERSION).alias("version"),
        "summary")))


# -- files ----------------------------------------------------------------------------

def _document(opening: DataFrame, items: DataFrame, closing: DataFrame) -> DataFrame:
    """Lines of a document whose middle is a JSON array, in partition order.

    ``items`` has the report order columns and ``item``.  Sorting range-partitions it; the first row of the first range that has rows
    is the one element without a comma before it.
    """
    ordered = materialized(items.orderBy(*REPORT_ORDER).withColumn("_at", F.monotonically_increasing_id()))
    first = ordered.agg(F.min("_at")).first()[0]
    lines = ordered.orderBy("_at").select(F.when(F.col("_at") == F.lit(first), F.col("item"))
                                          .otherwise(F.concat(F.lit(","), "item")).alias("value"))
    return opening.union(lines).union(closing)


class Malformed(ValueError):
    """Part files that do not make up one document."""


def document_items(spark: SparkSession, path: str) -> DataFrame:
    """(place, item) of the array in the document that the part files at ``path`` make up, without putting it together.

    The files are read in order of name, each in order of its lines.  A document has its opening line first and its closing line last, every line
    between them is one element, and all but the first element follow a comma; anything else raises ``Malformed``.
    """
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                  F.monotonically_increasing_id().alias("line")).alias("place"), "value")
    stored = materialized(lines)
    first, last = stored.agg(F.min("place"), F.max("place")).first()
    if first is None:
        raise Malformed(f"{path} has no lines")
    ends = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("file", "block", "line"), end)]) for end in (first, last)]
    opening, closing = (stored.filter(F.col("place") == end).first()["value"] for end in ends)
    inner = stored.filter((F.col("place") != ends[0]) & (F.col("place") != ends[1]))
    bare, top = inner.agg(F.count_if(~F.col("value").startswith(",")), F.min_by("value", "place")).first()
    if not (opening.endswith("[") and closing.startswith("]")) or bare > 1 or bare and top.startswith(",") or not bare and top is not None:
        raise Malformed(f"the part files at {path} are no document")
    return inner.select("place", F.regexp_replace("value", "^,", "").alias("item"))


def parsed_items(items: DataFrame, schema: str) -> DataFrame:
    """The elements by ``schema``; one that is no JSON object raises when it is read."""
    return items.select(F.from_json("item", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def write_sarif(findings: DataFrame, path: str, redact: bool = False) -> None:
    """A SARIF log as ordered part files; ``cat path/part-*`` is the document."""
    stored = materialized(findings)
    rules = F.concat_ws(",", F.array_sort(F.collect_list("rule")))  # at most one per rule of the pack
    head = F.concat(
        F.lit('{"$schema":"%s","version":"%s","runs":[{"tool":{"driver":{"name":"%s","version":"%s",'
              '"informationUri":"urn:%s","rules":[' % (SARIF_SCHEMA, SARIF_VERSION, TOOL, VERSION, TOOL)),
        rules, F.lit(']}},"results":['))
    opening = sarif_rules(stored).select(_rule_json().alias("rule")).agg(head.alias("value"))
    closing = stored.sparkSession.range(1, numPartitions=1).select(F.lit("]}]}").alias("value"))
    items = sarif_results(stored, redact).withColumnRenamed("result", "item")
    _document(opening, items, closing).write.mode("overwrite").text(path)


def write_json(findings: DataFrame, path: str, redact: bool = False, files_scanned: DataFrame | None = None,
               commits_scanned: DataFrame | None = None, scan_time: str = "") -> None:
    """The report as one JSON object in ordered part files."""
    stored = materialized(findings)
    opening = stored.sparkSession.range(1, numPartitions=1).select(F.lit('{"findings":[').alias("value"))
    metrics = report_metrics(stored, files_scanned, commits_scanned, scan_time)
    closing = metrics.select(F.concat(F.lit("],"), F.substring("metrics", 2, F.length("metrics"))).alias("value"))
    items = json_rows(stored, redact).withColumn("item", F.to_json(F.struct("*")))
    _document(opening, items, closing).write.mode("overwrite").text(path)


def write_jsonl(findings: DataFrame, path: str, redact: bool = False) -> None:
    json_rows(findings, redact).write.mode("overwrite").json(path)


def write_csv(findings: DataFrame, path: str, redact: bool = False) -> None:
    (csv_rows(findings, redact).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("emptyValue", "").csv(path))


def write_listing(findings: DataFrame, path: str, redact: bool = False) -> None:
    rows = listing(findings, redact).orderBy("file", "line", "column", "rule_id")
    (rows.write.mode("overwrite").option("header", True).option("sep", "\t").option("escape", '"').csv(path))


WRITERS = {"json": write_json, "jsonl": write_jsonl, "csv": write_csv, "sarif": write_sarif,
           "text": write_listing}


def write_findings(findings: DataFrame, path: str, format: str = "json", redact: bool = False) -> None:
    writer = WRITERS.get(format.lower())
    if writer is None:
        raise ValueError(f"unknown format {format!r}; use one of {', '.join(WRITERS)}")
    writer(findings, path, redact)
