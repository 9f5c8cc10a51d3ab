"""Continuous scanning.  The per-row operators are the batch ones; only state and sinks differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from keysift.operators.baseline import new_findings

DAY = "1 day"


def report_once(findings: DataFrame, ts: str = "ts", delay: str = DAY) -> DataFrame:
    """Each fingerprint once; its state is dropped ``delay`` behind the watermark."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def suppress_known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Leave out findings of a static baseline (stream-static anti join)."""
    return new_findings(findings, baseline)


def window_counts(findings: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None,
                  delay: str | None = None) -> DataFrame:
    """Findings per severity and window; with ``delay`` late rows are dropped behind the watermark.

    A stream needs a delay, or its state would grow for ever.
    """
    if findings.isStreaming and not delay:
        raise ValueError("window counts of a stream need a delay")
    timed = findings.withWatermark(ts, delay) if delay else findings
    window: Column = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (timed.groupBy(window.alias("window"), "severity").agg(F.count("*").alias("findings"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "severity", "findings"))


def write_stream(findings: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                 interval: str = "1 minute") -> StreamingQuery:
    """Append to a Parquet table; the checkpoint makes each input count exactly once."""
    writer = findings.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(path)
