import hashlib
from pyspark.sql import functions as F

from keysift.operators.baseline import baseline_rows
from keysift.plans import scan_table
from keysift.streaming import report_once, suppress_known, window_counts, write_stream

GHP = "ghp_" + hashlib.sha256(b"a token of our own").hexdigest()[:36].translate(str.maketrans("bdf", "BDF"))
SCHEMA = "path string, content string, ts timestamp"


def source(spark, tmp_path):
    rows = [(f"f{i % 30}", f"line {i % 3}\n{GHP}", i * 600) for i in range(90)]
    frame = spark.createDataFrame(rows, "path string, content string, at int").withColumn("ts", F.timestamp_seconds("at"))
    frame.select("path", "content", "ts").repartition(4).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def run(spark, stream, tmp_path, name):
    write_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_stream_equals_batch(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    streamed = run(spark, scan_table(stream, keep=("ts",)), tmp_path, "scan")
    want = scan_table(batch, keep=("ts",))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, want.select(streamed.columns).collect()))
    once = run(spark, report_once(scan_table(stream, keep=("ts",))), tmp_path, "once")
    assert once.count() == want.select("fingerprint").distinct().count() == 30
    known = baseline_rows(want.filter("file < 'f2'"))
    left = run(spark, suppress_known(scan_table(stream), known), tmp_path, "left")
    assert {r.file for r in left.collect()} == {r.file for r in want.filter("file >= 'f2'").collect()}


def test_windows(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    counts = window_counts(scan_table(stream, keep=("ts",)), delay="1 hour")
    query = (counts.writeStream.format("memory").queryName("hours").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    want = window_counts(scan_table(batch, keep=("ts",)))
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, want.collect()))
    sliding = window_counts(scan_table(batch, keep=("ts",)), width="2 hours", slide="1 hour")
    assert sliding.agg(F.sum("findings")).first()[0] == 180
