import hashlib
import csv
import gzip
import io
import json
import tarfile

import pytest

from keysift.plans import archive_errors, archive_metrics, scan_archives, scan_image_files, scan_table
from keysift.sinks import write_csv, write_findings, write_json, write_jsonl, write_sarif

GHP = "ghp_" + hashlib.sha256(b"a token of our own").hexdigest()[:36].translate(str.maketrans("bdf", "BDF"))


@pytest.fixture(scope="module")
def found(texts):
    return scan_table(texts(*[(f"f{i:03}", f'say "hi", é\n{GHP}{i}\npassword="aB3dE5gH7jK9mN1pQ3s"') for i in range(300)])
                      .repartition(5)).persist()


def document(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


def test_sarif_is_one_ordered_document(found, tmp_path):
    write_sarif(found, str(tmp_path / "s"))
    run = json.loads(document(tmp_path / "s"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["generic-secret", "github-pat"]
    assert run["tool"]["driver"]["rules"][1]["properties"]["security-severity"] == "8.0"
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"],
               r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]]
    assert len(places) == 600 and places == sorted(places)


def test_json_report(found, tmp_path):
    write_json(found, str(tmp_path / "j"), redact=True, scan_time="2s")
    report = json.loads(document(tmp_path / "j"))
    assert len(report["findings"]) == 600 and report["summary"] == "Found 600 secrets, in 2s"
    first = report["findings"][0]
    assert first["match"] == "ghp_***" + GHP[-4:] and "raw" not in first and "verified" not in first


def test_empty_documents(found, tmp_path):
    write_sarif(found.filter("false"), str(tmp_path / "s"))
    assert json.loads(document(tmp_path / "s"))["runs"][0]["results"] == []
    write_json(found.filter("false"), str(tmp_path / "j"))
    assert json.loads(document(tmp_path / "j"))["findings"] == []


def test_csv_and_jsonl(found, tmp_path):
    write_csv(found, str(tmp_path / "c"))
    rows = [r for p in (tmp_path / "c").glob("part-*") for r in csv.DictReader(io.StringIO(p.read_text()))]
    assert len(rows) == 600 and rows[0]["Verified"] == "" and len(rows[0]["Fingerprint"]) == 19
    assert {r["Match"] for r in rows if r["Rule ID"] == "generic-secret"} == {'password="aB3dE5gH7jK9mN1pQ3s"'}
    write_jsonl(found, str(tmp_path / "l"))
    objects = [json.loads(x) for p in (tmp_path / "l").glob("part-*") for x in p.read_text().splitlines()]
    assert len(objects) == 600 and "account" not in objects[0] and objects[0]["raw"]


def test_dispatch(found, tmp_path):
    write_findings(found, str(tmp_path / "t"), "TEXT")
    with pytest.raises(ValueError):
        write_findings(found, str(tmp_path / "u"), "xml")


def tar(*entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, body in entries:
            info = tarfile.TarInfo(name)
            if body is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(body)
            archive.addfile(info, io.BytesIO(body or b""))
    return out.getvalue()


def test_archives(spark):
    layer = tar(("dir", None), ("app/.env", GHP.encode()), ("bin/x.exe", GHP.encode()), ("vendor/v", GHP.encode()))
    images = [
        ("good", tar(("a/layer.tar", layer), ("b/layer.tar", gzip.compress(layer)), ("manifest.json", b"{}"), ("c.tar", b"junk"))),
        ("broken", b"not a tar" * 100), ("empty", b""), ("cut", tar(("a.tar", layer))[:1500]),
        ("badgzip", tar(("z.tar", b"\x1f\x8bnonsense"))), ("gone", None)]
    frame = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in images], "path string, content binary")
    rows = scan_archives(frame).collect()
    assert {(r.image, r.layer, r.file, r.tags[-1]) for r in rows} == {
        ("good", "a/layer.tar", "app/.env", "docker-layer"), ("good", "b/layer.tar", "app/.env", "docker-layer")}
    metrics = {r.image: (r.layers_scanned, r.files, r.errors) for r in archive_metrics(frame).collect()}
    assert metrics == {"good": (3, 6, 1), "broken": (0, 0, 1), "empty": (0, 0, 0), "cut": (1, 0, 2), "badgzip": (1, 0, 1), "gone": (0, 0, 1)}
    errors = {(r.image, r.layer) for r in archive_errors(frame).collect()}
    assert errors == {("broken", None), ("badgzip", "z.tar"), ("good", "c.tar"), ("cut", "a.tar"), ("cut", None), ("gone", None)}


def test_nothing_is_lost_silently(spark, tmp_path):
    """Large files, a layer cut between entries, a broken header after good ones; archives read by path."""
    large = tar(("a", b"x" * 3000), ("b", b"y"))
    first = tar(("a", b"x"))[:1024]
    images = {"large": tar(("l.tar", large)), "between": tar(("l.tar", first)), "header": tar(("l.tar", first + b"junk" * 128 + bytes(1024))),
              "outer": tar(("l.tar", tar(("a", b"x"))))}
    for name, body in images.items():
        (tmp_path / f"{name}.img").write_bytes(body)
    paths = spark.createDataFrame([(f"{tmp_path}/{n}.img",) for n in [*images, "missing"]], "path string")
    held = {r.image.rpartition("/")[2][:-4]: (r.layers_scanned, r.files, r.errors) for r in archive_metrics(paths, 12_000).collect()}
    assert held == {"large": (1, 2, 0), "between": (1, 1, 1), "header": (1, 1, 1), "outer": (1, 1, 0), "missing": (0, 0, 1)}
    rows = archive_errors(paths.filter("path LIKE '%large.img'"), 2000).collect()
    assert [(r.layer, "large file" in r.error) for r in rows] == [("l.tar", True)]


def test_image_directory(spark):
    rows = [("a.bin", 9, b"x"), ("b.txt", len(GHP), GHP.encode()), ("c.txt", 600 * 1024 * 1024, GHP.encode())]
    frame = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in rows], "path string, length bigint, content binary")
    assert [r.file for r in scan_image_files(frame).collect()] == ["b.txt"]
