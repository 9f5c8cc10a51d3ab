"""The scans: compositions of the operators, from texts to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysift.operators.allow import DEFAULT_MARKERS
from keysift.operators.baseline import new_findings
from keysift.operators.composite import composite_matches
from keysift.operators.detect import rule_matches
from keysift.operators.findings import as_findings, dedup, filter_severity, gate_matches
from keysift.operators.history import salted_join
from keysift.operators.gates import MAX_FILE_BYTES, MAX_IMAGE_BYTES, gate_files, gate_image_files, gate_paths, readable_text
from keysift.operators.verification import verify_findings
from keysift.rules.pack import RulePack, builtin_pack
from keysift.sources.archives import expand_archives, expand_layers, layer_manifest, one_place_each
from keysift.sources.files import files_as_text
from keysift.sources.staging import materialized


def scan_table(df: DataFrame, pack: RulePack | None = None, path: str = "path", text: str = "content",
               commit: str | None = None, keep: tuple[str, ...] = (), keyless: str = "never",
               markers: tuple[str, ...] = DEFAULT_MARKERS, context: int | None = 2,
               verify: bool = False) -> DataFrame:
    """Findings of any frame with a path and a text column, batch or streaming.

    One narrow stage without a shuffle; rows are not deduplicated (see ``dedup``).  ``keep``
    carries further input columns along, ``context=None`` leaves the context lines empty.  A text
    without a path is scanned under the empty one.
    """
    pack = pack or builtin_pack()
    columns = dict.fromkeys([path, text, *([commit] if commit else []), *keep])
    named = df.select(*columns).withColumn(path, F.coalesce(F.col(path), F.lit("")))
    matches = rule_matches(gate_paths(named, pack, path), pack, text, keyless, markers, context)
    return as_findings(gate_matches(matches, pack), path, commit, verify, keep)


def scan_composite(df: DataFrame, pack: RulePack, path: str = "path", text: str = "content") -> DataFrame:
    """``scan_table`` in which the rules' required companions are honoured."""
    named = df.select(path, text).withColumn(path, F.coalesce(F.col(path), F.lit("")))
    return as_findings(gate_matches(composite_matches(gate_paths(named, pack, path), pack, text), pack), path)


def scan_files(files: DataFrame, pack: RulePack | None = None, max_bytes: int = MAX_FILE_BYTES,
               **options) -> DataFrame:
    """Findings of a (path, length, content binary) frame, gated and deduplicated."""
    pack = pack or builtin_pack()
    readable = files_as_text(gate_paths(files, pack), max_bytes)
    return dedup(scan_table(readable, pack, **options))


def files_scanned(files: DataFrame, pack: RulePack | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """How many files are handed to the scanner: after the path gates, before their content is seen."""
    return (gate_paths(gate_files(files, max_bytes=max_bytes), pack or builtin_pack())
            .agg(F.count("*").alias("files_scanned")))


def scan_image_files(files: DataFrame, pack: RulePack | None = None, **options) -> DataFrame:
    """An extracted image: only the size and image extension gates, no deduplication."""
    kept = gate_image_files(files).withColumn("content", readable_text(F.col("content")))
    return scan_table(kept, pack, **options)


def scan_archives(archives: DataFrame, pack: RulePack | None = None, max_bytes: int = MAX_IMAGE_BYTES,
                  codec: str | None = None, **options) -> DataFrame:
    """Findings of image archives, with ``image`` and ``layer`` and the tag ``docker-layer``.

    What could not be read is in ``archive_errors``; ``codec`` is as in ``expand_archives``.
    """
    files = expand_archives(archives, max_bytes, codec=codec).filter(F.col("path").isNotNull() & F.col("error").isNull())
    found = scan_image_files(files, pack, keep=("image", "layer"), **options)
    return found.withColumn("tags", F.array_append("tags", "docker-layer"))


def scan_archives_distinct(archives: DataFrame, pack: RulePack | None = None, max_bytes: int = MAX_IMAGE_BYTES,
                           manifest: DataFrame | None = None, codec: str | None = None, **options) -> DataFrame:
    """``scan_archives`` in which a layer that stands in many images is opened and matched once.

    Findings of a layer go back to every place where it stands; a base layer of very many images is spread by salt.  ``manifest``
    is the archives' ``layer_manifest``, where one is kept; else it is made and written to the shared folder.
    """
    manifest = materialized(layer_manifest(archives, max_bytes, codec)) if manifest is None else manifest
    files = expand_layers(archives, one_place_each(manifest), max_bytes, codec).filter(F.col("path").isNotNull() & F.col("error").isNull())
    found = scan_image_files(files.drop("layer"), pack, keep=("digest",), **options)
    places = manifest.filter(F.col("place").isNotNull()).select("image", "layer", "place", "digest")
    placed = salted_join(places, found, "digest", ["image", "place"]).drop("digest", "place")
    return placed.select(*[c for c in found.columns if c != "digest"], "image", "layer").withColumn("tags", F.array_append("tags", "docker-layer"))


def layer_reuse(manifest: DataFrame) -> DataFrame:
    """(digest, layer, length, places, images) of each different layer: in how many places and images it stands; ``layer`` is the first of its names."""
    return manifest.filter(F.col("place").isNotNull()).groupBy("digest").agg(
        F.min("layer").alias("layer"), F.max("length").alias("length"), F.count("*").alias("places"), F.countDistinct("image").alias("images"))


def archive_metrics(archives: DataFrame, max_bytes: int = MAX_IMAGE_BYTES, codec: str | None = None) -> DataFrame:
    """(image, layers_scanned, files, errors) for every image, also one without layers, in one pass without file contents.

    A layer counts when it is opened, whether or not it can be read.
    """
    rows = expand_archives(archives, max_bytes, bodies=False, codec=codec)
    good = F.col("error").isNull()
    return rows.groupBy("image").agg(
        F.count_if(good & F.col("layer").isNotNull() & F.col("path").isNull()).alias("layers_scanned"),
        F.count_if(good & F.col("path").isNotNull()).alias("files"), F.count_if(~good).alias("errors"))


def archive_errors(archives: DataFrame, max_bytes: int = MAX_IMAGE_BYTES, codec: str | None = None) -> DataFrame:
    """(image, layer, path, error) of everything that could not be read."""
    rows = expand_archives(archives, max_bytes, bodies=False, codec=codec)
    return rows.filter(F.col("error").isNotNull()).select("image", "layer", "path", "error")


def scan_roots(roots: list[DataFrame], pack: RulePack | None = None, **options) -> DataFrame:
    """Several (path, content) frames, each deduplicated on its own, appended."""
    scans = [dedup(scan_table(root, pack, **options)) for root in roots]
    union = scans[0]
    for scan in scans[1:]:
        union = union.unionByName(scan)
    return union


def after_scan(findings: DataFrame, severities: list[str] | None = None, baseline: DataFrame | None = None,
               responses: DataFrame | None = None, status: str = "") -> DataFrame:
    """What follows a scan, in order: severity filter, baseline, verification."""
    left = new_findings(filter_severity(findings, severities or []), baseline)
    return left if responses is None else verify_findings(left, responses, status)
