"""Every registered query: a callable (spark, folder) -> DataFrame over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import corpus as cp
from keysift.functions import (adjusted_entropy, clip_match, has_symbol, is_all_lowercase, is_base64, is_hex,
                               is_one_case, is_sequential_or_repeated, redact)
from keysift.operators import (allow, baseline, composite, detect, findings as fnd, gates, history, merkle,
                               verification as ver)
from keysift.plans import (after_scan, archive_errors, archive_metrics, files_scanned, layer_reuse, scan_archives,
                           scan_archives_distinct, scan_composite, scan_files, scan_image_files, scan_roots, scan_table)
from keysift.rules import builtin_pack, pack_from_dict, rejected_rules_frame, rules_frame
from keysift.sinks import report
from keysift.sources import (files_as_text, layer_manifest, materialized, materialized_together, read_files, shared_folder,
                             skipped_files)
from keysift.streaming import report_once, suppress_known, window_counts, write_stream

COMPOSITE = {"rules": [
    {"id": "github-pat", "regex": "ghp_[0-9a-zA-Z]{36}", "keywords": ["ghp_"], "severity": "high", "entropy": 3.5,
     "required": [{"id": "github-pat-2", "regex": r"(?:middle|sk_live_[0-9a-zA-Z]{24})", "withinLines": 1}]},
    {"id": "stripe-live-secret", "regex": "sk_live_[0-9a-zA-Z]{24,34}", "keywords": ["sk_live_"],
     "severity": "critical", "entropy": 3.5, "required": [{"id": "github-pat", "withinLines": 0}]},
    {"id": "generic-secret", "regex": r"(?:secret|password)\s*[=:]+\s*[\"']?[a-zA-Z0-9]{8,}", "keywords":
     ["secret", "password"], "severity": "medium", "entropy": 3.0},
]}
KEYLESS = {"rules": [
    {"id": "twilio-api-key", "regex": "SK[a-f0-9]{32}", "severity": "high", "entropy": 3.0},
    {"id": "stripe-live-secret", "regex": "sk_live_[0-9a-zA-Z]{24,34}", "severity": "critical", "entropy": 3.5},
    {"id": "bare", "regex": "npm_[A-Za-z0-9]{36}"}]}


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _six(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def _plain(findings: DataFrame, *extra: str) -> DataFrame:
    """Findings as scalar columns."""
    return findings.select("rule_id", "description", "match", "file", _long("line"), _long("column"), "severity",
                           F.array_join("tags", ",").alias("tags"), _six("entropy").alias("entropy"),
                           "fingerprint", F.array_join("context", "\n").alias("context"), *extra)


def _docs(spark, folder):
    return cp.document_corpus(spark, folder)


def _found(spark, folder, context: int | None = None, **options) -> DataFrame:
    return scan_table(_docs(spark, folder), context=context, **options)


def _matches(spark, folder, context: int | None = None, markers=None, pack=None) -> DataFrame:
    """Raw matches with rule ids, before any gate."""
    pack = pack or builtin_pack()
    raw = detect.rule_matches(_docs(spark, folder), pack, "content", markers=markers, context=context)
    return fnd.with_rule_metadata(raw, pack)


def _old_new(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Findings of the second snapshot as baseline, and of the third."""
    old, new = (fnd.dedup(scan_table(cp.snapshot(spark, folder, step), context=None)) for step in (2, 3))
    return baseline.baseline_rows(old), new


# -- sources ------------------------------------------------------------------------------

def q_scan_table(spark, folder):
    return _plain(fnd.dedup(_found(spark, folder, context=2)))


def q_scan_files(spark, folder):
    return _plain(scan_files(cp.file_corpus(spark, folder)))


def q_scan_image_dir(spark, folder):
    return _plain(scan_image_files(cp.file_corpus(spark, folder)))


def q_scan_history(spark, folder):
    found = history.scan_history(cp.commit_corpus(spark, folder), builtin_pack(), context=2)
    return _plain(found, "commit")


def q_scan_commit_range(spark, folder):
    commits = history.commit_range(cp.commit_corpus(spark, folder), after=13, upto=32)
    return _plain(history.scan_history(commits, builtin_pack(), context=2), "commit")


def q_scan_history_incremental(spark, folder):
    """Two runs over growing commits that share a memo; the second matches only what the first has not seen."""
    commits, memo = cp.commit_corpus(spark, folder), f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"
    history.scan_history_incremental(history.commit_range(commits, upto=29), builtin_pack(), memo, context=2)
    return _plain(history.scan_history_incremental(commits, builtin_pack(), memo, context=2), "commit")


def q_commit_prefixes(spark, folder):
    """The allowed commits as a table of prefixes, which also holds ten thousand others."""
    other = spark.range(10_000).select(F.left(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 20 + 12).cast("int")).alias("prefix"))
    listed = other.unionByName(spark.createDataFrame([(c,) for c in [*_allowed_commits(), ""]], "prefix string"))
    kept = history.drop_listed_commits(cp.commit_corpus(spark, folder), listed)
    return kept.groupBy("commit").agg(F.count("*").alias("files"))


def q_commits_scanned(spark, folder):
    return history.commits_scanned(cp.commit_corpus(spark, folder))


def q_commit_allowlist(spark, folder):
    commits = cp.commit_corpus(spark, folder)
    pack = pack_from_dict({"allowlist": [{"commits": _allowed_commits()}]})
    kept = allow.drop_allowed_commits(commits, pack)
    return kept.groupBy("commit").agg(F.count("*").alias("files"))


def _allowed_commits() -> list[str]:
    """One whole hash and one prefix (fixed values: digests of commit-1-0 and commit-2-1)."""
    import hashlib
    return [hashlib.sha256(b"commit-1-0").hexdigest()[:40], hashlib.sha256(b"commit-2-1").hexdigest()[:9]]


def q_scan_changed(spark, folder):
    """Only the documents whose last snapshot differs from the one before."""
    old, new = (cp.snapshot(spark, folder, step) for step in (2, 3))
    changed = (new.join(old.select("path", F.sha2("content", 256).alias("before")), "path")
               .filter(F.sha2("content", 256) != F.col("before")))
    return _plain(scan_table(history.only_changed(new, changed)))


def _changes(spark, folder) -> DataFrame:
    old, new = (merkle.tree(merkle.file_digests(cp.snapshot(spark, folder, step))) for step in (2, 3))
    return merkle.changed_paths(*materialized_together(old, new))


def q_changed_files(spark, folder):
    """What differs between the last two snapshots, found through digests of folders."""
    return _changes(spark, folder)


def q_scan_changed_manifest(spark, folder):
    """``scan_changed`` by the trees of both snapshots."""
    changed = _changes(spark, folder).filter("change <> 'removed'")
    return _plain(scan_table(history.only_changed(cp.snapshot(spark, folder, 3), changed)))


IMAGE_LIMIT = 4_000_000


BASES = 4


def _archives(spark, folder, based: bool = False, codec: str | None = None) -> DataFrame:
    """Documents packed into image archives, twenty per image and ten per layer; some of either are broken, cut, empty or too large.

    ``based`` images also have one of ``BASES`` base layers, made of the documents in the first layers of all. With a ``codec``
    each archive is compressed as a whole.
    """
    import gzip
    import io
    import tarfile

    import pandas as pd
    import pyarrow as pa

    def tar(entries):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as archive:
            for name, body in entries:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                archive.addfile(info, io.BytesIO(body))
        return out.getvalue()

    def pack(frame):
        frame = frame.sort_values("doc_id")
        layers = []
        image = int(frame["doc_id"].iloc[0]) // 20
        if base := bases.get(int(frame["kind"].iloc[0])):
            layers.append((f"base{image % BASES}/layer.tar", tar(base)))
        for number, rows in frame.groupby(frame["doc_id"] // 10):
            layer = tar(zip(rows["path"], rows["content"]))
            layer = gzip.compress(layer) if number % 2 else layer
            if number % 7 == 3:
                layer = b"\x1f\x8bnot compressed at all"
            elif number % 7 == 5:
                layer = tar(zip(rows["path"], rows["content"]))[:520]  # ends within the first file
            layers.append((f"{number}/layer.tar", layer))
        layers.append(("manifest.json", b"{}"))
        if image % 5 == 2:
            layers.insert(0, ("large.tar", bytes(IMAGE_LIMIT + 1)))
        whole = b"no archive" if image % 11 == 4 else b"" if image % 11 == 6 else tar(layers)
        whole = pa.Codec(codec).compress(whole, asbytes=True) if codec else whole
        return pd.DataFrame([(frame["image"].iloc[0], whole)], columns=["path", "content"])

    docs = cp.document_corpus(spark, folder, spread=False).select(
        "doc_id", "path", F.encode("content", "UTF-8").alias("content"), F.floor(F.col("doc_id") / 20).alias("number"))
    bases: dict[int, list] = {}
    if based:  # the same few documents for every table; they go out with the function, not once per image through the shuffle
        first = docs.filter(F.col("doc_id") < 10 * BASES).withColumn("kind", F.floor(F.col("doc_id") / 10))
        for row in sorted(first.collect(), key=lambda r: r["doc_id"]):
            bases.setdefault(row["kind"], []).append((row["path"], row["content"]))
    docs = docs.select("doc_id", "path", "content", (F.col("number") % BASES).alias("kind"),
                       F.concat(F.lit("image_"), F.col("number").cast("string")).alias("image"))
    return docs.groupBy("image").applyInPandas(pack, "path string, content binary")


def q_scan_archives(spark, folder):
    return _plain(scan_archives(_archives(spark, folder), max_bytes=IMAGE_LIMIT), "image", "layer")


def q_scan_archives_distinct(spark, folder):
    """Archives on shared base layers, kept compressed and listed by path only; every different layer is opened once."""
    images = _archives(spark, folder, based=True, codec="zstd")
    paths = write_files(images, f"{shared_folder(spark)}/images-{uuid.uuid4().hex}", whole=True)
    found = scan_archives_distinct(paths.select("path"), max_bytes=IMAGE_LIMIT, codec="zstd")
    return _plain(found, F.regexp_extract("image", r"([^/]*)$", 1).alias("image"), "layer")


def q_layer_reuse(spark, folder):
    """The base layers and how many images stand on each, and all other layers, each in one place."""
    reuse = layer_reuse(layer_manifest(_archives(spark, folder, based=True), IMAGE_LIMIT))
    return reuse.select("layer", "places", "images")


def q_archive_metrics(spark, folder):
    return archive_metrics(_archives(spark, folder), IMAGE_LIMIT)


def q_archive_errors(spark, folder):
    """How many errors each layer has, and of what kind."""
    errors = archive_errors(_archives(spark, folder), IMAGE_LIMIT)
    kind = F.when(F.col("error").startswith("skipping large file"), "large").otherwise("unreadable")
    return errors.groupBy("image", "layer", kind.alias("kind")).agg(F.count("*").alias("errors"))


def q_skipped_files(spark, folder):
    """Files that a scan leaves out, with the reason."""
    return skipped_files(cp.file_corpus(spark, folder), builtin_pack(), max_bytes=20_000)


def q_scan_tree(spark, folder):
    """The documents written as one file each to the shared folder, listed, gated, read and scanned."""
    base = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    write_files(cp.file_corpus(spark, folder), base).count()
    texts = files_as_text(read_files(spark, base, builtin_pack(), relative=True))
    return _plain(fnd.dedup(scan_table(texts)))


def write_files(files: DataFrame, base: str, whole: bool = False) -> DataFrame:
    """Each row's content as a file under ``base``; (path, length) of what was written, the ``whole`` path or that under ``base``."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(base if ":" in base.split("/", 1)[0] else "file://" + base)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(content)
            shown = [f"{base}/{p}" for p in batch.column("path").to_pylist()] if whole else batch.column("path")
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string()), pa.array([len(c) for c in batch.column("content").to_pylist()])],
                                             ["path", "length"])
    return materialized(files.select("path", "content").mapInArrow(write, "path string, length long"))


def q_scan_union_roots(spark, folder):
    return _plain(scan_roots([cp.document_corpus(spark, folder).select("path", "content"),
                              cp.conversation_corpus(spark, folder), cp.page_corpus(spark, folder)]))


def q_scan_custom_rule(spark, folder):
    roots = [cp.document_corpus(spark, folder).select("path", "content"), cp.page_corpus(spark, folder)]
    return _plain(scan_roots(roots, cp.token_pack()))


def q_rules_table(spark, folder):
    """The rules with the number of documents that each is a candidate for."""
    pack = builtin_pack()
    counts = (detect.candidate_rules(_docs(spark, folder), pack, "content")
              .groupBy("rule_idx").agg(F.count("*").alias("documents")))
    rules = rules_frame(spark, pack).join(counts, "rule_idx", "left")
    return rules.select("id", "description", "severity", F.array_join("tags", ",").alias("tags"), "entropy",
                        F.array_join("keywords", ",").alias("keywords"),
                        F.coalesce("documents", F.lit(0)).alias("documents"))


def q_rule_defaults(spark, folder):
    """Matches per rule with severity and threshold as declared and after defaults."""
    pack = pack_from_dict(KEYLESS)
    declared = rules_frame(spark, pack, declared=True).select(
        F.col("id").alias("rule_id"), F.col("severity").alias("declared_severity"),
        F.col("entropy").alias("declared_entropy"))
    counts = (_matches(spark, folder, pack=pack).groupBy("rule_id", "severity", "threshold")
              .agg(F.count("*").alias("matches")))
    return counts.join(declared, "rule_id")


# -- gates ----------------------------------------------------------------------------------

def q_gate_files(spark, folder):
    kept = gates.gate_files(cp.file_corpus(spark, folder).drop("content"), max_bytes=20_000)
    return kept.select("doc_id", "path", "length")


def q_gate_path_allowlist(spark, folder):
    return gates.gate_paths(_docs(spark, folder), builtin_pack()).select("doc_id", "path")


def q_gate_binary(spark, folder):
    content = F.col("content")
    return cp.file_corpus(spark, folder).select(
        "doc_id", gates.has_nul(content).alias("has_nul"), gates.is_control_heavy(content).alias("control_heavy"),
        gates.is_binary(content).alias("is_binary"), (~gates.is_binary(content)).alias("is_text"))


def q_gate_image_ext(spark, folder):
    return gates.gate_image_files(cp.file_corpus(spark, folder)).select("doc_id", "path")


def q_files_scanned(spark, folder):
    return files_scanned(cp.file_corpus(spark, folder))


# -- detection --------------------------------------------------------------------------------

def q_candidate_rules(spark, folder):
    pack = builtin_pack()
    found = detect.candidate_rules(_docs(spark, folder), pack, "content")
    return found.select("doc_id", fnd.rule_metadata(pack, F.col("rule_idx"))["rule_id"].alias("rule_id"))


def q_rule_matches(spark, folder):
    return _matches(spark, folder).select("doc_id", "rule_id", "match")


def q_match_offsets(spark, folder):
    return _matches(spark, folder).select("doc_id", "rule_id", _long("start"), _long("end"), "match")


def q_match_position(spark, folder):
    return _matches(spark, folder).select("doc_id", "rule_id", _long("start"), _long("line"), _long("column"))


def q_match_context(spark, folder):
    return _matches(spark, folder, context=2).select(
        "doc_id", "rule_id", _long("start"), F.array_join("context", "\n").alias("context"))


def q_context_window(spark, folder):
    """Lines around the start of a match another way: documents as rows of lines, five asked per match."""
    lines = _docs(spark, folder).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    found = _matches(spark, folder).select("doc_id", "rule_id", "start", "line")
    asked = found.withColumn("at", F.explode(F.sequence(F.col("line") - 3, F.col("line") + 1)))
    near = asked.join(lines, ["doc_id", "at"]).groupBy("doc_id", "rule_id", "start", "line")
    around = F.array_sort(F.collect_list(F.struct("at", "text")))  # five entries at most
    return near.agg(F.array_join(F.transform(around, lambda e: e["text"]), "\n").alias("context")).select(
        "doc_id", "rule_id", _long("start"), _long("line"), "context")


def q_entropy_gate(spark, folder):
    kept = fnd.entropy_gate(fnd.with_entropy(_matches(spark, folder)))
    return kept.select("doc_id", "rule_id", "match", _six("entropy").alias("entropy"), "threshold")


def q_rule_allowlist(spark, folder):
    found = _matches(spark, folder)
    allowed = allow.is_rule_allowed(F.col("match"), F.col("rule_idx"), builtin_pack())
    return found.select("doc_id", "rule_id", "match", allowed.alias("allowed"))


def q_global_allowlist(spark, folder):
    found = _matches(spark, folder)
    return found.select("doc_id", "rule_id", "match",
                        allow.is_globally_allowed(F.col("match"), builtin_pack()).alias("allowed"))


def q_stopwords(spark, folder):
    found = _matches(spark, folder)
    return found.select("doc_id", "rule_id", "match",
                        *[allow.has_stopword(F.col("match"), w).alias(w) for w in ("example", "placeholder", "a")])


def q_inline_allow(spark, folder):
    found = _matches(spark, folder, markers=allow.DEFAULT_MARKERS)
    return found.select("doc_id", "rule_id", "match", "inline_allow")


def q_scan_no_keywords(spark, folder):
    return _plain(scan_table(_docs(spark, folder), pack_from_dict(KEYLESS)))


def q_composite_rules(spark, folder):
    return _plain(scan_composite(_docs(spark, folder), pack_from_dict(COMPOSITE)))


# -- scalar functions ---------------------------------------------------------------------------

def _strings(spark, folder) -> DataFrame:
    """Strings to score: every match, and every document's digest in several spellings."""
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    spellings = F.array(digest, F.upper(digest), F.translate(digest, "abcdef", "012345"),
                        F.substring(F.translate(digest, "abcdef", "012345"), 1, 18),
                        F.concat(F.lit("0123456789abcdef"), F.substring(digest, 1, 8)),
                        F.concat(F.lit("ABCDEF012345678"), F.substring(digest, 1, 2)),
                        F.repeat(F.substring(digest, 1, 1), 12), F.substring(digest, 1, 1), F.lit(""),
                        F.concat(F.substring(digest, 1, 6), F.lit("=="), F.lit("é\U0001f600")),
                        F.concat(F.translate(F.substring(digest, 1, 10), "abc", "XYZ"), F.lit("==")))
    made = _docs(spark, folder).select(F.explode(spellings).alias("s"))
    return _matches(spark, folder).select(F.col("match").alias("s")).unionByName(made)


def q_entropy(spark, folder):
    value = adjusted_entropy(F.col("s"))
    return _strings(spark, folder).select("s", F.when(value > float("-inf"), _six(value)).alias("entropy"))


def q_entropy_flags(spark, folder):
    s = F.col("s")
    return _strings(spark, folder).select(
        "s", is_hex(s).alias("is_hex"), is_sequential_or_repeated(s).alias("sequential"),
        is_one_case(s).alias("one_case"), is_base64(s).alias("is_base64"),
        is_all_lowercase(s).alias("lowercase"), has_symbol(s).alias("has_symbol"))


def q_entropy_penalty(spark, folder):
    value = adjusted_entropy(F.col("s"), ("hex", "base64", "lowercase", "nosymbols", "other", "hex"))
    return _strings(spark, folder).select("s", F.when(value > float("-inf"), _six(value)).alias("entropy"))


def q_fingerprint(spark, folder):
    return _found(spark, folder).select("rule_id", "file", _long("line"), _long("column"), "fingerprint")


def q_stable_fingerprint(spark, folder):
    found = baseline.with_stable_fingerprint(_found(spark, folder))
    return found.select("rule_id", "file", _long("line"), "stable_fingerprint")


def q_redact(spark, folder):
    return _strings(spark, folder).select("s", redact(F.col("s")).alias("redacted"))


def q_match_clip(spark, folder):
    return _strings(spark, folder).select("s", clip_match(F.col("s")).alias("clipped"))


def q_detect_provider(spark, folder):
    s = F.col("s")
    return _strings(spark, folder).select("s", ver.detect_provider(s).alias("provider"),
                                          ver.detect_provider(s, fixed=True).alias("provider_fixed"))


def q_provider_rule(spark, folder):
    provider = ver.detect_provider(F.col("s"))
    return _strings(spark, folder).select("s", ver.provider_rule(provider, F.col("s")).alias("rule_id"))


def q_verifiable(spark, folder):
    return (_found(spark, folder).groupBy("rule_id").agg(F.count("*").alias("findings"))
            .select("rule_id", "findings", ver.is_verifiable(F.col("rule_id")).alias("verifiable")))


# -- findings -------------------------------------------------------------------------------------

def q_dedup(spark, folder):
    """Each document scanned twice under the same path."""
    docs = _docs(spark, folder)
    twice = fnd.dedup(scan_table(docs.unionByName(docs), context=None))
    return twice.select("rule_id", "file", _long("line"), _long("column"), "fingerprint")


def q_dedup_late(spark, folder):
    """Each document scanned twice under the same path, the findings with their contexts."""
    docs = _docs(spark, folder)
    return _plain(fnd.dedup_late(scan_table(docs.unionByName(docs))))


def q_severity_counts(spark, folder):
    return fnd.severity_counts(_found(spark, folder))


def q_file_summary(spark, folder):
    found = fnd.file_summary(_found(spark, folder))
    return found.withColumns({c: F.col(c).cast("bigint") for c in found.columns if c != "file"})


def q_severity_filter(spark, folder):
    kept = fnd.filter_severity(_found(spark, folder), ["CRITICAL", "high"])
    return kept.select("rule_id", "file", "severity", "fingerprint")


def q_report_summary(spark, folder):
    return fnd.report_summary(_found(spark, folder), files_scanned(cp.file_corpus(spark, folder)),
                              history.commits_scanned(cp.commit_corpus(spark, folder)))


def q_commit_gate(spark, folder):
    """High and critical findings in files that a commit hook would look at."""
    kept = gates.gate_changed_files(_docs(spark, folder))
    return fnd.failed_gate(fnd.filter_severity(scan_table(kept, context=None), ["high", "critical"]))


# -- baseline ---------------------------------------------------------------------------------------

def q_baseline_rows(spark, folder):
    rows = baseline.baseline_rows(_found(spark, folder))
    return rows.withColumn("line", F.col("line").cast("bigint"))


def q_baseline_new(spark, folder):
    old, new = _old_new(spark, folder)
    return baseline.baseline_rows(baseline.new_findings(new, old)).withColumn("line", F.col("line").cast("bigint"))


def q_baseline_existing(spark, folder):
    old, new = _old_new(spark, folder)
    kept = baseline.existing_findings(new, old)
    return baseline.baseline_rows(kept).withColumn("line", F.col("line").cast("bigint"))


def q_baseline_resolved(spark, folder):
    old, new = _old_new(spark, folder)
    return baseline.resolved_findings(new, old).withColumn("line", F.col("line").cast("bigint"))


def q_baseline_roundtrip(spark, folder):
    """New findings against a baseline that was published twice and read back; readers get the last version."""
    old, new = _old_new(spark, folder)
    root = f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex}"
    baseline.publish_baseline(new, root)
    baseline.publish_baseline(old, root)
    left = baseline.new_findings(new, baseline.published_baseline(spark, root))
    return baseline.baseline_rows(left).withColumn("line", F.col("line").cast("bigint"))


def q_baseline_compare_bucketed(spark, folder):
    """``baseline_compare`` against a baseline that lies in buckets and is not moved."""
    old, new = _old_new(spark, folder)
    name = f"baseline_{uuid.uuid4().hex}"
    baseline.save_bucketed(old, name, f"{shared_folder(spark)}/{name}", buckets=8)
    return baseline.compare_with_bucketed(new, name).select(
        "rule_id", "fingerprint", "match", "file", _long("line"), "severity", "description", "status")


def _compared(spark, folder, key="fingerprint") -> DataFrame:
    old, new = _old_new(spark, folder)
    return baseline.compare_with_baseline(new, old, key)


def q_baseline_compare(spark, folder):
    return _compared(spark, folder).select(
        "rule_id", "fingerprint", "match", "file", _long("line"), "severity", "description", "status")


def q_baseline_compare_stable(spark, folder):
    """By line-independent key: moved secrets stay existing."""
    compared = _compared(spark, folder, "stable_key")
    return compared.groupBy("file", "rule_id", "status").agg(F.count("*").alias("findings"))


def q_baseline_stats(spark, folder):
    return baseline.baseline_statistics(_compared(spark, folder))


def q_baseline_totals(spark, folder):
    return baseline.baseline_totals(_compared(spark, folder))


# -- verification -------------------------------------------------------------------------------------

def _verified(spark, folder, status="") -> DataFrame:
    found = materialized(_found(spark, folder, verify=True))
    return ver.verify_findings(found, cp.responses(found), status)


def q_verify_classify(spark, folder):
    found = materialized(_found(spark, folder))
    asked = cp.responses(found).join(
        found.select("rule_id", "match", F.sha2("match", 256).alias("secret_sha256")).distinct(),
        ["rule_id", "secret_sha256"])
    outcome = ver.classify_response(F.col("rule_id"), F.col("match"), F.col("http_status"), F.col("body"),
                                    F.col("transport_error"))
    judged = asked.select("rule_id", "match", outcome.alias("o"))
    return judged.select("rule_id", "match", *[F.col("o")[c].alias(c) for c in
                                               ("status", "account", "message", "kind", "error")])


def q_verify_join(spark, folder):
    return _verified(spark, folder).select("fingerprint", "verified", "account", "message", "verification_status")


def q_verify_status_filter(spark, folder):
    return _verified(spark, folder, "valid").select("fingerprint", "verified", "verification_status")


# -- reports --------------------------------------------------------------------------------------------

def q_report_json(spark, folder):
    metrics = report.report_metrics(_found(spark, folder), files_scanned(cp.file_corpus(spark, folder)))
    return metrics.select("findings", "files_scanned", "commits_scanned", "summary",
                          F.get_json_object("metrics", "$.summary").alias("json_summary"))


def q_sink_jsonl(spark, folder):
    """Findings written as JSON Lines and read back."""
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    report.write_jsonl(_found(spark, folder, context=2), path)
    back = spark.read.schema("rule_id string, match string, file string, line bigint, column bigint, "
                             "fingerprint string, context array<string>").json(path)
    return back.select("rule_id", "match", "file", "line", "column", "fingerprint",
                       F.array_join("context", "\n").alias("context"))


def _hot_docs(spark, folder) -> DataFrame:
    """Every second document as part of one file."""
    hot = F.when(F.col("doc_id") % 2 == 0, F.lit("hot/all.txt")).otherwise(F.col("path"))
    return _docs(spark, folder).select(F.explode(F.array(F.struct(hot.alias("path"), "content"))).alias("x")).select("x.*")


def q_findings_by_file(spark, folder):
    """Findings with their rank in the file, one file having half of them."""
    found = fnd.findings_by_file(fnd.dedup(scan_table(_hot_docs(spark, folder), context=None)))
    return found.select("file", "rule_id", _long("line"), _long("column"), "match", _long("rank"), _long("place"))


def q_report_document(spark, folder):
    """The report as one JSON object in many part files, taken apart again."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    report.write_json(scan_table(_hot_docs(spark, folder)), path)
    items = report.document_items(spark, path)
    back = report.parsed_items(items, "rule_id string, match string, file string, line bigint, column bigint, severity string, fingerprint string, context array<string>")
    return back.withColumn("context", F.array_join("context", "\n"))


def q_sarif_document(spark, folder):
    """The SARIF log in many part files, taken apart again."""
    path = f"{shared_folder(spark)}/sarif-{uuid.uuid4().hex}"
    report.write_sarif(scan_table(_hot_docs(spark, folder), context=None), path)
    shape = ("ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
             "region:struct<startLine:bigint,startColumn:bigint,snippet:struct<text:string>>>>>, partialFingerprints struct<primary:string>")
    back = report.parsed_items(report.document_items(spark, path), shape)
    place = F.col("locations")[0]["physicalLocation"]
    return back.select(F.col("ruleId").alias("rule_id"), "level", F.col("message.text").alias("message"), place["artifactLocation"]["uri"].alias("file"),
                       place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("column"),
                       place["region"]["snippet"]["text"].alias("snippet"), F.col("partialFingerprints.primary").alias("fingerprint"))


def q_sink_formats(spark, folder):
    """The findings written in every format by its name, and how many each file set holds."""
    found, rows = materialized(_found(spark, folder)), None
    for name in report.WRITERS:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        report.write_findings(found, path, name.upper())
        back = (report.document_items(spark, path) if name in ("json", "sarif") else spark.read.json(path) if name == "jsonl"
                else spark.read.options(header=True, multiLine=True, escape='"', sep="," if name == "csv" else "\t").csv(path))
        one = back.agg(F.lit(name).alias("format"), F.count("*").alias("findings"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


REJECTED = {"rules": [
    {"id": "looks-ahead", "regex": "token(?=x)", "keywords": ["token"]}, {"id": "unclosed", "regex": "([a-z]+", "keywords": ["password"]},
    {"id": "matches-nothing", "regex": "a*", "keywords": ["the"]}, {"id": "sound", "regex": "secret[0-9]+", "keywords": ["secret"]}]}


def q_rejected_rules(spark, folder):
    """Rules that are listed instead of run, with the number of documents that hold their keyword."""
    rejected = rejected_rules_frame(spark, pack_from_dict(REJECTED)).select("id", "regex", (F.length("reason") > 0).alias("has_reason"))
    held = [F.count_if(F.lower("content").contains(r["keywords"][0])).alias(r["id"]) for r in REJECTED["rules"]]
    counts = _docs(spark, folder).agg(*held).unpivot([], [F.col(f"`{r['id']}`") for r in REJECTED["rules"]], "id", "documents")
    return rejected.join(counts, "id")


def q_csv_rows(spark, folder):
    rows = report.csv_rows(_found(spark, folder), redact=True)
    return rows.withColumns({"Line": F.col("Line").cast("bigint"), "Column": F.col("Column").cast("bigint")})


def q_listing(spark, folder):
    rows = report.listing(_found(spark, folder))
    return rows.withColumns({"line": F.col("line").cast("bigint"), "column": F.col("column").cast("bigint")})


def q_sarif_results(spark, folder):
    rows = report.sarif_results(_found(spark, folder))
    return rows.select("rule_id", "file", _long("line"), _long("column"), "level", "message", "snippet",
                       "fingerprint", F.get_json_object("result", "$.level").alias("json_level"),
                       F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine")
                       .alias("json_line"))


def q_sarif_rules(spark, folder):
    rows = report.sarif_rules(_found(spark, folder))
    return rows.withColumn("tags", F.array_join("tags", ","))


# -- streams and plans --------------------------------------------------------------------------------------

def _timed(docs: DataFrame) -> DataFrame:
    """A time for every document, from its id."""
    return docs.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 1800))


def _stream_docs(spark, folder) -> DataFrame:
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(folder)
    return _timed(rows.select("doc_id", cp.planted(cp.planted_path("doc_id"), cp.plant("doc_id"))))


def _run_stream(spark, stream: DataFrame) -> DataFrame:
    """The stream over everything there is now, written out and read back."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def q_stream_scan(spark, folder):
    return _plain(_run_stream(spark, scan_table(_stream_docs(spark, folder))))


def q_stream_report_once(spark, folder):
    found = scan_table(_stream_docs(spark, folder), keep=("ts",), context=None)
    return _run_stream(spark, report_once(found)).select("rule_id", "file", "fingerprint")


def q_stream_suppress_known(spark, folder):
    """The last snapshot's findings are known; the stream brings the documents as they were before."""
    _, old = _old_new(spark, folder)
    found = scan_table(_stream_docs(spark, folder), context=None)
    return _run_stream(spark, suppress_known(found, old)).select("rule_id", "file", "fingerprint")


def q_findings_by_hour(spark, folder):
    found = scan_table(_timed(_docs(spark, folder)), keep=("ts",), context=None)
    return _stamped(window_counts(found))


def q_findings_by_sliding_hours(spark, folder):
    found = scan_table(_timed(_docs(spark, folder)), keep=("ts",), context=None)
    return _stamped(window_counts(found, width="2 hours", slide="1 hour"))


STREAM_PARTS, STREAM_DELAY = 4, 7200


def q_stream_window_counts(spark, folder):
    """Counts per closed hour of a stream that comes in four parts, each run going on from the one before.

    Every seventh document comes one part late, behind the watermark, and is left out; hours that the last watermark has not passed are not closed yet.
    """
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    found = scan_table(_timed(_docs(spark, folder)), keep=("ts", "doc_id"), context=None).select("doc_id", "ts", "severity")
    last = F.lit(_docs(spark, folder).agg(F.max("doc_id")).first()[0])
    part = F.floor(F.col("doc_id") * STREAM_PARTS / (last + 1)) + (F.col("doc_id") % 7 == 3).cast("int")
    parts = materialized(found.withColumn("part", part.cast("int")))
    schema = parts.drop("part").schema
    for k in range(STREAM_PARTS + 1):
        parts.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/in")
        counts = window_counts(spark.readStream.schema(schema).parquet(f"{base}/in"), delay=f"{STREAM_DELAY} seconds")
        write_stream(counts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _stamped(spark.read.schema(counts.schema).parquet(f"{base}/out"))


def _stamped(counts: DataFrame) -> DataFrame:
    return counts.select(*[F.unix_timestamp(c).alias(c) for c in ("window_start", "window_end")],
                         "severity", "findings")


def q_after_scan(spark, folder):
    """Severity, baseline and verification in the order of a run."""
    old, new = _old_new(spark, folder)
    old, new = materialized_together(old, new)
    left = after_scan(new, ["critical", "high"], old, cp.responses(new))
    return left.select("rule_id", "fingerprint", "severity", "verified", "account", "verification_status")


QUERIES = {name[2:]: query for name, query in sorted(globals().items()) if name.startswith("q_")}
