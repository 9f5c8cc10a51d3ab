"""Queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.llm import (bpe, decontaminate, divergence, exact_dedup, langid, lm_score, quality, secret_index, simhash, token_files,
                         url_rules, variants, warc)
from keysift.sources.staging import Staging


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.annotate(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("bigint"), "kept",
                        F.col("digest").alias("text_sha256"))


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"),
                                        keep=["doc_id"])
    n_hit = F.expr("aggregate(found.hits, 0L, (n, x) -> n + x.end - x.start)")
    return found.select("row.doc_id", "found.n_words", n_hit.alias("n_hit"),
                        F.size("found.items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"), "found.spans")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark, "warc")
    index = warc.write_archives(_table(spark, folder, "pages"), staging)
    records = warc.read_records(index, staging.path("archives"))
    read = F.col("record_type") == "response"
    return records.select(F.col("id").alias("page_id"),
                          F.when(read, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                          F.when(read, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
                          "record_type", "refers_to")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark, "tokens")
    written = token_files.write_tokens(_table(spark, folder, "documents"), staging)
    files = token_files.list_files(spark, staging.path("tokens")).withColumn("name", F.substring_index("file", "/", -1))
    files = files.join(written.select(F.col("file").alias("name")).distinct(), "name", "left_semi")
    counted = token_files.count_tokens(files.select("file", "bytes"), staging)
    return (counted.select(F.substring_index("file", "/", -1).alias("file"), "number", "n_tokens")
            .join(written, ["file", "number"]).select(F.col("id").alias("doc_id"), "n_tokens"))


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = url_rules.judge(_table(spark, folder, "pages"), _table(spark, folder, "labels"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "mined")


def url_rules_learnt(spark: SparkSession, folder: str) -> DataFrame:
    """All pages judged by rules mined from labels that follow their URLs' tokens (the given labels do not): bad are Spanish pages with a query, and
    mobile ones that end in .html."""
    pages, url = _table(spark, folder, "pages"), F.coalesce(F.col("url"), F.lit(""))
    bad = (url.contains("/es/") & url.contains("?")) | (url.contains("://m.") & url.endswith(".html"))
    labels = pages.select(F.col("page_id").alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"))
    found = url_rules.judge(pages, labels, rules=())
    return found.select(F.col("id").alias("page_id"), "host", "path", "verdict", "mined", F.round("confidence", 6).alias("confidence"))


def op6_secret_index(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_index.scan(_table(spark, folder, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in secret_index.BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(secrets, x -> x.kind = '{r.kind}'))").cast("bigint").alias(f"n_{r.kind}")
              for r in secret_index.BASE]
    return found.select("row.doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    def joined(name):
        return F.sha2(F.array_join(F.col(name).cast("array<string>"), " ").cast("binary"), 256)

    coded = bpe.encode(_table(spark, folder, "documents"), keep=["doc_id"], offsets=True, decoded=True)
    return coded.select("row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"), joined("ids").alias("ids_sha256"),
                        F.sha2("decoded_bytes", 256).alias("decoded_sha256"),
                        F.xxhash64("starts", "ends").alias("offsets_hash"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = langid.held_out(docs["doc_id"], 4, 2)
    model = langid.fit(docs.filter(~held & docs["doc_id"].isNotNull()))
    found = langid.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = langid.held_out(docs["doc_id"], 5, 0)
    model = quality.fit(docs.filter(~held), _table(spark, folder, "labels"))
    found = quality.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return lm_score.score_documents(docs, langid.held_out(docs["doc_id"], 7, 2)).withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, folder, "documents"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(_table(spark, folder, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_url_rules": op5_url_rules,
    "url_rules_learnt": url_rules_learnt,
    "op6_secret_index": op6_secret_index,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_lm_scores": op11_lm_scores,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                          min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
             r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to FROM r""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_spelling_variants": """
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS step),
             found AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
             runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL),
             coded AS (SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: ord(x)) AS points FROM runs),
             hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(points,
                lambda p: CASE WHEN p < 128 THEN [CAST(p AS BIGINT)] ELSE [192 + p // 64, 128 + p % 64] END))),
                lambda c, b: xor(step[xor(c, b) % 256 + 1], c // 256))) AS h FROM coded, crc),
             spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
             w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
             d AS (SELECT word, left(word, i) || '*' || substr(word, i + 2) AS skip, left(word, i) || substr(word, i + 2) AS rest
                   FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
             near AS (SELECT a.word, b.word AS other FROM d a JOIN d b USING (skip) WHERE a.word <> b.word
                      UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
             best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, encode(other)) AS form, max(o.n) AS form_n
                      FROM near JOIN w o ON o.word = other GROUP BY near.word),
             forms AS (SELECT w.word, form, form_n FROM w JOIN best USING (word) WHERE form_n >= 10 * n),
             chain AS (SELECT word, word AS here, 0 AS step FROM w UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.here)
        SELECT w.word, forms.form, (SELECT max_by(here, step) FROM chain WHERE chain.word = w.word) AS root, w.n,
               coalesce(n_near, 0) AS n_near, forms.form_n
        FROM w LEFT JOIN best USING (word) LEFT JOIN forms ON forms.word = w.word""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
             found AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
             c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM found GROUP BY ALL),
             kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
             l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
             g AS (SELECT DISTINCT lang, source FROM d),
             gn AS (SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(c.n) FILTER (WHERE kept.term IS NOT NULL), 0) AS n
                    FROM g LEFT JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
                    LEFT JOIN kept ON kept.lang = c.lang AND kept.term = c.term GROUP BY g.lang, g.source),
             p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS c,
                          1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (gn.n + gn.v) AS p,
                          1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 1)) // (l.n + l.v) AS q
                   FROM gn JOIN kept ON kept.lang = gn.lang JOIN l ON l.lang = gn.lang
                   LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
             pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
                       FROM gn a JOIN gn b ON b.lang = a.lang AND b.source <> a.source
                       LEFT JOIN (SELECT s.lang, s.source, o.source AS item, sum(((s.p - o.p) * (s.p - o.p)) // o.p) AS value
                                  FROM p s JOIN p o ON o.lang = s.lang AND o.term = s.term AND o.source <> s.source GROUP BY ALL) x
                       ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
             rows AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
                      UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
             ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM rows)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
