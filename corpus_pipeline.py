"""The training-data pipeline: five stages, each written as Parquet and read again by the next.

Language identification, exact deduplication, near deduplication, benchmark decontamination, encoding.  Every stage
works on all that the one before it kept.  The first four return the columns of ``documents``; the last adds the token ids.

*Defined results.*  A null or empty text, or one without a letter, has no language and goes in the first stage.  Of equal texts the row with the largest doc_id
stays (null ids last), of a group of near copies the one with the smallest; rows equal in id and text are one after the second stage.  Very long texts are
processed whole.  A null id is kept like any other.  Further columns of ``documents``, whatever their names, come through all stages; ``ids``, ``n_tokens`` and
``lossless`` are replaced by the last.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.llm import bpe, decontaminate, exact_dedup, langid, simhash
from keysift.sources.staging import Staging

#: A language must be likelier than all others together.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter and whose language is clear; learnt from the documents that are not held out."""
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"], 4, 2) & docs["doc_id"].isNotNull()))
    found = langid.predict(docs, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the number of these, and whether decoding gives back the text.

    Columns of these names that a document already has are replaced.
    """
    coded = bpe.encode(docs, decoded=True)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("ids", "n_tokens", "lossless")]
    same = F.col("decoded_bytes") == F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")
    return coded.select(*kept, "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("lossless"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated),
          ("encoding", encoded)]
#: Neither the language model nor fingerprints can be expressed in SQL; tests/llm/test_queries.py holds all five stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = staging.write(stage(spark, docs, sf_dir), name)
        if i:
            staging.drop(STAGES[i - 1][0])
    return docs
