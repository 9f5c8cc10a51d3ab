"""Token files: blocks of separators, empty tables, and the registered query."""

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from keysift.llm import bpe, token_files
from keysift.llm.catalog import QUERIES
from keysift.sources.staging import Staging


def test_a_block_of_separators_comes_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 7)
    ids = [7] * 100 + [1, 2, 7, 3] + [7] * 50 + [4]
    np.array(ids, "<u2").tofile(tmp_path / "0.bin")
    got = token_files.count_tokens(token_files.list_files(spark, f"file://{tmp_path}"), Staging(spark, "t"), separator=7, block=120).collect()
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 7:
            want.append((len(want), start, i - start, True))
            start = i + 1
    want.append((len(want), start, len(ids) - start, False))
    assert sorted((r["number"], r["start"], r["n_tokens"], r["closed"]) for r in got) == want


def test_folders_without_files(spark, tmp_path):
    assert token_files.list_files(spark, f"file://{tmp_path}/none").count() == 0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op4_token_counts"](spark, str(tmp_path)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, i, "f") for i, t in enumerate(["Hello there, world!", None, "", "a" * 5000, "<|endoftext|>", "é€😀", "Hello there, world!"])] + [(3, "again", 9, "f")]
    spark.createDataFrame(rows, "doc_id long, text string, number int, file string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    import base64
    file, pattern = bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r["doc_id"], r["n_tokens"]) for r in QUERIES["op4_token_counts"](spark, str(tmp_path)).select("doc_id", F.col("n_tokens")).collect())
    assert got == sorted((i, len(plain.encode_ordinary(t or ""))) for i, t, *_ in rows)
