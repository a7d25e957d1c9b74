"""Token counts against the library, and the cache's work."""

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lethe.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(90001, None), (90002, ""), (90003, "a <|endoftext|> b  \n c"), (90004, "x" * 20_000), (90005, "same"), (90006, "same"), (90006, "same"), (90006, "other"), (None, "no id")]


def test_matches_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    everything = docs.union(spark.createDataFrame(ODD, docs.schema)).repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((i is None, i or 0), len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in map(tuple, everything.collect()))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(everything, PATH).collect())
    assert got == want


def test_the_cache_is_asked_first_and_grows(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    first = sorted(map(str, token_counts.count_tokens(docs, PATH, cache).collect()))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in ODD})
    encoded = []
    plain = token_counts.count_texts
    monkeypatch.setattr(token_counts, "count_texts", lambda texts, path: encoded.append(texts.count()) or plain(texts, path))
    again = token_counts.count_tokens(docs.union(spark.createDataFrame([(1, "new")], docs.schema)), PATH, cache)
    assert sorted(str(r) for r in again.collect() if r.doc_id != 1) == first
    assert encoded == [1]
    model = public_tokenizers.path("piece_bpe_32k.model")  # another tokenizer has counts of its own
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(docs, model, cache).collect()}
    assert got[90003, len(ODD[2][1])] == len(processor.encode(ODD[2][1]))
    assert encoded == [1, len({t or "" for _, t in ODD})]


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_cache_with_repeated_digests_and_repeated_rows(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, "other"), (2, "some words"), (None, None)], "doc_id long, text string")
    first = sorted(map(str, token_counts.count_tokens(docs, path, cache).collect()))
    stored = spark.read.parquet(cache)
    assert stored.count() == 3  # each distinct text once
    held = stored.collect()
    spark.createDataFrame(held, stored.schema).write.mode("append").parquet(cache)
    assert sorted(map(str, token_counts.count_tokens(docs, path, cache).collect())) == first
    assert spark.read.parquet(cache).count() == 6
