"""Token counts through a digest cache.

The cache is a table of (digest, tokenizer, n_tokens): the SHA-256 of the content, the SHA-256 of the
tokenizer's file, and the stored count. A run joins its contents' digests to the cache, encodes each
distinct miss once, appends the new counts and takes every count from the cache.

Content is normalised only as far as counts allow: a null text is the empty text, and texts are UTF-8.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are taken
as the tokenizer takes them by default; no special tokens are added, nothing is truncated; repeated
rows and repeated texts each get their count; repeated doc_ids may hold different texts; an empty
table gives an empty result and leaves the cache as it was. A cache may hold a digest more than once, as
after two writers at the same time: its count is read once.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm.common import Scratch, bounded_batches, text_or_empty

SCHEMA = "digest binary, tokenizer string, n_tokens long"
CHUNK_CHARS = 1 << 20


class CountCache:
    """Stored counts in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            spark.createDataFrame([], SCHEMA).write.parquet(path)

    def counts(self, version: str) -> DataFrame:
        stored = self.spark.read.schema(SCHEMA).parquet(self.path)
        return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counted: DataFrame, version: str) -> None:
        counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)


def tokenizer_source(path: str) -> tuple[str, bytes]:
    """The tokenizer's kind and its file's bytes."""
    with open(path, "rb") as file:
        return ("sentencepiece" if path.endswith(".model") else "tokenizers"), file.read()


@lru_cache(2)
def _counter(kind: str, source: bytes):
    """A function from texts to counts, kept as long as a Python worker lives."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=source)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(source.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) for rows of (digest, text), each text encoded in full."""
    bounded_batches(texts.sparkSession)
    shipped = texts.sparkSession.sparkContext.broadcast(tokenizer_source(path))  # one vocabulary file

    def count(batches):
        counter = _counter(*shipped.value)
        for batch in batches:
            found, chunk, held = [], [], 0
            for text in batch.column("text").to_pylist():
                chunk.append(text)
                held += len(text)
                if held >= CHUNK_CHARS:
                    found += counter(chunk)
                    chunk, held = [], 0
            if chunk:
                found += counter(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


def repeated_ids(seen: DataFrame, key) -> DataFrame:
    """(digest, first_id) that several rows hold."""
    return seen.groupBy("digest", key.alias("first_id")).count().where("count > 1")


def count_tokens(docs: DataFrame, path: str, cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Without cache_path the cache starts empty."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache = CountCache(spark, cache_path or scratch.path("cache"))
    version = hashlib.sha256(tokenizer_source(path)[1]).hexdigest()
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    key = F.coalesce("doc_id", F.lit(-1 << 63))
    seen = scratch.write(docs.select("doc_id", digest.alias("digest"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes")), "digests")
    first = seen.groupBy("digest").agg(F.min(key).alias("first_id"))
    misses = first.join(cache.counts(version), "digest", "left_anti")
    texts = docs.select(key.alias("first_id"), digest.alias("digest"), text_or_empty().alias("text")).join(misses, ["digest", "first_id"], "left_semi")
    if not repeated_ids(seen, key).isEmpty():
        texts = texts.dropDuplicates(["digest"])  # rows that repeat both doc_id and text
    counted = count_texts(texts, path)
    cache.append(counted, version)
    # Written, so that both sides of the join are plain shuffles and a very common text's rows can be split.
    held = scratch.write(cache.counts(version), "counts")
    out = seen.join(held, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
