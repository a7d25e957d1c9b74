"""Keyword, vector and hybrid search, and ranking by value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lethe.functions.text import cosine, query_terms
from lethe.model import InvalidArgument, Ranking
from lethe.sources.scratch import Scratch

K1, B = 1.2, 0.75
RRF = 60.0
SLICE_BYTES = 4 << 20  # of bodies, for each bucket of the index


def counted_terms(memories: DataFrame) -> DataFrame:
    """(id, dl, counts) of text bodies, counts being an array of (term, tf) in order of the terms.

    Words are sorted and counted inside each document's row, so nothing is shuffled.
    """
    words = memories.where(~F.col("is_binary")).select("id", F.sort_array(query_terms(F.col("body"))).alias("terms"))
    at, before = (lambda i: F.element_at("terms", i)), (lambda i: F.element_at("terms", i - 1))
    starts = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: F.when(i == 1, F.lit(True)).otherwise(at(i) != before(i)))
    starts = words.select("id", "terms", F.when(F.size("terms") > 0, starts).alias("starts"))
    until = lambda k: F.coalesce(F.get("starts", k + 1), F.size("terms") + 1)
    return starts.select("id", F.size("terms").alias("dl"), F.transform("starts", lambda i, k: F.struct(at(i).alias("term"), (until(k) - i).cast("long").alias("tf"))).alias("counts"))


def postings(memories: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of text bodies: the inverted index, recomputed from the primary table."""
    return counted_terms(memories).select("id", "dl", F.inline("counts")).select("term", "id", "tf", "dl")


def asked_terms(spark: SparkSession, text: str) -> list[str]:
    asked = sorted(set(spark.range(1).select(query_terms(F.lit(text))).first()[0]))
    if not asked:
        raise InvalidArgument("a query needs a word")
    return asked


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def whole_words(words: list[str]) -> str:
    """A pattern of any of these words, which hold letters and digits only."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"


def matching(memories: DataFrame, text: str) -> DataFrame:
    """(id) of all text memories with any of the query's words, in no order: one scan, and nothing is shuffled."""
    asked = asked_terms(memories.sparkSession, text)
    return memories.where(~F.col("is_binary") & F.lower("body").rlike(whole_words(asked))).select("id")


def keyword_hits(memories: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(id, score) by BM25 over documents with any of the query's terms, without an index.

    One scan counts all documents and their words, and writes the query's counts of those that hold any
    of its words; memories come filtered. ``KeywordIndex`` reads the query's words only.
    """
    spark = memories.sparkSession
    asked = asked_terms(spark, text)
    text_of, totals = F.lower("body"), Observation()
    docs = memories.where(~F.col("is_binary")).select("id", "body", F.regexp_count(text_of, F.lit(r"[\p{L}\p{N}]+")).alias("dl"))
    docs = docs.observe(totals, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    times = (F.regexp_count(text_of, F.lit(whole_words([w]))).alias(f"tf{i}") for i, w in enumerate(asked))
    found = Scratch(spark, "keyword").write(docs.where(text_of.rlike(whole_words(asked))).select("id", "dl", *times), "counts")  # numbers only; bodies are read once
    n, avgdl = F.lit(totals.get["n"]), F.lit(totals.get["avgdl"]).cast("double")
    rows = found.join(F.broadcast(found.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))))))
    score = F.lit(0.0)
    for i in range(len(asked)):
        score = score + bm25(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("dl"), n, avgdl)
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


@dataclass
class KeywordIndex:
    """A stored inverted index: (bucket, term, id, tf, dl) in segments, whose files are sorted by term within buckets of its hash.

    A query reads the folders of its words' buckets, and of those the row groups that hold the words. A
    segment replaces what earlier ones hold of its documents; ``latest`` tells each document's segment.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    segments: int = 0
    n: int = 0
    words: int = 0

    def add(self, memories: DataFrame) -> KeywordIndex:
        """Index text memories, in place of what is there of the same ids.

        Bodies are cut into words once and postings are shuffled once. Each document has one more row, in
        bucket -1. A bucket is dealt to slices by id, as many as the bodies' counted bytes ask for.
        """
        size = memories.where(~F.col("is_binary")).agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
        slices = 1 + size // (self.buckets * SLICE_BYTES)
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        whole = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
        rows = counted_terms(memories).select("id", "dl", F.inline(F.concat(whole, F.coalesce("counts", none))))
        rows = rows.select("term", "id", "dl", "tf", F.when(F.col("term") == "", F.lit(-1)).otherwise(self._bucket(F.col("term"))).alias("bucket"))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(slices)))
        dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.path}/segment={self.segments}/postings")
        self.segments += 1
        self.n, self.words = self._latest().agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return self

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self) -> DataFrame:
        out = None
        for i in range(self.segments):
            rows = self.spark.read.parquet(f"{self.path}/segment={i}/postings").withColumn("segment", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _latest(self) -> DataFrame:
        """(id, segment, dl) of each document's last segment."""
        rows = self._read().where(F.col("bucket") == -1).select("id", "segment", "dl")
        return rows if self.segments == 1 else rows.groupBy("id").agg(F.max_by("dl", "segment").alias("dl"), F.max("segment").alias("segment"))

    def postings(self) -> DataFrame:
        """(term, id, tf, dl) of all documents."""
        rows = self._read().where(F.col("bucket") >= 0)
        rows = rows if self.segments == 1 else rows.join(self._latest().select("id", "segment"), ["id", "segment"], "left_semi")
        return rows.select("term", "id", "tf", "dl")

    def hits(self, text: str, limit: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        """(id, score) by BM25 over documents with any of the query's terms; allowed: (id) of those a caller may see."""
        if not self.segments:
            raise InvalidArgument("nothing is indexed")
        asked = asked_terms(self.spark, text)
        at = self.spark.createDataFrame([(w,) for w in asked], "term string").select(self._bucket(F.col("term"))).distinct().collect()  # of one query's words
        rows = self._read().where(F.col("bucket").isin([r[0] for r in at]) & F.col("term").isin(asked))
        if self.segments > 1:
            rows = rows.join(self._latest().select("id", "segment"), ["id", "segment"], "left_semi")
        df = F.broadcast(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row for each of the query's words
        score = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(float(self.n)), F.lit(self.words / max(1, self.n)))
        found = rows.join(df, "term").groupBy("id").agg(F.sum(score).alias("score"))
        if allowed is not None:
            found = found.join(allowed.select("id"), "id", "left_semi")
        return found.orderBy(F.desc("score"), "id").limit(limit)


def embedded(bodies: DataFrame, embed: Callable[[str], list[float]], rows: int = 64) -> DataFrame:
    """(id, vector) of (id, body). ``embed`` runs inside tasks; one with a ``batch`` attribute takes lists of at most ``rows`` bodies."""

    def run(batches):
        many = getattr(embed, "batch", None) or (lambda texts: [embed(t) for t in texts])
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(many(part.column("body").to_pylist()), pa.list_(pa.float32()))], ["id", "vector"])

    kind = dict(bodies.dtypes)["id"]
    return bodies.select("id", "body").mapInArrow(run, f"id {kind}, vector array<float>")


def vector_hits(vectors: DataFrame, query: list[float], limit: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score) of the largest cosines, exactly; the query is a literal. allowed: (id) of those a caller may see.

    Vectors become scores where they are read, so only ids and scores are shuffled.
    """
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("id", cosine(F.col("vector"), asked).alias("score"))
    if allowed is not None:
        # An inner join, since a semi join would be moved below the scores, and whole vectors shuffled.
        scored = scored.join(allowed.select("id").distinct(), "id")
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def fuse(*lists: DataFrame) -> DataFrame:
    """(id, score) of ranked lists of hits by reciprocal rank, positions from 0; ties go to the hit seen first.

    Lists are top-k results, so their windows are small.
    """
    rows = None
    for i, hits in enumerate(lists):
        by = Window.orderBy(F.desc("score"), "id")
        placed = hits.select("id", F.lit(i).alias("list"), (F.row_number().over(by) - 1).alias("position"))
        rows = placed if rows is None else rows.unionAll(placed)
    first = F.min(F.struct("list", "position")).alias("first")
    return rows.groupBy("id").agg(F.sum(1 / (F.lit(RRF) + F.col("position"))).alias("score"), first)


def fused(*lists: DataFrame, limit: int = 10) -> DataFrame:
    return fuse(*lists).orderBy(F.desc("score"), "first").limit(limit).select("id", "score")


def normalised(column: str):
    """Divided by the largest of the candidates; 0 where nothing is above 0."""
    top = F.max(column).over(Window.partitionBy())
    return F.when((top > 0) & (F.col(column) > 0), F.col(column) / top).otherwise(F.lit(0.0))


def rank(hits: DataFrame, memories: DataFrame, weights: Ranking = Ranking(), limit: int = 10) -> DataFrame:
    """Hits joined to memories that are still there, by relevance blended with significance and recall.

    hits is a candidate list of a search (over-fetched top-k), so its windows are small.
    """
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    found = hits.withColumn("position", place).join(memories.select("id", "significance", "recall_count"), "id")
    if not weights.active:
        return found.withColumn("blend", F.col("score")).orderBy("position").limit(limit)
    found = found.withColumn("recalls", F.log1p(F.col("recall_count").cast("double"))).withColumn("ranked", F.col("significance").cast("double"))
    blend = normalised("score") + F.lit(weights.significance) * normalised("ranked") + F.lit(weights.recall) * normalised("recalls")
    return found.withColumn("blend", blend).drop("recalls", "ranked").orderBy(F.desc("blend"), "position").limit(limit)


def search(memories: DataFrame, mode: str = "keyword", text: str = "", vectors: DataFrame | None = None, query: list[float] | None = None, weights: Ranking = Ranking(), limit: int = 10, index: KeywordIndex | None = None) -> DataFrame:
    """Ranked memories of a keyword, semantic or hybrid search; memories come filtered and resolved."""
    wanted = weights.candidates(limit)
    if mode not in search_modes(vectors is not None):
        raise InvalidArgument(f"mode is one of {', '.join(search_modes(vectors is not None))}")
    lists = []
    if mode in ("keyword", "hybrid"):
        lists.append(index.hits(text, wanted, memories) if index is not None else keyword_hits(memories, text, wanted))
    if mode in ("semantic", "hybrid"):
        lists.append(vector_hits(vectors, query, wanted, memories))
    return rank(lists[0] if len(lists) == 1 else fused(*lists, limit=wanted), memories, weights, limit)


def search_modes(has_vectors: bool) -> list[str]:
    return ["keyword", "semantic", "hybrid"] if has_vectors else ["keyword"]
