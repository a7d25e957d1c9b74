"""Structured Streaming bridges into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators.ingest import OUTCOMES
from lethe.operators.levels import attach_levels, register_ranks
from lethe.operators.mutate import invalid_reason, one_per_id, recall
from lethe.operators.relations import few
from lethe.plans.changes import registered, removed
from lethe.sources.snapshots import Store


def store_batch(store: Store, memories: DataFrame, now: int, minimum: int = 0, dead_letters: str = "") -> dict[str, int]:
    """Store a micro-batch if absent and commit; returns how many were stored, there already, or refused.

    A replayed batch finds its ids taken and changes nothing. Refused rows are appended to dead_letters
    with their reason, if a path is given, and never stop the stream.
    """
    snapshot = store.read()
    refused = invalid_reason(now).isNotNull() | ((F.col("significance") > 0) & (F.col("significance") < minimum))
    batch = one_per_id(memories).withColumn("__refused", F.coalesce(refused, F.lit(True)))
    there = snapshot.memories.select("id", F.lit(True).alias("__there"))
    told = batch.join(there, "id", "left").select("id", F.when(F.col("__refused"), "rejected").when(F.col("__there"), "exists").otherwise("stored").alias("outcome"))
    counts = {r["outcome"]: r["count"] for r in told.groupBy("outcome").count().collect()}
    if dead_letters and counts.get("rejected"):
        why = F.coalesce(invalid_reason(now), F.lit("significance"))
        batch.where("__refused").withColumn("reason", why).drop("__refused").write.mode("append").parquet(dead_letters)
    good = batch.where(~F.col("__refused")).drop("__refused")
    fresh = good.join(snapshot.memories.select("id"), "id", "left_anti")
    levels = register_ranks(snapshot.levels, fresh)
    rows = attach_levels(fresh, levels).select(*snapshot.memories.columns)
    store.commit(registered(snapshot, levels).put("memories", rows))
    return {o: counts.get(o, 0) for o in OUTCOMES}


def bridge(messages: DataFrame, transform: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, now: Callable[[], int], seconds: int = 5):
    """A query that stores a stream of messages; at least once, and idempotent by id."""

    def each(batch: DataFrame, _: int) -> None:
        store_batch(store, transform(batch), now())

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def recall_batch(store: Store, batch: DataFrame, now: int) -> tuple[int, int]:
    """Recall a micro-batch of ids, each distinct one once; (hits, misses)."""
    snapshot, ids = store.read(), batch.select("id").distinct()
    asked = ids.count()
    ids = few(ids, asked)
    rows = snapshot.memories.join(ids, "id", "left_semi")
    hits = rows.count()
    if hits:
        store.commit(snapshot.put("memories", recall(rows, ids, now)))
    return hits, asked - hits


def delete_batch(store: Store, recalled: DataFrame, deleted: DataFrame, now: int) -> int:
    """Recalls of a micro-batch first, then the memories that it deletes; how many went."""
    recall_batch(store, recalled, now)
    snapshot = store.read()
    ids = deleted.select("id").distinct()
    gone = snapshot.memories.join(few(ids, ids.count()), "id", "left_semi").select("id")
    n = gone.count()
    if n:
        store.commit(removed(snapshot, "memories", gone))
    return n


def recalls(ids: DataFrame, store: Store, checkpoint: str, now: Callable[[], int], seconds: int = 5):
    """A query that recalls a stream of ids: distinct ids of a micro-batch count once."""

    def each(batch: DataFrame, _: int) -> None:
        recall_batch(store, batch, now())

    return ids.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def bucketed(records: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """A stream's (group_name, time_start, time_end, n) by time bucket; late records beyond the watermark are left out."""
    rows = records.withWatermark("ts", late).groupBy("group_name", F.window("ts", size))
    return rows.agg(F.max("ts").alias("time_end"), F.count(F.lit(1)).alias("n")).select("group_name", F.col("window.start").alias("time_start"), "time_end", "n")


def deduplicated(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Records whose id hasn't come within the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def cycles(spark: SparkSession, run: Callable[[], None], seconds: int, checkpoint: str):
    """A query whose trigger runs a cycle now and then; one run at a time."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda *_: run()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
