"""Promotion: judge events of one store, send what is promoted to another, and drain what was sent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.operators import rules
from lethe.operators.levels import attach_levels, register_ranks
from lethe.operators.relations import resolved
from lethe.plans import changes
from lethe.sources.archive import BATCH_BYTES, byte_batches
from lethe.sources.scratch import Scratch
from lethe.sources.snapshots import Store


@dataclass
class Promotion:
    promoted: int = 0
    dropped: int = 0
    kept: int = 0
    skipped: int = 0  # events over the caller's cap, if one is set
    memories: int = 0
    batches: int = 0
    drained: int = 0


def batched(memories: DataFrame, ruleset: rules.Ruleset, summariser: Callable | None = None, now: int = 0, most: int = BATCH_BYTES) -> DataFrame:
    """The memories that promotion sends, with the number of their batch of about so many bytes."""
    rows = memories.where(F.col("action") == "promote")
    if summariser is not None:
        rows = rules.summarised(rows, ruleset, summariser, now)
    return byte_batches(rules.reduced(rows, ruleset).withColumn("group_name", F.lit("")), most).drop("group_name")


def run(source: Store, target: Store, ruleset: rules.Ruleset, now: int, settle: int = 0, most: int | None = None, summariser: Callable | None = None) -> Promotion:
    """One pass over the settled events of ``source``, of any number of memories unless the caller sets ``most``.

    Promoted events and memories are stored in ``target`` in one commit, events that are there already are
    left as they are. Then promoted and dropped events go from ``source`` with their memories, unless a
    memory has come since they were judged.
    """
    s = source.read()
    scratch = Scratch(source.spark, "promote")
    view = lambda name: resolved(s.tables[name], s.levels)
    events = rules.settled(view("events"), now, settle)
    facts = scratch.write(rules.facts_for(ruleset, events, view("memories"), most), "facts")
    verdicts = scratch.write(rules.judge(facts, ruleset), "verdicts")
    told = {r["action"]: r["count"] for r in verdicts.groupBy("action").count().collect()}  # a row for each action
    report = Promotion(told.get("promote", 0), told.get("drop", 0), told.get("keep", 0) + told.get("summarise", 0))
    if most is not None:
        report.skipped = rules.over_cap(events, view("memories"), most).count()
    sent = rules.changed_memories(view("memories"), facts, verdicts, ruleset)
    sent = scratch.write(batched(sent, ruleset, summariser, now), "sent")
    report.memories, report.batches = sent.agg(F.count(F.lit(1)), F.coalesce(F.max("batch") + 1, F.lit(0))).first()
    promoted = verdicts.where("action = 'promote'").select("id")
    _store(target, scratch, rules.changed_events(facts, verdicts, ruleset).join(promoted, "id", "left_semi"), sent, s.memories)
    judged = facts.join(verdicts.where(F.col("action").isin("promote", "drop")), "id").select(F.col("id").alias("event_id"), "event.memory_count")
    current = source.read()
    gone = scratch.write(rules.drainable(judged, current.memories).select(F.col("event_id").alias("id")), "gone")
    report.drained = gone.count()
    memories = scratch.write(current.memories.join(gone.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("id"), "gone-memories")
    source.commit(changes.removed(changes.removed(current, "memories", memories), "events", gone))
    return report


def _store(target: Store, scratch: Scratch, events: DataFrame, memories: DataFrame, originals: DataFrame) -> None:
    t = target.read()
    rows = events.select("event.*").select(
        "id", "time_start", "time_end", "significance", "name", "description", F.lit(False).alias("memories_consolidated"), F.lit(0).cast("long").alias("link_significance"),
        F.col("group").alias("group_name"), "metadata",
    )
    events = scratch.write(rows.join(t.events.select("id"), "id", "left_anti"), "new-events")
    # A memory keeps its group and time of recall; a summary has none.
    old = originals.select("id", "time_recalled", "group_name", "link_significance")
    new = memories.drop("rule", "action", "batch").join(old, "id", "left").join(t.memories.select("id"), "id", "left_anti")
    new = new.fillna({"time_recalled": 0, "group_name": ""}).withColumn("link_significance", F.lit(0).cast("long"))
    memories = scratch.write(new, "new-memories")
    levels = scratch.write(register_ranks(t.levels, events, memories), "levels")
    target.commit(changes.registered(t, levels).put("events", attach_levels(events, levels)).put("memories", attach_levels(memories, levels)))
