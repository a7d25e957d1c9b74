"""The sleep cycle: what a store forgets in one pass, as a plan from snapshot to snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import decay
from lethe.model import RULE_CONSOLIDATION, RULE_EVICTION, Decay
from lethe.operators import forget, levels
from lethe.operators.listing import count_by_membership
from lethe.operators.relations import resolved
from lethe.plans import changes
from lethe.sources.scratch import Scratch
from lethe.sources.snapshots import Snapshot

Step = Callable[[Snapshot], Snapshot]


@dataclass
class Report:
    memories_consolidated: int = 0
    events_consolidated: int = 0
    memories_evicted: int = 0
    events_evicted: int = 0
    bytes_freed: int = 0
    used_bytes: int = 0
    pressure: float = 1.0
    default_event_significance: int = 0


def _forget(snapshot: Snapshot, gone: DataFrame | None, emptied: DataFrame | None, scratch: Scratch, name: str) -> Snapshot:
    """Without doomed memories and events; links of what went are pruned and the sums of their neighbours taken anew."""
    write = lambda rows, part: scratch.write(rows, f"{name}-{part}")
    for table, rows in (("memories", gone), ("events", emptied)):
        if rows is not None and not rows.isEmpty():
            snapshot = changes.removed(snapshot, table, rows, write)
    return snapshot


def _flag(snapshot: Snapshot, seen: DataFrame, scratch: Scratch, name: str) -> Snapshot:
    """With events flagged as consolidated, where they weren't."""
    ids = seen.select(F.col("event_id").alias("id"))
    rows = snapshot.events.where(~F.col("memories_consolidated")).join(ids, "id", "left_semi").withColumn("memories_consolidated", F.lit(True))
    return snapshot.put("events", scratch.write(rows.select(*snapshot.events.columns), f"flags-{name}"))


def _log(snapshot: Snapshot, gone: DataFrame, rule: int, threshold: float, now: int) -> Snapshot:
    last = snapshot.tombstones.agg(F.max("seq")).first()[0] or 0
    return snapshot.put("tombstones", forget.tombstones(gone, rule, threshold, now, last))


def run(snapshot: Snapshot, now: int, d: Decay, last_used_bytes: int = 0, log: bool = True, summarise: Step | None = None, log_days: int = 0, log_rows: int = 0) -> tuple[Snapshot, Report]:
    """Consolidate event-less memories, memories of events and empty events, summarise, evict to the byte floor, prune the log.

    Each pass reads what the pass before did, and writes what it takes away or changes itself.
    ``summarise`` is a step from snapshot to snapshot, for a summariser that is set up.
    """
    scratch = Scratch(snapshot.memories.sparkSession, "cycle")
    report = Report()
    view = lambda name: resolved(snapshot.tables[name], snapshot.levels)
    report.default_event_significance = forget.default_event_significance(view("events"), d)
    d = Decay(**{**d.__dict__, "default_event_significance": report.default_event_significance})
    n = sum(count_by_membership(snapshot.memories).first())
    report.pressure = decay.pressure(n, last_used_bytes if d.capacity_bytes else 0, d)
    limit = decay.threshold(d, report.pressure)

    def scan(where, named: bool = True, memories: DataFrame | None = None):
        held = view("memories") if memories is None else resolved(memories, snapshot.levels)
        return forget.valued(forget.candidates(held.where(where), view("events") if named else None), now, d)

    needed = ("id", "group_name", "significance", "value", "body_bytes", "timestamp", "time_recalled", "recall_count")  # of what goes

    # Pass 1: memories of no event.
    gone = scratch.write(forget.doomed(scan(F.col("event_id") == "", False), now, d, report.pressure).select("event_id", *needed), "pass-1")
    report.memories_consolidated += gone.count()
    if log:
        snapshot = _log(snapshot, gone, RULE_CONSOLIDATION, limit, now)
    before = snapshot.memories
    snapshot = _forget(snapshot, gone, None, scratch, "one")
    # Pass 2: memories of events; every surviving event it saw is flagged. What the first pass dropped
    # belongs to no event, so unless link sums changed, memories are read as they were.
    dropped_only = all(kind == "drop" for kind, _ in snapshot.layers.get("memories", []))
    rows = scan(F.col("event_id") != "", memories=before if dropped_only else None)
    goes = F.coalesce(forget.is_doomed(now, d, report.pressure), F.lit(False))
    # One row for each memory; only those that go carry more than their event.
    rows = scratch.write(rows.withColumn("goes", goes).select("event_id", "has_event", "goes", F.when(F.col("goes"), F.struct(*needed)).alias("row")), "seen-2")
    gone = rows.where("goes").select("event_id", "has_event", "row.*")
    held = scratch.write(forget.by_event(rows, F.col("goes")), "events-2")
    emptied = held.where("emptied").select(F.col("event_id").alias("id"))
    report.memories_consolidated += gone.count()
    report.events_consolidated += emptied.count()
    if log:
        snapshot = _log(snapshot, gone, RULE_CONSOLIDATION, limit, now)
    snapshot = _flag(snapshot, held.where("known"), scratch, "two")
    snapshot = _forget(snapshot, gone, emptied, scratch, "two")
    # Pass 3: events that hold nothing; those of which pass 2 left something are known from it.
    left = held.where(F.col("doomed") < F.col("n")).select("event_id")
    old = scratch.write(forget.doomed_events(view("events"), left, now, d, report.pressure).select("id"), "pass-3")
    report.events_consolidated += old.count()
    snapshot = _forget(snapshot, None, old, scratch, "three")
    if summarise is not None:
        snapshot = summarise(snapshot)
    # Eviction.
    if d.capacity_bytes > 0:
        report.used_bytes = forget.used_bytes(snapshot.memories, snapshot.events, snapshot.memory_links, snapshot.event_links).first()[0]
        if report.used_bytes > d.capacity_bytes:
            rows = scratch.write(scan(F.lit(True)), "seen-4")
            gone = scratch.write(forget.evicted(rows, report.used_bytes - decay.eviction_floor(d)), "pass-4")
            emptied = scratch.write(forget.emptied_events(rows, gone).select(F.col("event_id").alias("id")), "emptied-4")
            report.memories_evicted, report.events_evicted = gone.count(), emptied.count()
            report.bytes_freed = gone.agg(F.coalesce(F.sum(F.col("body_bytes") + 256), F.lit(0))).first()[0]
            if log:
                snapshot = _log(snapshot, gone, RULE_EVICTION, limit, now)
            snapshot = _flag(snapshot, gone.where(F.col("has_event")).select("event_id").distinct(), scratch, "four")
            snapshot = _forget(snapshot, gone, emptied, scratch, "four")
    if log and (log_days or log_rows):
        kept = forget.prune_log(snapshot.tombstones, now, log_days, log_rows)
        snapshot = snapshot.drop("tombstones", scratch.write(snapshot.tombstones.select("seq").join(kept.select("seq"), "seq", "left_anti"), "pruned"))
    if levels.too_high(snapshot.levels):
        snapshot = snapshot.replace(levels=levels.compact(snapshot.levels))
    return snapshot, report
