"""Ordered listings with pages and totals."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.model import EventFilter, InvalidArgument, MemoryFilter
from lethe.operators.filters import filter_events, filter_memories, needs_significance
from lethe.operators.relations import resolved

#: field -> (columns with the field's own direction first, whether it naturally ascends); id breaks ties the other way.
MEMORY_ORDERS = {
    "significance": (["significance", "timestamp"], False),
    "timestamp": (["timestamp"], False),
    "time_recalled": (["time_recalled", "timestamp"], False),
    "recall_count": (["recall_count", "timestamp"], False),
    "link_significance": (["link_significance", "significance"], False),
    "group": (["group_name", "timestamp"], True),
    "id": ([], True),
}
EVENT_ORDERS = {
    "significance": (["significance", "time_start"], False),
    "timestamp": (["time_start"], False),
    "time_end": (["time_end", "time_start"], False),
    "name": (["name"], True),
    "link_significance": (["link_significance", "significance"], False),
    "group": (["group_name", "time_start"], True),
    "id": ([], True),
}
DEFAULT_PAGE, MAX_PAGE = 25, 200


def order_by(orders: dict, name: str = "", ascending: bool | None = None) -> list:
    """The columns of an ordering; its reverse reverses the tie-breaks too. Unknown names take the default."""
    columns, naturally = orders.get(name) or orders["timestamp"]
    up = naturally if ascending is None else ascending
    if not columns:
        return [F.asc("id") if up else F.desc("id")]
    return [F.asc(c) if up else F.desc(c) for c in columns] + [F.desc("id") if up else F.asc("id")]


def checked_order(orders: dict, name: str) -> str:
    if name and name not in orders:
        raise InvalidArgument(f"order by one of {', '.join(sorted(orders))}")
    return name


def clamp_page(limit: int = 0, offset: int = 0) -> tuple[int, int]:
    return (min(limit, MAX_PAGE) if limit > 0 else DEFAULT_PAGE), max(offset, 0)


def _paged(rows: DataFrame, columns: list, limit: int, offset: int) -> DataFrame:
    ordered = rows.orderBy(*columns)
    return ordered.offset(offset).limit(limit) if offset and limit else ordered.limit(limit) if limit else ordered


def list_memories(memories: DataFrame, f: MemoryFilter = MemoryFilter(), name: str = "", ascending: bool | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    return _paged(filter_memories(memories, f), order_by(MEMORY_ORDERS, checked_order(MEMORY_ORDERS, name), ascending), limit, offset)


def list_events(events: DataFrame, f: EventFilter = EventFilter(), name: str = "", ascending: bool | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    return _paged(filter_events(events, f), order_by(EVENT_ORDERS, checked_order(EVENT_ORDERS, name), ascending), limit, offset)


def count_memories(stored: DataFrame, levels: DataFrame, f: MemoryFilter = MemoryFilter()) -> DataFrame:
    """One row (n). The registry is joined only if the filter needs ranks, since Catalyst would keep the join."""
    rows = resolved(stored, levels) if needs_significance(f) else stored
    return filter_memories(rows, f).agg(F.count(F.lit(1)).alias("n"))


def count_events(stored: DataFrame, levels: DataFrame, f: EventFilter = EventFilter()) -> DataFrame:
    rows = resolved(stored, levels) if needs_significance(f) else stored
    return filter_events(rows, f).agg(F.count(F.lit(1)).alias("n"))


def total_if_needed(page_rows: int, limit: int, offset: int, count) -> int:
    """A listing's total: a page that isn't full proves it; else count() is asked."""
    if page_rows < limit and (page_rows or not offset):
        return offset + page_rows
    return count()


def count_by_membership(memories: DataFrame) -> DataFrame:
    """One row (with_event, without_event)."""
    return memories.agg(F.count_if(F.col("event_id") != "").alias("with_event"), F.count_if(F.col("event_id") == "").alias("without_event"))


def count_by_event(memories: DataFrame, event_ids: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, n) for each asked event, 0 if it has no memory."""
    scoped = memories.where(F.col("group_name").isin(*groups)) if groups else memories
    counts = scoped.where(F.col("event_id") != "").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    asked = event_ids.select(F.col("id").alias("event_id")).distinct()
    return asked.join(counts, "event_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_memories(events: DataFrame, memories: DataFrame) -> DataFrame:
    """events with memory_count and an array of their memories in order of time."""
    item = F.struct("timestamp", "id", "significance", "recall_count")
    held = memories.where(F.col("event_id") != "").groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("memories"), F.count(F.lit(1)).alias("memory_count"))
    out = events.join(held, events["id"] == held["event_id"], "left").drop("event_id")
    return out.withColumn("memory_count", F.coalesce("memory_count", F.lit(0))).withColumn("memories", F.coalesce("memories", F.array().cast(held.schema["memories"].dataType)))


def histogram(items: DataFrame) -> DataFrame:
    """(band, n, percent) of ranked items."""
    from lethe.functions.text import band

    counts = items.where(F.col("significance") > 0).groupBy(band(F.col("significance")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("band", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def floor_quantiles(rows: DataFrame, column: str, by: str, *quantiles: float) -> DataFrame:
    """(by, n, q50, ...): the values at place floor(q * (n - 1)) of each group in ascending order.

    Counts of distinct values are summed up, so a group's rows are combined before they are shuffled.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(by).orderBy(column)
    placed = counts.withColumn("__upto", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(Window.partitionBy(by)))
    place = lambda q: F.floor(F.lit(q) * (F.col("__n") - 1))
    picks = [F.min(F.when(F.col("__upto") > place(q), F.col(column))).alias(f"q{round(q * 100)}") for q in quantiles]
    return placed.groupBy(by).agg(F.max("__n").alias("n"), *picks)


@dataclass
class CountCache:
    """Totals of listings, kept for a while by everything in the filter but its page."""

    seconds: float
    clock: Callable[[], float]
    most: int = 1000
    held: dict[Hashable, tuple[float, int]] = field(default_factory=dict)

    def get(self, kind: str, f: MemoryFilter | EventFilter, count: Callable[[], int]) -> int:
        key = (kind, repr(f))
        at, n = self.held.get(key, (None, 0))
        if at is None or self.clock() - at > self.seconds:
            n = count()
            self.held.pop(key, None)
            while len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[key] = (self.clock(), n)
        return n

    def reset(self) -> None:
        self.held.clear()
