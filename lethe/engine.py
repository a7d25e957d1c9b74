"""The store's calls: each reads the current snapshot, and those that change it commit the next one.

Answers are DataFrames unless they are one value. A caller bound to groups sees only theirs: what lies
outside is reported as not found, and calls on the whole store are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import decay
from lethe.model import DAY, AlreadyExists, Decay, EventFilter, InvalidArgument, MemoryFilter, NotFound, Ranking
from lethe.operators import forget, levels, links, listing, mutate, relations, search
from lethe.plans import changes, cycle, summarise
from lethe.plans.changes import registered
from lethe.sources import archive
from lethe.sources.scratch import Scratch
from lethe.sources.snapshots import Snapshot, Store

MAX_EXPLAINED, MAX_LIST_LINKS = 200, 128


@dataclass
class Engine:
    """A store with its settings, as one caller sees it. ``clock`` gives nanoseconds."""

    store: Store
    clock: Callable[[], int]
    decay: Decay = Decay()
    ranking: Ranking = Ranking()
    groups: tuple[str, ...] = ()
    minimum_significance: int = 0
    reinforce_fraction: float = 0.0
    summariser: summarise.Summariser | None = None
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    index: search.KeywordIndex | None = None
    last_report: cycle.Report | None = None
    last_used: int = 0
    automatic_least: int = 0  # memories of an event that a cycle summarises by itself; 0 for never
    automatic_quiet_days: int = 7
    log_days: int = 0
    log_rows: int = 0
    on_deleted: Callable[[DataFrame], None] | None = None  # told the ids of memories that are gone
    recall_hits: int = 0
    recall_misses: int = 0

    # --- helpers

    @property
    def spark(self):
        return self.store.spark

    def _counted(self, ids) -> tuple[DataFrame, int]:
        """(id) of a list or a table, and their number; joins broadcast them if they are few."""
        if isinstance(ids, DataFrame):
            n = ids.count()
            return relations.few(ids.select("id"), n), n
        rows = [(x,) for x in dict.fromkeys(i for i in ids if i)]
        return relations.few(self.spark.createDataFrame(rows, "id string"), len(rows)), len(rows)

    def _ids(self, ids) -> DataFrame:
        return self._counted(ids)[0]

    def _scoped(self, items: DataFrame) -> DataFrame:
        return items.where(F.col("group_name").isin(*self.groups)) if self.groups else items

    def _view(self, s: Snapshot, name: str) -> DataFrame:
        return relations.resolved(self._scoped(s.tables[name]), s.levels)

    def _need(self, items: DataFrame, ids: DataFrame) -> None:
        held = self._scoped(items).select("id").join(ids, "id", "left_semi")  # of these ids only
        gone = ids.join(held, "id", "left_anti").agg(F.min("id")).first()[0]
        if gone is not None:
            raise NotFound(gone)

    def _unbound(self) -> None:
        if self.groups:
            raise InvalidArgument("a caller bound to groups cannot touch the whole store")

    def _group(self, asked: str) -> str:
        from lethe.operators.filters import write_group

        return write_group(self.groups, asked)

    def _level(self, s: Snapshot, table: str, significance: int, above: str = "", below: str = ""):
        """(levels, level id) of a rank, or of a place above, below or between other records."""
        if not above and not below:
            return levels.find_or_create(s.levels, significance)
        rank = lambda x: levels.anchor_rank(self._scoped(s.tables[table]), s.levels, x) if x else None
        registry, level_id, _ = levels.place(s.levels, rank(above), rank(below))
        return registry, level_id

    @property
    def _write(self) -> changes.Write:
        """Writes what a change reads more than once."""
        return Scratch(self.spark, "change").write

    def _told(self, gone: DataFrame) -> None:
        if self.on_deleted is not None:
            self.on_deleted(gone)

    # --- memories

    def store_memory(self, body: str, memory_id: str = "", significance: int = 0, event_id: str = "", group: str = "", timestamp: int = 0, metadata=None, is_binary=False, is_summary=False, above: str = "", below: str = "", linked: dict[str, int] | None = None) -> str:
        """Store one memory and return its id; an empty id means that its significance was below the minimum."""
        s, now = self.store.read(), self.clock()
        placed = bool(above or below)
        if not placed and 0 < significance < self.minimum_significance:
            return ""
        registry, level_id = self._level(s, "memories", significance, above, below)
        row = [(memory_id, timestamp, level_id, event_id, is_binary, 0, 0, is_summary, self._group(group), 0, body, metadata)]
        new = mutate.with_defaults(self.spark.createDataFrame(row, s.memories.schema), now)
        found = new.withColumn("significance", F.lit(significance)).select("id", mutate.invalid_reason(now).alias("r")).first()
        if found.r:
            raise InvalidArgument(found.r)
        new = new.withColumn("id", F.lit(found.id))
        mutate.unused(s.memories, new)
        s = changes.registered(s, registry).put("memories", new)
        if linked:
            s = self._linked(s, "memories", found.id, linked, now)
        self.store.commit(s)
        return found.id

    def update_memory(self, changes: DataFrame, clear: tuple[str, ...] = ()) -> None:
        """Change the set fields of memories; significance may be among them."""
        s, ids = self.store.read(), self._ids(changes)
        self._need(s.memories, ids)
        registry = s.levels
        if "significance" in changes.columns:
            registry = levels.register_ranks(s.levels, changes)
            changes = levels.attach_levels(changes, registry)
        rows = s.memories.join(ids, "id", "left_semi").select(*s.memories.columns)
        self.store.commit(registered(s, registry).put("memories", mutate.update(rows, changes, clear)))

    def delete_memories(self, ids) -> int:
        s, ids = self.store.read(), self._ids(ids)
        gone = self._scoped(s.memories).join(ids, "id", "left_semi").select("id")
        n = gone.count()
        self.store.commit(changes.removed(s, "memories", gone, self._write))
        self._told(gone)
        return n

    def get_memories(self, f: MemoryFilter = MemoryFilter(), order: str = "", ascending: bool | None = None, limit: int = 0, offset: int = 0, linked_to: str = "") -> tuple[DataFrame, int]:
        """A page of memories with their links, and the listing's total."""
        s = self.store.read()
        limit, offset = listing.clamp_page(limit, offset)
        rows = self._view(s, "memories")
        if linked_to:
            rows = links.linked_to(rows, s.memory_links, self._ids([linked_to]))
        page = listing.list_memories(rows, f, order, ascending, limit, offset)
        total = listing.total_if_needed(page.count(), limit, offset, lambda: listing.filter_memories(rows, f).count())
        return links.outgoing(page, s.memory_links), total

    def recall_memories(self, ids, include_linked: bool = False) -> DataFrame:
        """Recall memories: their time and count change, neighbours move a little if that is set up."""
        s, (ids, asked), now = self.store.read(), self._counted(ids), self.clock()
        found = self._scoped(s.memories).join(ids, "id", "left_semi").count()
        self.recall_hits += found
        self.recall_misses += asked - found
        self._need(s.memories, ids)
        s = self.store.commit(s.put("memories", self._recalled(s, ids, now)))
        rows = self._view(s, "memories")
        found = rows.join(ids, "id", "left_semi")
        return links.with_linked(found, rows, s.memory_links, self.groups) if include_linked else found

    def _recalled(self, s: Snapshot, ids: DataFrame, now: int) -> DataFrame:
        """The rows that a recall changes: those asked for, and their neighbours where reinforcement is set up."""
        held = lambda x: s.memories.join(x, "id", "left_semi").select(*s.memories.columns)
        rows = mutate.recall(held(ids), ids, now)
        if self.reinforce_fraction:
            near = self._ids(links.neighbours(s.memory_links, ids))
            rows = rows.unionAll(mutate.reinforce(held(near), near, now, self.reinforce_fraction))
        return rows

    def store_memories(self, rows: DataFrame) -> DataFrame:
        """Store many resolved memories if absent, in one commit; (id, outcome) of each."""
        from lethe.operators.ingest import outcomes

        s, now = self.store.read(), self.clock()
        new = mutate.with_defaults(rows, now).dropDuplicates(["id"])
        told = outcomes(new, s.memories.select("id"), self.minimum_significance)
        bad = new.select("id", mutate.invalid_reason(now).alias("reason"))
        told = told.join(bad, "id").select("id", F.when(F.col("reason").isNotNull(), "rejected").otherwise(F.col("outcome")).alias("outcome"), "reason")
        told = Scratch(self.spark, "outcomes").write(told, "told")
        good = new.join(told.where("outcome = 'stored'").select("id"), "id", "left_semi")
        registry = levels.register_ranks(s.levels, good)
        self.store.commit(changes.registered(s, registry).put("memories", levels.attach_levels(good, registry)))
        return told

    def search_memories(self, text: str, mode: str = "keyword", f: MemoryFilter = MemoryFilter(), limit: int = 10, reinforce: bool = False) -> DataFrame:
        """Ranked memories; only those returned are recalled, if that is asked."""
        from lethe.operators.filters import filter_memories

        s = self.store.read()
        rows = filter_memories(self._view(s, "memories"), f)
        query = self.embed(text) if mode != "keyword" and self.embed else None
        if mode != "keyword" and query is None:
            raise InvalidArgument("no embedder is set up")
        ranked = search.search(rows, mode, text, self.vectors, query, self.ranking, limit, self.index)
        if reinforce:
            top = ranked.select("id").collect()  # bounded by the limit
            self.recall_memories([r.id for r in top])
        return ranked

    # --- events

    def store_event(self, name: str, event_id: str = "", significance: int = 0, group: str = "", time_start: int = 0, time_end: int = 0, description: str = "", metadata=None, above: str = "", below: str = "") -> str:
        s, now = self.store.read(), self.clock()
        if not (above or below) and 0 < significance < self.minimum_significance:
            return ""
        registry, level_id = self._level(s, "events", significance, above, below)
        event_id = event_id or f"event-{now}-{name}"[:128]
        row = self.spark.createDataFrame([(event_id, time_start or now, time_end, level_id, name, description, False, 0, self._group(group), metadata)], s.events.schema)
        bad = row.withColumn("significance", F.lit(significance)).select(mutate.invalid_event_reason()).first()[0]
        if bad:
            raise InvalidArgument(bad)
        mutate.unused(s.events, row)
        self.store.commit(changes.registered(s, registry).put("events", row))
        return event_id

    def ensure_event(self, event_id: str, **fields) -> bool:
        """Store an event unless it is there; whether it was stored."""
        try:
            self.store_event(fields.pop("name", event_id), event_id, **fields)
            return True
        except AlreadyExists:
            return False

    def store_event_with_memory(self, name: str, body: str, event: dict | None = None, **memory) -> tuple[str, str]:
        """(event id, memory id) of an event and its first memory; the event goes again if the memory is refused."""
        event_id = self.store_event(name, **(event or {}))
        try:
            return event_id, self.store_memory(body, event_id=event_id, **memory)
        except InvalidArgument:
            self.delete_event(event_id)
            raise

    def end_event(self, event_id: str, time_end: int = 0) -> None:
        s = self.store.read()
        self._need(s.events, self._ids([event_id]))
        change = self.spark.createDataFrame([(event_id, time_end or self.clock())], "id string, time_end long")
        self.store.commit(s.put("events", mutate.update(relations.by_ids(s.events, change), change)))

    def update_event_significance(self, event_id: str, significance: int = 0, above: str = "", below: str = "") -> None:
        s = self.store.read()
        self._need(s.events, self._ids([event_id]))
        registry, level_id = self._level(s, "events", significance, above, below)
        change = self.spark.createDataFrame([(event_id, level_id)], "id string, significance_level_id long")
        clear = ("significance_level_id",) if level_id is None else ()
        rows = relations.by_ids(s.events, change)
        self.store.commit(changes.registered(s, registry).put("events", mutate.update(rows, change, clear)))

    def merge_events(self, target: str, source: str) -> None:
        s = self.store.read()
        self._need(s.events, self._ids([target, source]))
        self.store.commit(s.put("memories", mutate.move_event(s.memories.where(F.col("event_id") == source), source, target)))

    def delete_event(self, event_id: str, with_memories: bool = False) -> None:
        """Delete an event; its memories go too, or stay without an event."""
        s, ids = self.store.read(), self._ids([event_id])
        self._need(s.events, ids)
        held = s.memories.where(F.col("event_id") == event_id)
        s = changes.removed(s, "memories", held.select("id"), self._write) if with_memories else s.put("memories", mutate.detach_event(held, event_id))
        self.store.commit(changes.removed(s, "events", ids, self._write))
        if with_memories:
            self._told(held.select("id"))

    def get_event(self, event_id: str) -> DataFrame:
        s = self.store.read()
        return listing.with_memories(relations.one(self._view(s, "events"), event_id), self._view(s, "memories").where(F.col("event_id") == event_id))

    def get_events(self, f: EventFilter = EventFilter(), order: str = "", ascending: bool | None = None, limit: int = 0, offset: int = 0) -> tuple[DataFrame, int]:
        s = self.store.read()
        limit, offset = listing.clamp_page(limit, offset)
        rows = self._view(s, "events")
        page = listing.list_events(rows, f, order, ascending, limit, offset)
        total = listing.total_if_needed(page.count(), limit, offset, lambda: listing.filter_events(rows, f).count())
        return listing.with_memories(page, self._view(s, "memories")), total

    # --- links

    def _linked(self, s: Snapshot, table: str, item_id: str, targets: dict[str, int], now: int) -> Snapshot:
        graph = s.tables[changes.GRAPHS[table]]
        self._need(s.tables[table], self._ids([item_id, *targets]))
        new = self.spark.createDataFrame([(item_id, t, v, now) for t, v in targets.items()], graph.schema)
        bad = links.invalid_links(new).first()
        if bad:
            raise InvalidArgument(f"link to {bad.to_id}: {bad.reason}")
        s = changes.linked(s, table, new)
        mine = s.tables[changes.GRAPHS[table]].where((F.col("from_id") == item_id) | (F.col("to_id") == item_id))
        if not links.over_capacity(mine, new.limit(0)).where(F.col("id") == item_id).isEmpty():
            raise InvalidArgument("too many links")
        return s

    def link_memories(self, memory_id: str, targets: dict[str, int]) -> None:
        self.store.commit(self._linked(self.store.read(), "memories", memory_id, targets, self.clock()))

    def link_events(self, event_id: str, targets: dict[str, int]) -> None:
        self.store.commit(self._linked(self.store.read(), "events", event_id, targets, self.clock()))

    def _unlink(self, table: str, item_id: str, targets) -> None:
        s = self.store.read()
        self._need(s.tables[table], self._ids([item_id]))
        there = self._ids(targets).select(F.lit(item_id).alias("from_id"), F.col("id").alias("to_id"))
        both = there.unionAll(there.select("to_id", "from_id"))
        self.store.commit(changes.unlinked(s, table, both, self._write))

    def unlink_memories(self, memory_id: str, targets) -> None:
        self._unlink("memories", memory_id, targets)

    def unlink_events(self, event_id: str, targets) -> None:
        self._unlink("events", event_id, targets)

    def get_memory_links(self, memory_id: str, direction: str = "both") -> DataFrame:
        s = self.store.read()
        self._need(s.memories, self._ids([memory_id]))
        return links.in_scope(links.edges_of(s.memory_links, memory_id, direction), s.memories, self.groups)

    def get_event_links(self, event_id: str, direction: str = "both") -> DataFrame:
        s = self.store.read()
        self._need(s.events, self._ids([event_id]))
        return links.in_scope(links.edges_of(s.event_links, event_id, direction), s.events, self.groups)

    # --- forgetting

    def sleep(self) -> cycle.Report:
        """One cycle; byte pressure follows the use that the last cycle measured."""
        self._unbound()
        step = self._summarised if self.summariser is not None and self.automatic_least else None
        before = self.store.read()
        after, self.last_report = cycle.run(before, self.clock(), self.decay, self.last_used, True, step, self.log_days, self.log_rows)
        self.last_used = self.last_report.used_bytes
        kept = self.store.commit(after)
        if self.on_deleted is not None:
            self._told(before.memories.select("id").join(kept.memories.select("id"), "id", "left_anti"))
        return self.last_report

    def _summarised(self, s: Snapshot) -> Snapshot:
        """The cycle's own summaries of full and quiet events."""
        view = lambda name: relations.resolved(s.tables[name], s.levels)
        for event_id, row in summarise.automatic(view("memories"), view("events"), self.summariser, self.clock(), self.automatic_least, self.automatic_quiet_days * DAY):
            s = self._with_summary(s, event_id, row)
        return s

    def preview_consolidation(self, limit: int = 50) -> tuple[list, bool]:
        self._unbound()
        s = self.store.read()
        used = forget.used_bytes(s.memories, s.events, s.memory_links, s.event_links).first()[0] if self.decay.capacity_bytes else 0
        n = s.memories.count() if self.decay.capacity_memories else 0
        found = forget.preview(self._view(s, "memories"), self._view(s, "events"), self.clock(), self.decay, used, decay.pressure(n, used, self.decay))
        return forget.preview_sample(found, limit)

    def explain_consolidation(self, ids) -> DataFrame:
        s, (asked, n) = self.store.read(), self._counted(ids)
        if n > MAX_EXPLAINED:
            raise InvalidArgument(f"at most {MAX_EXPLAINED} ids")
        self._need(s.memories, asked)
        asked = asked.withColumn("position", F.monotonically_increasing_id())  # at most MAX_EXPLAINED rows
        rows = forget.candidates(relations.by_ids(self._view(s, "memories"), asked), self._view(s, "events"))
        return forget.explain(rows, self.clock(), self.decay).join(asked, "id").orderBy("position").drop("position")

    def decay_curve(self, significance: float, max_age_days: float = 0.0, points: int = 60) -> DataFrame:
        return decay.curve(self.spark, significance, self.decay, decay.threshold(self.decay), max_age_days, points)

    def get_consolidation_status(self) -> DataFrame:
        r = self.last_report or cycle.Report()
        return self.spark.createDataFrame([tuple(r.__dict__.values())], list(r.__dict__))

    def get_forgotten_memories(self, **where) -> DataFrame:
        return forget.forgotten(self.store.read().tombstones, groups=self.groups, **where)

    def forgotten_page(self, limit: int = 100, **where) -> tuple[list, int]:
        """A page of the log and the cursor that continues it, 0 behind the last page."""
        page = self.get_forgotten_memories(limit=limit, **where).collect()  # bounded by the limit
        return page, forget.next_cursor(page, min(limit, 1000) if limit > 0 else 100)

    def count_forgotten_memories(self) -> int:
        return forget.count_forgotten(self.store.read().tombstones, self.groups).first()[0]

    def delete_forgotten_memories(self, before: int = 0, everything: bool = False) -> int:
        s = self.store.read()
        kept = forget.delete_forgotten(s.tombstones, before, everything, self.groups)
        gone = s.tombstones.select("seq").join(kept.select("seq"), "seq", "left_anti")
        n = gone.count()
        self.store.commit(s.drop("tombstones", gone))
        return n

    def get_summarisation_candidates(self, least: int = 10, quiet_days: int = 7, limit: int = 25) -> DataFrame:
        s = self.store.read()
        return forget.summarisation_candidates(self._view(s, "memories"), self._view(s, "events"), least, self.clock() - quiet_days * DAY, limit)

    def summarise_memories(self, event_id: str) -> None:
        if self.summariser is None:
            raise InvalidArgument("no summariser is set up")
        s = self.store.read()
        self._need(s.events, self._ids([event_id]))
        row = summarise.summary(self._view(s, "memories"), self._view(s, "events"), event_id, self.summariser, self.clock(), self.minimum_significance)
        self.store.commit(self._with_summary(s, event_id, row))

    def replace_memories_with_summary(self, event_id: str, summary: DataFrame) -> None:
        s = self.store.read()
        self._need(s.events, self._ids([event_id]))
        self.store.commit(self._with_summary(s, event_id, summary))

    def _with_summary(self, s: Snapshot, event_id: str, summary: DataFrame) -> Snapshot:
        """With one summary in place of an event's memories."""
        row = mutate.as_summary(summary, event_id)
        gone = s.memories.where(F.col("event_id") == event_id).select("id")
        return changes.removed(s, "memories", gone, self._write).put("memories", row.withColumn("link_significance", F.lit(0).cast("long")))

    # --- embeddings

    def embed_batch(self, bodies: DataFrame, rows: int = 64) -> DataFrame:
        """(id, vector) of (id, body), through the embedder in batches of at most ``rows`` bodies, inside tasks."""
        if self.embed is None:
            raise InvalidArgument("no embedder is set up")
        return search.embedded(bodies, self.embed, rows)

    def index_memories(self, ids=None) -> None:
        """Add the text memories' words and vectors to the index, all or some; what was there of them goes."""
        s = self.store.read()
        rows = self._view(s, "memories") if ids is None else relations.by_ids(self._view(s, "memories"), self._ids(ids))
        if self.index is not None:
            self.index.add(rows)
        if self.embed is not None:
            fresh = Scratch(self.spark, "vectors").write(self.embed_batch(rows.where(~F.col("is_binary"))), "fresh")
            self.vectors = fresh if self.vectors is None or ids is None else self.vectors.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)

    # --- the whole store

    def purge(self) -> None:
        self._unbound()
        self.store.purge()

    def export(self, path: str, clear: bool = False, max_rows: int = 0) -> DataFrame:
        """Write an archive of what the caller sees; the manifest names what clear_exported may remove."""
        s = self.store.read()
        manifest = archive.export(self.spark, s, path, self.groups, max_rows)
        if clear:
            self.clear_exported(manifest)
        return manifest

    def clear_exported(self, manifest: DataFrame) -> None:
        self.store.commit(archive.clear(self.store.read(), manifest))

    def backfill_links(self, name: str = "memories") -> None:
        """Take all link sums anew from the graph."""
        s = self.store.read()
        self.store.commit(changes.retotalled(s, name, s.tables[name].select("id")))

    def import_archive(self, path: str) -> None:
        self._unbound()
        self.store.commit(archive.ingest(self.store.read(), archive.read(self.spark, path)))

    def import_batch(self, **tables: DataFrame) -> None:
        """Upsert tables of resolved rows (events, memories, memory_links, event_links); times may lie in the past."""
        self._unbound()
        empty = {name: self.spark.createDataFrame([], schema) for name, schema in archive.KINDS.items()}
        self.store.commit(archive.ingest(self.store.read(), {**empty, **tables}))

    def transfer(self, target: Store, path: str) -> DataFrame:
        """Export, and push what was written to another store."""
        manifest = self.export(path)
        archive.transfer(archive.read(self.spark, path), target)
        return manifest

    def who_am_i(self) -> dict:
        return {"groups": list(self.groups), "search_modes": search.search_modes(self.vectors is not None and self.embed is not None)}


__all__ = ["AlreadyExists", "Engine", "InvalidArgument", "NotFound"]
