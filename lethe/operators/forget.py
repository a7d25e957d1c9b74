"""Consolidation and eviction: what a store forgets, why, and what it would forget.

Decisions read narrow columns only; bodies enter as their sizes. Nothing is collected: doomed rows are
tables. Eviction takes records in ascending order of value (to nine decimals, so that a last bit decides nothing) and id until the bytes taken reach the
excess, by a prefix sum whose partitions are ranges of that order, so no task holds the whole store.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import decay
from lethe.functions.text import metadata_bytes
from lethe.model import DAY, LOG_ROW_BYTES, ROW_BYTES, RULE_CONSOLIDATION, RULE_EVICTION, Decay
from lethe.sources.scratch import Scratch


def body_bytes() -> Column:
    return F.octet_length("body").cast("long") + metadata_bytes(F.col("metadata"))


SPREAD = 1 << 16  # how many keys the memories of no event are dealt to


def candidates(memories: DataFrame, events: DataFrame | None) -> DataFrame:
    """One row for each memory with what decisions need; events that are gone count as none.

    Memories of no event have no partner: without ``events`` nothing is joined, and else they are dealt
    to tasks by their ids, since they all have the same, empty key.
    """
    narrow = memories.select("id", "event_id", "group_name", "significance", "link_significance", "timestamp", "time_recalled", "recall_count", "is_summary", body_bytes().alias("body_bytes"))
    if events is None:
        return narrow.withColumn("event_significance", F.lit(0)).withColumn("event_link_significance", F.lit(0).cast("long")).withColumn("has_event", F.lit(False))
    known = events.where(F.col("id") != "").select(F.col("id").alias("event_id"), F.col("significance").alias("event_significance"), F.col("link_significance").alias("event_link_significance"), F.lit(True).alias("has_event"), F.lit(0).alias("__spot"))
    narrow = narrow.withColumn("__spot", F.when(F.col("event_id") == "", 1 + F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)))
    out = narrow.join(known, ["event_id", "__spot"], "left").drop("__spot")
    return (
        out.withColumn("has_event", F.coalesce("has_event", F.lit(False)))
        .withColumn("event_significance", F.coalesce("event_significance", F.lit(0)))
        .withColumn("event_link_significance", F.coalesce("event_link_significance", F.lit(0)))
    )


def valued(rows: DataFrame, now: int, d: Decay, default_event: int | None = None) -> DataFrame:
    """Candidates with their value and whether they are inside the retention time."""
    since, s = decay.decay_timestamp(), decay.memory_significance(d, default_event)
    return rows.withColumn("effective", s).withColumn("value", decay.memory_value(s, since, now, d)).withColumn("retained", decay.retained(since, now, d))


def is_doomed(now: int, d: Decay, pressure: float = 1.0, default_event: int | None = None) -> Column:
    """Whether consolidation forgets a candidate."""
    return decay.forgettable(decay.memory_significance(d, default_event), decay.decay_timestamp(), now, d, pressure)


def doomed(rows: DataFrame, now: int, d: Decay, pressure: float = 1.0, default_event: int | None = None) -> DataFrame:
    """Candidates that consolidation forgets."""
    return rows.where(is_doomed(now, d, pressure, default_event))


def event_less(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("event_id") == "")


def by_event(rows: DataFrame, goes: Column) -> DataFrame:
    """(event_id, doomed, emptied): how many memories of each event go, and whether that leaves a known event empty."""
    out = rows.groupBy("event_id").agg(F.count_if(goes).alias("doomed"), F.count(F.lit(1)).alias("n"), F.max("has_event").alias("known"))
    return out.select("event_id", "doomed", "n", "known", (F.col("known") & (F.col("doomed") == F.col("n"))).alias("emptied"))


def emptied_events(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """(event_id) of known events all of whose memories go."""
    total = rows.where(F.col("has_event")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    lost = gone.where(F.col("has_event")).groupBy("event_id").agg(F.count(F.lit(1)).alias("m"))
    return total.join(lost, "event_id").where(F.col("n") == F.col("m")).select("event_id")


def empty_events(events: DataFrame, memories: DataFrame) -> DataFrame:
    """Events that no memory names."""
    held = memories.where(F.col("event_id") != "").select(F.col("event_id").alias("id"))
    return events.join(held, "id", "left_anti")


def doomed_events(events: DataFrame, memories: DataFrame, now: int, d: Decay, pressure: float = 1.0) -> DataFrame:
    """Empty events whose own significance has decayed."""
    since = F.greatest("time_start", "time_end")
    return empty_events(events, memories).where(decay.forgettable(decay.event_significance(d), since, now, d, pressure))


SMALL_ROWS = 200_000  # of numbers and ids: what one task puts in order


def prefix_sums(rows: DataFrame, order: list[str], amount: str, name: str = "before", n: int | None = None) -> DataFrame:
    """rows with the sum of ``amount`` over all rows that come earlier in the order.

    Rows are dealt to ranges of the order, sorted, added up inside each range and written: one shuffle.
    Each range's total is then added up over the ranges (as many rows as there are partitions). Where
    ``n``, their counted number, is small, one window does.
    """
    spark = rows.sparkSession
    if n is not None and n <= SMALL_ROWS:
        return rows.withColumn(name, F.coalesce(F.sum(amount).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    scratch = Scratch(spark, "prefix-sums")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__inside", F.lit(0).cast("long"))
    dealt = scratch.write(sorted_rows.mapInArrow(lambda batches: _running(batches, amount), sorted_rows.schema), "dealt")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__part").agg(F.sum(amount).alias("__sum")).withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    out = dealt.join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__offset") + F.col("__inside")).drop("__part", "__offset", "__inside")


def _running(batches, amount: str):
    """Batches of one sorted partition with the sum of what came before each row in ``__inside``."""
    before = 0
    for batch in batches:
        n = pc.fill_null(pc.cast(batch.column(amount), pa.int64()), 0)
        sums = pc.add(pc.cumulative_sum(n), before)
        yield batch.set_column(batch.schema.get_field_index("__inside"), "__inside", pc.subtract(sums, n))
        before = sums[-1].as_py() if len(sums) else before


def _step() -> Column:
    """A coarse step of value, of bounded number."""
    return F.when(F.col("place") <= 0, F.lit(-100_000)).otherwise(F.floor(F.log2("place") * 8).cast("int"))


def evicted(rows: DataFrame, excess: int) -> DataFrame:
    """Of valued candidates, those that eviction takes: the least valuable, none of them retained, while the bytes taken are short of the excess.

    Callers write rows first, since they are read twice: a histogram over coarse steps of value tells up
    to which step the excess reaches, so that only the low tail is put in order.
    """
    if excess <= 0:
        return rows.limit(0).withColumn("freed_before", F.lit(0).cast("long"))
    open_rows = rows.where(~F.col("retained")).withColumn("stored_bytes", F.col("body_bytes") + ROW_BYTES).withColumn("place", F.round("value", 9))
    steps = open_rows.groupBy(_step().alias("s")).agg(F.sum("stored_bytes").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()
    return _tail(open_rows, steps, excess)


def _tail(open_rows: DataFrame, steps: list, excess: int) -> DataFrame:
    taken, cut, n = 0, None, 0
    for r in steps:
        taken, cut, n = taken + r.b, r.s, n + r.n
        if taken >= excess:
            break
    tail = open_rows.where(_step() <= cut) if cut is not None else open_rows
    return prefix_sums(tail, ["place", "id"], "stored_bytes", "freed_before", n).where(F.col("freed_before") < excess).drop("stored_bytes", "place")


def used_bytes(memories: DataFrame, events: DataFrame, memory_links: DataFrame, event_links: DataFrame) -> DataFrame:
    """One row (used_bytes): the logical size of a store."""
    size = lambda rows, bytes_: rows.agg((F.count(F.lit(1)) * ROW_BYTES + F.coalesce(F.sum(bytes_), F.lit(0))).alias("b"))
    named = F.octet_length("name").cast("long") + F.octet_length("description") + metadata_bytes(F.col("metadata"))
    parts = [size(memories, body_bytes()), size(events, named), size(memory_links, F.lit(0)), size(event_links, F.lit(0))]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionAll(part)
    return total.agg(F.sum("b").alias("used_bytes"))


def log_bytes(tombstones: DataFrame) -> DataFrame:
    return tombstones.agg((F.count(F.lit(1)) * LOG_ROW_BYTES).alias("log_bytes"))


def retained_stats(memories: DataFrame, cutoff: int) -> DataFrame:
    """One row (n, bytes) of memories touched since the cutoff."""
    held = memories.where(decay.decay_timestamp() >= cutoff)
    return held.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(body_bytes()), F.lit(0)) + F.count(F.lit(1)) * ROW_BYTES).alias("bytes"))


def event_percentile(events: DataFrame, percent: float) -> DataFrame:
    """One row (significance): the nearest-rank percentile, unranked events counting as 0; null without events."""
    found = F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY significance)")
    return events.agg(found.cast("int").alias("significance"))


def default_event_significance(events: DataFrame, d: Decay) -> int:
    if not d.event_percentile:
        return d.default_event_significance
    found = event_percentile(events, d.event_percentile).first()[0]
    return d.default_event_significance if found is None else int(found)


def summarisation_candidates(memories: DataFrame, events: DataFrame, least: int, cutoff: int, limit: int = 0) -> DataFrame:
    """Events with enough unsummarised memories, none touched since the cutoff; the fullest first."""
    known = events.select(F.col("id").alias("event_id"), "name", F.col("group_name").alias("event_group"))
    rows = memories.where(~F.col("is_summary")).join(known, "event_id")
    out = rows.groupBy("event_id", "name", "event_group").agg(F.count(F.lit(1)).alias("n"), F.max(decay.decay_timestamp()).alias("newest"))
    out = out.where((F.col("n") >= least) & (F.col("newest") < cutoff)).orderBy(F.desc("n"), "event_id")
    return out.limit(limit) if limit else out


def count_forgotten(log: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """One row (n): the log's rows that a caller sees."""
    return (log.where(F.col("group_name").isin(*groups)) if groups else log).agg(F.count(F.lit(1)).alias("n"))


def next_cursor(page: list, limit: int) -> int:
    """The after_seq that continues below a full page of the log; 0 behind the last one."""
    return page[-1].seq if page and len(page) >= limit else 0


def tombstones(gone: DataFrame, rule: int, threshold: float, now: int, after_seq: int = 0) -> DataFrame:
    """Log rows of forgotten memories. seq follows ranges of id, so it is dense without a single sorting task."""
    gone = gone.select("id", "event_id", "group_name", "significance", "value", "body_bytes", "timestamp", "time_recalled", "recall_count")  # no more is shuffled
    numbered = prefix_sums(gone.withColumn("__one", F.lit(1).cast("long")), ["id"], "__one", "__before")
    return numbered.select(
        (F.col("__before") + after_seq + 1).cast("long").alias("seq"), "id", "event_id", "group_name", "significance", "value", F.lit(threshold).alias("threshold"), "body_bytes",
        F.lit(rule).alias("rule"), "timestamp", "time_recalled", "recall_count", F.lit(now).cast("long").alias("forgotten_at"),
    )


def forgotten(log: DataFrame, memory_id="", event_id="", group="", rule=0, since=0, until=0, after_seq=0, groups: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """A page of the log, newest first; after_seq continues below a page's last row."""
    rows = log
    for column, wanted in (("id", memory_id), ("event_id", event_id), ("group_name", group), ("rule", rule)):
        if wanted:
            rows = rows.where(F.col(column) == wanted)
    if since:
        rows = rows.where(F.col("forgotten_at") >= since)
    if until:
        rows = rows.where(F.col("forgotten_at") < until)
    if after_seq:
        rows = rows.where(F.col("seq") < after_seq)
    if groups:
        rows = rows.where(F.col("group_name").isin(*groups))
    return rows.orderBy(F.desc("seq")).limit(min(limit, 1000) if limit > 0 else 100)


def prune_log(log: DataFrame, now: int, max_age_days: int = 0, max_rows: int = 0) -> DataFrame:
    """The newest rows of the log, by age and by number."""
    if max_age_days:
        log = log.where(F.col("forgotten_at") >= now - max_age_days * DAY)
    if max_rows:
        top = log.agg(F.max("seq")).first()[0]
        if top is not None:
            dense = log.where(F.col("seq") > top - max_rows).count() == max_rows
            # Gaps in seq, from deletions, take the n-th newest row; a top-n, not a global sort.
            cut = top - max_rows + 1 if dense else (log.orderBy(F.desc("seq")).offset(max_rows - 1).limit(1).first() or [None])[0]
            log = log if cut is None else log.where(F.col("seq") >= cut)
    return log


def delete_forgotten(log: DataFrame, before: int = 0, everything: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    if not before and not everything:
        raise ValueError("name a time, or ask for everything")
    gone = F.lit(True) if everything else F.col("forgotten_at") < before
    if groups:
        gone = gone & F.col("group_name").isin(*groups)
    return log.where(~gone)


def unrecalled(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of a snapshot that nobody has recalled since."""
    keys = ["id", "time_recalled", "recall_count"]
    return snapshot.join(current.select(*keys), keys, "left_semi")


def explain(rows: DataFrame, now: int, d: Decay, pressure: float = 1.0) -> DataFrame:
    """Each candidate's age, value, threshold, decision, and days until it is forgotten."""
    limit = decay.threshold(d, pressure)
    since = decay.decay_timestamp()
    age = (F.lit(now) - since).cast("double") / F.lit(float(DAY))
    return valued(rows, now, d).select(
        "id", "event_id", age.alias("age_days"), "effective", "value", F.lit(limit).alias("threshold"), "retained",
        decay.forgettable(F.col("effective"), since, now, d, pressure).alias("due"),
        decay.days_until_forgotten(F.col("effective"), age, limit, d).alias("days_left"),
    )


def preview(memories: DataFrame, events: DataFrame, now: int, d: Decay, used: int = 0, pressure: float = 1.0) -> DataFrame:
    """What a cycle would forget: candidates with their rule. They are valued once and written.

    Consolidated rows free their bytes first; eviction takes the rest of the excess from what stays.
    """
    rows = valued(candidates(memories, events), now, d).withColumn("goes", F.coalesce(is_doomed(now, d, pressure), F.lit(False)))
    if not (d.capacity_bytes and used):
        return rows.where("goes").drop("goes").withColumn("rule", F.lit(RULE_CONSOLIDATION))
    rows = Scratch(memories.sparkSession, "preview").write(rows, "valued")
    sized = rows.withColumn("stored_bytes", F.col("body_bytes") + ROW_BYTES).withColumn("place", F.round("value", 9))
    step = F.when(F.col("goes"), F.lit(None)).when(F.col("retained"), F.lit(100_000)).otherwise(_step())
    steps = sized.groupBy(step.alias("s")).agg(F.sum("stored_bytes").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()
    left = used - sum(r.b for r in steps if r.s is None)
    first = rows.where("goes").drop("goes").withColumn("rule", F.lit(RULE_CONSOLIDATION))
    if left <= d.capacity_bytes:
        return first
    rest = sized.where(~F.col("goes") & ~F.col("retained")).drop("goes")
    second = _tail(rest, [r for r in steps if r.s is not None and r.s < 100_000], left - decay.eviction_floor(d))
    return first.unionByName(second.drop("freed_before").withColumn("rule", F.lit(RULE_EVICTION)))


def preview_sample(found: DataFrame, limit: int = 50) -> tuple[list, bool]:
    """The least valuable rows of a preview, and whether there are more."""
    got = found.orderBy("value", "id").limit(limit + 1).collect()  # bounded by the limit
    return got[:limit], len(got) > limit
