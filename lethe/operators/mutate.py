"""Mutations: functions from a table and its changes to the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.text import valid_metadata
from lethe.model import AlreadyExists

MAX_ID_BYTES, MAX_BODY_BYTES, SKEW = 128, 1 << 20, 300_000_000_000


def unused(items: DataFrame, new: DataFrame) -> None:
    """An id of new that is taken, or comes twice, is an error."""
    clash = new.join(items.select("id"), "id", "left_semi").select("id").unionAll(new.groupBy("id").count().where("count > 1").select("id"))
    found = clash.agg(F.min("id")).first()[0]
    if found is not None:
        raise AlreadyExists(found)


def insert(items: DataFrame, new: DataFrame) -> DataFrame:
    """items and new rows, of ids that aren't taken."""
    unused(items, new)
    return items.unionByName(new.select(*items.columns))


def insert_absent(items: DataFrame, new: DataFrame) -> DataFrame:
    """items and those new rows whose id isn't taken: replays change nothing."""
    fresh = new.dropDuplicates(["id"]).join(items.select("id"), "id", "left_anti")
    return items.unionByName(fresh.select(*items.columns))


def upsert(items: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of the same id, but for the link sum, which follows the graph."""
    latest = one_per_id(new)
    if "link_significance" in items.columns:
        kept = items.select("id", F.col("link_significance").alias("__links"))
        latest = latest.drop("link_significance").join(kept, "id", "left").withColumn("link_significance", F.coalesce("__links", F.lit(0)).cast("long"))
    return items.join(new.select("id"), "id", "left_anti").unionByName(latest.select(*items.columns))


def update(items: DataFrame, changes: DataFrame, clear: tuple[str, ...] = ()) -> DataFrame:
    """Partial update: unset fields of changes (null, '' or 0) leave what is there; cleared ones are reset.

    changes holds at most one row for an id, and any of the items' columns.
    """
    columns = [c for c in changes.columns if c != "id" and c in items.columns]
    renamed = changes.select("id", *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    out = items.join(renamed, "id", "left")
    kinds = {f.name: f.dataType.typeName() for f in items.schema.fields}
    for c in columns:
        new = F.col(f"__{c}")
        if kinds[c] == "string":
            new = F.nullif(new, F.lit(""))
        elif kinds[c] in ("integer", "long", "double"):
            new = F.nullif(new, F.lit(0))
        out = out.withColumn(c, F.coalesce(new, F.col(c)))
    blank = {"string": F.lit(""), "integer": F.lit(0), "long": F.lit(0).cast("long"), "boolean": F.lit(False)}
    for c in clear:
        out = out.withColumn(c, F.when(F.col("__hit"), blank.get(kinds[c], F.lit(None))).otherwise(F.col(c)))
    return out.select(*items.columns)


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti").select(*items.columns)


def detach_event(memories: DataFrame, event_id: str) -> DataFrame:
    return move_event(memories, event_id, "")


def move_event(memories: DataFrame, source: str, target: str) -> DataFrame:
    return memories.withColumn("event_id", F.when(F.col("event_id") == source, F.lit(target)).otherwise(F.col("event_id")))


def delete_event_if_empty(events: DataFrame, memories: DataFrame, event_id: str) -> DataFrame:
    held = memories.where(F.col("event_id") == event_id).select(F.col("event_id").alias("id")).distinct()
    return events.where(F.col("id") != event_id).unionByName(events.where(F.col("id") == event_id).join(held, "id", "left_semi"))


def recall(memories: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Each distinct id once: recalled now, and once more."""
    asked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    hit = F.coalesce("__hit", F.lit(False))
    out = memories.join(asked, "id", "left")
    out = out.withColumn("time_recalled", F.when(hit, F.lit(now)).otherwise(F.col("time_recalled"))).withColumn("recall_count", F.when(hit, F.col("recall_count") + 1).otherwise(F.col("recall_count")))
    return out.select(*memories.columns)


def reinforce(memories: DataFrame, neighbours: DataFrame, now: int, fraction: float) -> DataFrame:
    """Neighbours of recalled memories move a fraction of the way from their last touch to now, truncated."""
    asked = neighbours.select("id").distinct().withColumn("__hit", F.lit(True))
    base = F.greatest("timestamp", "time_recalled")
    moved = base + ((F.lit(now) - base).cast("double") * F.lit(fraction)).cast("long")
    out = memories.join(asked, "id", "left")
    out = out.withColumn("time_recalled", F.when(F.col("__hit") & (base < now), moved).otherwise(F.col("time_recalled")))
    return out.select(*memories.columns)


def as_summary(summary: DataFrame, event_id: str) -> DataFrame:
    """A row as the summary of an event, never recalled yet."""
    row = summary.withColumn("event_id", F.lit(event_id)).withColumn("is_summary", F.lit(True)).withColumn("is_binary", F.lit(False))
    return row.withColumn("time_recalled", F.lit(0).cast("long")).withColumn("recall_count", F.lit(0))


def replace_with_summary(memories: DataFrame, event_id: str, summary: DataFrame) -> DataFrame:
    """One summary row in place of an event's memories."""
    return memories.where(F.col("event_id") != event_id).unionByName(as_summary(summary, event_id).select(*memories.columns))


def flag_consolidated(events: DataFrame, seen: DataFrame) -> DataFrame:
    hit = seen.select(F.col("event_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    out = events.join(hit, "id", "left")
    return out.withColumn("memories_consolidated", F.col("memories_consolidated") | F.coalesce("__hit", F.lit(False))).select(*events.columns)


def below_minimum(new: DataFrame, minimum: int) -> Column:
    """Ranked, yet below what the store takes."""
    return (F.col("significance") > 0) & (F.col("significance") < minimum)


def invalid_reason(now: int, max_body: int = MAX_BODY_BYTES) -> Column:
    """Why validation refuses a memory; null if it doesn't."""
    return (
        F.when(F.octet_length("id") > MAX_ID_BYTES, "id")
        .when(F.octet_length("group_name") > MAX_ID_BYTES, "group")
        .when(F.col("body").isNull() | (F.octet_length("body") == 0), "body")
        .when(F.octet_length("body") > max_body, "size")
        .when(F.col("significance") < 0, "significance")
        .when((F.col("timestamp") < 0) | (F.col("timestamp") > now + SKEW), "timestamp")
        .when(~valid_metadata(F.col("metadata")), "metadata")
    )


def invalid_event_reason() -> Column:
    return (
        F.when(F.octet_length("id") > MAX_ID_BYTES, "id")
        .when((F.octet_length("name") == 0) | (F.octet_length("name") > 256), "name")
        .when(F.octet_length("description") > 1024, "description")
        .when(F.col("significance") < 0, "significance")
        .when((F.col("time_end") > 0) & (F.col("time_end") < F.col("time_start")), "time")
        .when(~valid_metadata(F.col("metadata")), "metadata")
    )


def with_defaults(new: DataFrame, now: int) -> DataFrame:
    """Missing ids and times filled in; the id is a hash of the row, so replays get the same one."""
    row_id = F.sha2(F.concat_ws("\u0001", *(F.col(c).cast("string") for c in new.columns if c not in ("id", "metadata"))), 256)
    return new.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", row_id).otherwise(F.col("id"))).withColumn("timestamp", F.when(F.coalesce("timestamp", F.lit(0)) == 0, F.lit(now)).otherwise(F.col("timestamp")))


def import_links(items: DataFrame, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, dropped): an upsert of links whose ends both exist; the others are returned apart."""
    from lethe.operators.links import existing_only, upsert_links

    good = existing_only(new, items)
    dropped = new.join(good, ["from_id", "to_id"], "left_anti")
    return upsert_links(links, good), dropped


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row for each id, whatever the order of rows: the one whose hash of all columns is smallest."""
    spot = F.xxhash64(*(F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes))
    return rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), spot).alias("one")).select("one.*")


def newest_per_id(rows: DataFrame, by: str) -> DataFrame:
    """Each id's row with the largest ``by``; of equal ones, that of the smallest hash."""
    spot = F.xxhash64(*(F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes))
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct(by, spot)).alias("one")).select("one.*")
