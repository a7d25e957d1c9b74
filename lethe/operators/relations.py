"""Resolved relations, lookups and paged scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.model import NotFound

MAX_BROADCAST_LEVELS = MAX_BROADCAST_IDS = 100_000


def resolved(items: DataFrame, levels: DataFrame, n_levels: int | None = None) -> DataFrame:
    """items with the rank of their significance level; unranked items have 0.

    The registry of levels is broadcast only when its counted size allows it.
    """
    n = levels.count() if n_levels is None else n_levels
    names = levels.select(F.col("id").alias("significance_level_id"), F.col("level_rank").alias("significance"))
    side = F.broadcast(names) if n <= MAX_BROADCAST_LEVELS else names
    return items.join(side, "significance_level_id", "left").withColumn("significance", F.coalesce("significance", F.lit(0)))


def page(items: DataFrame, after: str = "", limit: int = 500, groups: tuple[str, ...] = ()) -> DataFrame:
    """The next rows in id order."""
    scoped = items.where(F.col("group_name").isin(*groups)) if groups else items
    return scoped.where(F.col("id") > after).orderBy("id").limit(limit)


def indexable_page(memories: DataFrame, after: str = "", limit: int = 500) -> DataFrame:
    return page(memories.where(~F.col("is_binary")), after, limit)


def few(ids: DataFrame, n: int) -> DataFrame:
    """ids, counted as n: joins broadcast them if they are few, so that items needn't be shuffled to find them."""
    return F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items whose ids a table (id) holds."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def one(items: DataFrame, item_id: str) -> DataFrame:
    found = items.where(F.col("id") == item_id).limit(1)
    if found.isEmpty():
        raise NotFound(item_id)
    return found


def exists(items: DataFrame, item_id: str) -> bool:
    return not items.where(F.col("id") == item_id).isEmpty()


def missing(ids: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of (position, id) whose id no item has, in order of position."""
    return ids.join(items.select("id"), "id", "left_anti").orderBy("position")


def outside_groups(ids: DataFrame, items: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Ids that are absent or belong to groups outside the scope."""
    return missing(ids, items.where(F.col("group_name").isin(*groups)) if groups else items)


def of_events(memories: DataFrame, event_ids: DataFrame) -> DataFrame:
    return memories.join(event_ids.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi")


def unique_ids(ids: DataFrame) -> DataFrame:
    """(position, id) of the first occurrence of each id that isn't empty."""
    return ids.where(F.col("id") != "").groupBy("id").agg(F.min("position").alias("position"))
