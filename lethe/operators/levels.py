"""The registry of significance levels: unique ranks, placed relative to each other.

The registry is small: one row for each rank in use. Ranks shift inside one immutable snapshot, so
no intermediate state can collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.model import LEVELS, InvalidPlacement

COMPACT_FROM = 1 << 30


def anchor_rank(items: DataFrame, levels: DataFrame, item_id: str) -> int:
    """The rank of an item that another is placed against."""
    row = items.where(F.col("id") == item_id).join(levels, items["significance_level_id"] == levels["id"]).select("level_rank").first()
    if row is None:
        raise InvalidPlacement(f"{item_id} is unknown or unranked")
    return row[0]


def open_gap(levels: DataFrame, rank: int) -> DataFrame:
    """Every rank from this one on moves up by one."""
    return levels.withColumn("level_rank", F.when(F.col("level_rank") >= rank, F.col("level_rank") + 1).otherwise(F.col("level_rank")))


def compact(levels: DataFrame) -> DataFrame:
    """Ranks 1 to n in the same order."""
    return levels.withColumn("level_rank", F.row_number().over(Window.orderBy("level_rank")))


def too_high(levels: DataFrame) -> bool:
    top = levels.agg(F.max("level_rank")).first()[0]
    return top is not None and top >= COMPACT_FROM


def compact_if_high(levels: DataFrame) -> DataFrame:
    return compact(levels) if too_high(levels) else levels


def from_significance(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, items with level ids) of a table that still holds bare significance, as stores did before the registry."""
    levels = register_ranks(items.sparkSession.createDataFrame([], LEVELS), items)
    return levels, attach_levels(items, levels).drop("significance")


def target_rank(above: int | None = None, below: int | None = None) -> int:
    """Where a placement lands: just above an anchor, or at an anchor that moves up, or between two."""
    if above is not None and below is not None and above >= below:
        raise InvalidPlacement("the lower anchor has to rank below the higher one")
    if above is not None:
        return above + 1
    if below is None:
        raise InvalidPlacement("a placement needs an anchor")
    return max(1, below)


def _add(levels: DataFrame, rank: int) -> tuple[DataFrame, int]:
    top = levels.agg(F.max("id")).first()[0] or 0
    row = levels.sparkSession.createDataFrame([(top + 1, rank)], levels.schema)
    return levels.unionByName(row), top + 1


def place(levels: DataFrame, above: int | None = None, below: int | None = None) -> tuple[DataFrame, int, int]:
    """(levels, level id, rank) after placing a new level; taken ranks move up."""
    rank = target_rank(above, below)
    taken = not levels.where(F.col("level_rank") == rank).isEmpty()
    levels, level_id = _add(open_gap(levels, rank) if taken else levels, rank)
    return levels, level_id, rank


def find_or_create(levels: DataFrame, rank: int) -> tuple[DataFrame, int | None]:
    """(levels, level id) of a rank; unranked has no level."""
    if rank <= 0:
        return levels, None
    row = levels.where(F.col("level_rank") == rank).first()
    return (levels, row["id"]) if row else _add(levels, rank)


def register_ranks(levels: DataFrame, *items: DataFrame) -> DataFrame:
    """levels with a level for each rank that a table's significance column uses and none has yet."""
    used = items[0].select("significance")
    for more in items[1:]:
        used = used.union(more.select("significance"))
    ranks = used.where(F.col("significance") > 0).distinct().select(F.col("significance").alias("level_rank"))
    new = ranks.join(levels, "level_rank", "left_anti")
    top = levels.agg(F.max("id")).first()[0] or 0
    numbered = new.withColumn("id", (F.row_number().over(Window.orderBy("level_rank")) + top).cast("long"))
    return levels.unionByName(numbered.select("id", F.col("level_rank").cast("int").alias("level_rank")))


def attach_levels(items: DataFrame, levels: DataFrame) -> DataFrame:
    """items with the level id of their rank; unranked ones have none.

    The registry is broadcast only when its counted size allows it, since a rank can be very common.
    """
    from lethe.operators.relations import MAX_BROADCAST_LEVELS

    names = levels.select(F.col("level_rank").alias("significance"), F.col("id").alias("significance_level_id"))
    side = F.broadcast(names) if levels.count() <= MAX_BROADCAST_LEVELS else names
    return items.drop("significance_level_id").join(side, "significance", "left")
