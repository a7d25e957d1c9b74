"""The associative graph: directed edges whose value counts for both ends. One hop only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.model import InvalidArgument

MAX_LINKS, MAX_LINK_SIGNIFICANCE = 128, 1_000_000


def ends(links: DataFrame) -> DataFrame:
    """(id, other, significance, created, direction) of both ends of each edge."""
    out = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "significance", "created", F.lit("out").alias("direction"))
    back = links.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "significance", "created", F.lit("in").alias("direction"))
    return out.unionAll(back)


def edges_of(links: DataFrame, item_id: str, direction: str = "both") -> DataFrame:
    if direction not in ("in", "out", "both"):
        raise InvalidArgument("direction is in, out or both")
    rows = ends(links).where(F.col("id") == item_id)
    return rows if direction == "both" else rows.where(F.col("direction") == direction)


def neighbours(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of items one hop from the seeds, in either direction, the seeds left out."""
    start = seeds.select("id").distinct()
    near = ends(links).join(start, "id", "left_semi").select(F.col("other").alias("id")).distinct()
    return near.join(start, "id", "left_anti")


def linked_to(items: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    return items.join(neighbours(links, seeds), "id", "left_semi")


def with_linked(ranked: DataFrame, items: DataFrame, links: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """ranked rows and, after them, their neighbours in scope; column linked tells which."""
    near = linked_to(items, links, ranked)
    if groups:
        near = near.where(F.col("group_name").isin(*groups))
    return ranked.withColumn("linked", F.lit(False)).unionByName(near.withColumn("linked", F.lit(True)), allowMissingColumns=True)


def link_totals(links: DataFrame) -> DataFrame:
    """(id, link_significance): the sum over both ends, as BIGINT."""
    return ends(links).groupBy("id").agg(F.sum(F.col("significance").cast("long")).alias("link_significance"))


def with_totals(items: DataFrame, links: DataFrame) -> DataFrame:
    """items with link_significance taken anew from the edges."""
    fresh = link_totals(links).withColumnRenamed("link_significance", "__total")
    out = items.join(fresh, "id", "left").withColumn("link_significance", F.coalesce("__total", F.lit(0)))
    return out.select(*items.columns)


def outgoing(items: DataFrame, links: DataFrame) -> DataFrame:
    """items with an array of their outgoing links, in order of target."""
    held = links.groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("to_id", "significance"))).alias("links"))
    out = items.join(held, items["id"] == held["from_id"], "left").drop("from_id")
    return out.withColumn("links", F.coalesce("links", F.array().cast("array<struct<to_id:string,significance:int>>")))


def in_scope(edges: DataFrame, items: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Edges whose far end lies in the caller's groups."""
    if not groups:
        return edges
    known = items.where(F.col("group_name").isin(*groups)).select(F.col("id").alias("other"))
    return edges.join(known, "other", "left_semi")


def existing_only(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links between items that are there, without links of an item to itself."""
    ids = items.select("id")
    kept = links.where(F.col("from_id") != F.col("to_id"))
    return kept.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*links.columns)


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of new replace their significance and keep when they were first made."""
    made = links.select("from_id", "to_id", F.col("created").alias("__first"))
    fresh = new.join(made, ["from_id", "to_id"], "left").withColumn("created", F.coalesce("__first", "created")).drop("__first")
    return links.join(new, ["from_id", "to_id"], "left_anti").select(*links.columns).unionByName(fresh.select(*links.columns))


def delete_links(links: DataFrame, item_id: str, targets: DataFrame) -> DataFrame:
    """links without those between an item and its targets, whichever way they point."""
    gone = targets.select(F.lit(item_id).alias("from_id"), F.col("id").alias("to_id"))
    gone = gone.unionAll(gone.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return links.join(gone, ["from_id", "to_id"], "left_anti")


def prune(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """links without those of deleted items."""
    ids = deleted.select("id").distinct()
    kept = links.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    return kept.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*links.columns)


def invalid_links(links: DataFrame) -> DataFrame:
    """(from_id, to_id, reason) of links that validation refuses."""
    per_pair = links.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("copies"), F.min("significance").alias("low"), F.max("significance").alias("high"))
    many = links.groupBy("from_id").agg(F.count(F.lit(1)).alias("n"))
    reason = (
        F.when(F.col("from_id") == F.col("to_id"), "self")
        .when(F.col("copies") > 1, "duplicate")
        .when((F.col("low") < 0) | (F.col("high") > MAX_LINK_SIGNIFICANCE), "significance")
        .when(F.col("n") > MAX_LINKS, "too many")
    )
    return per_pair.join(many, "from_id").select("from_id", "to_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def over_capacity(links: DataFrame, new: DataFrame) -> DataFrame:
    """(id, n) of items that would have too many distinct neighbours."""
    return ends(links.unionByName(new)).groupBy("id").agg(F.count_distinct("other").alias("n")).where(F.col("n") > MAX_LINKS)
