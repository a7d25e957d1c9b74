"""Changes of a store that keep its tables in step: what goes takes its links along, and link sums follow.

Each writes rows in proportion to what changes, not to the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.operators import links
from lethe.sources.snapshots import Snapshot

GRAPHS = {"memories": "memory_links", "events": "event_links"}
Write = Callable[[DataFrame, str], DataFrame]


def as_it_is(rows: DataFrame, name: str) -> DataFrame:
    return rows


def retotalled(s: Snapshot, name: str, ids: DataFrame, write: Write = as_it_is) -> Snapshot:
    """With the link sums of these items taken anew."""
    asked = ids.select("id").distinct()
    sums = links.ends(s.tables[GRAPHS[name]]).join(asked, "id", "left_semi").groupBy("id").agg(F.sum(F.col("significance").cast("long")).alias("new"))
    rows = s.tables[name].join(asked, "id", "left_semi").join(sums, "id", "left").withColumn("new", F.coalesce("new", F.lit(0).cast("long")))
    rows = rows.where(~F.col("new").eqNullSafe(F.col("link_significance"))).withColumn("link_significance", F.col("new"))
    return s.put(name, write(rows.select(*s.tables[name].columns), f"{name}-sums"))


def linked(s: Snapshot, name: str, edges: DataFrame) -> Snapshot:
    """With edges, in place of those between the same ends; the first time of each stays."""
    graph = s.tables[GRAPHS[name]]
    made = graph.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_semi").select("from_id", "to_id", F.col("created").alias("first"))
    fresh = edges.join(made, ["from_id", "to_id"], "left").withColumn("created", F.coalesce("first", "created"))
    return retotalled(s.put(GRAPHS[name], fresh.select(*graph.columns)), name, both_ends(edges))


def unlinked(s: Snapshot, name: str, edges: DataFrame, write: Write = as_it_is) -> Snapshot:
    """Without edges between these ends."""
    edges = write(edges.select("from_id", "to_id"), f"{name}-edges")
    if edges.isEmpty():
        return s
    return retotalled(s.drop(GRAPHS[name], edges), name, both_ends(edges), write)


def both_ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("id")).unionAll(edges.select(F.col("to_id").alias("id")))


def removed(s: Snapshot, name: str, gone: DataFrame, write: Write = as_it_is) -> Snapshot:
    """Without these items and their links; their neighbours' sums follow."""
    ids, graph = gone.select("id"), s.tables[GRAPHS[name]]
    if graph.isEmpty():
        return s.drop(name, ids)
    at = lambda end: graph.join(ids.withColumnRenamed("id", end), end, "left_semi").select("from_id", "to_id")
    touching = at("from_id").unionAll(at("to_id")).distinct()
    return unlinked(s.drop(name, ids), name, touching, write)


def emptied(s: Snapshot, touched: DataFrame) -> DataFrame:
    """(id) of those of some events that hold no memory any more."""
    ids = touched.select("id").where(F.col("id") != "").distinct()
    held = s.memories.join(ids.select(F.col("id").alias("event_id")), "event_id", "left_semi").select(F.col("event_id").alias("id"))
    return s.events.join(ids, "id", "left_semi").select("id").join(held, "id", "left_anti")


def registered(s: Snapshot, registry: DataFrame) -> Snapshot:
    """With the registry's levels that are new or have moved."""
    return s if registry is s.levels else s.put("levels", registry.join(s.levels, ["id", "level_rank"], "left_anti"))
