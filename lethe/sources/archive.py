"""Archives: a store's events and memories as compressed JSON lines, with a header of version 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.model import EVENTS, LINKS, MEMORIES, StoreError
from lethe.sources.scratch import Scratch
from lethe.sources.snapshots import Snapshot

VERSION = 1
BATCH_BYTES = 3 << 20
KINDS = {"events": EVENTS.replace("significance_level_id long", "significance int"), "memories": MEMORIES.replace("significance_level_id long", "significance int"), "memory_links": LINKS, "event_links": LINKS}


def export(spark: SparkSession, snapshot: Snapshot, path: str, groups: tuple[str, ...] = (), max_rows: int = 0) -> DataFrame:
    """Write an archive of resolved rows; returns its manifest (id, time_recalled, recall_count) of the memories."""
    from lethe.operators.relations import resolved

    scoped = lambda items: items.where(F.col("group_name").isin(*groups)) if groups else items
    tables = {name: scoped(resolved(snapshot.tables[name], snapshot.tables["levels"])) for name in ("events", "memories")}
    tables |= {name: snapshot.tables[name] for name in ("memory_links", "event_links")}
    if max_rows and tables["events"].count() + tables["memories"].count() > max_rows:
        raise StoreError(f"more than {max_rows} rows: too many for a manifest")
    for name, rows in tables.items():
        wanted = [c.split()[0] for c in KINDS[name].split(", ")]
        rows.select(*wanted).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/header")
    return spark.read.schema(KINDS["memories"]).json(f"{path}/memories").select("id", "time_recalled", "recall_count")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An archive's tables; a wrong version or a broken record is an error."""
    version = spark.read.schema("version int").json(f"{path}/header").first()
    if version is None or version[0] != VERSION:
        raise StoreError(f"not an archive of version {VERSION}")
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in KINDS.items()}


def ingest(snapshot: Snapshot, archive: dict[str, DataFrame]) -> Snapshot:
    """Upsert an archive's rows; links follow once both their ends exist."""
    from lethe.operators.levels import attach_levels, register_ranks
    from lethe.operators.links import existing_only
    from lethe.operators.mutate import one_per_id
    from lethe.plans.changes import GRAPHS, linked, registered

    spark = snapshot.tables["levels"].sparkSession
    scratch = Scratch(spark, "ingest")
    levels = scratch.write(register_ranks(snapshot.tables["levels"], archive["events"], archive["memories"]), "levels")
    out = registered(snapshot, levels)
    for name, graph in GRAPHS.items():
        # Only rows of ids that come several times meet by id; of an archive that holds a table once, none do.
        repeated = scratch.write(archive[name].groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id"), f"{name}-repeated")
        rows = archive[name]
        if not repeated.isEmpty():
            at = lambda how: rows.join(repeated.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")), how)  # noqa: B023, E731
            rows = at("left_anti").unionByName(one_per_id(at("left_semi")))
        rows = attach_levels(rows, levels)
        if snapshot.tables[name].isEmpty():
            out = out.replace(**{name: rows.withColumn("link_significance", F.lit(0).cast("long")).select(*snapshot.tables[name].columns)})
        else:
            kept = snapshot.tables[name].select("id", F.col("link_significance").alias("kept"))
            rows = rows.join(kept, "id", "left").withColumn("link_significance", F.coalesce("kept", F.lit(0)).cast("long"))  # it follows the graph
            out = out.put(name, rows)
        if archive[graph].isEmpty():
            continue
        out = linked(out, name, existing_only(archive[graph].dropDuplicates(["from_id", "to_id"]), out.tables[name]))
    return out


def clear(snapshot: Snapshot, manifest: DataFrame) -> Snapshot:
    """Without the exported memories that nobody has recalled since, and without the events that this empties."""
    from lethe.operators.forget import unrecalled
    from lethe.plans.changes import removed

    scratch = Scratch(manifest.sparkSession, "clear")
    memories = snapshot.tables["memories"].select("id", "event_id", "time_recalled", "recall_count")
    gone = scratch.write(unrecalled(manifest, memories).select("id", "event_id"), "gone")
    count = lambda rows, n: rows.where(F.col("event_id") != "").groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias(n))
    emptied = count(gone, "went").join(count(memories, "held"), "id").where(F.col("went") == F.col("held"))
    emptied = scratch.write(emptied.join(snapshot.tables["events"].select("id"), "id", "left_semi").select("id"), "emptied")
    return removed(removed(snapshot, "memories", gone, scratch.write), "events", emptied, scratch.write)


def transfer(archive_tables: dict[str, DataFrame], target) -> Snapshot:
    """Push tables to another store and commit there."""
    return target.commit(ingest(target.read(), archive_tables))


def byte_batches(rows: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """rows with a batch number, each batch of at most about ``most`` serialised bytes."""
    from lethe.functions.text import transfer_bytes
    from lethe.operators.forget import prefix_sums

    sized = rows.withColumn("__bytes", transfer_bytes())
    return prefix_sums(sized, ["id"], "__bytes", "__before").withColumn("batch", F.floor(F.col("__before") / F.lit(most)).cast("long")).drop("__bytes", "__before")
