"""What cycles, archives and promotion shuffle: no join of memories that belong to no event, no wide join by rank or id."""

from pyspark.sql import functions as F

from lethe.operators import forget, levels
from lethe.plans import queries as Q
from lethe.sources import archive
from lethe.sources import driver_tables as D
from lethe.sources.snapshots import empty

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_memories_of_no_event_are_not_shuffled_to_find_none(spark):
    assert "Exchange hashpartitioning" not in plan(Q.consolidate_eventless(spark, DIR))


def test_memories_of_no_event_are_dealt_to_many_tasks(spark):
    """Their join key holds more than the empty event id, and they still find no event."""
    rows = Q.mem(spark, DIR)
    events = Q.ev(spark, DIR).unionByName(Q.ev(spark, DIR).limit(1).withColumn("id", F.lit("")))
    found = forget.candidates(rows, events)
    assert "__spot" in plan(found)
    assert found.where("has_event AND event_id = ''").isEmpty() and found.count() == rows.count()
    assert not found.where("has_event").isEmpty()


def test_prefix_sums_take_one_shuffle_and_are_exact(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 11).alias("n"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("m")).repartition(7)
    got = forget.prefix_sums(rows, ["k"], "n")
    assert plan(got).count("Exchange hashpartitioning") == 1  # the ranges' totals
    before = 0
    for r in got.orderBy("k").collect():
        assert r.before == before
        before += r.n


def test_ranks_are_not_shuffled_to_their_levels(spark):
    got = levels.attach_levels(Q.mem(spark, DIR), D.levels(spark))
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)


def test_an_archive_with_repeated_and_null_ids(spark):
    base = Q.mem(spark, DIR).limit(3)
    some = base.drop("significance_level_id").collect()
    rows = base.drop("significance_level_id").sparkSession.createDataFrame(some, base.drop("significance_level_id").schema)
    names = [c.split()[0] for c in archive.KINDS["memories"].split(", ")]
    rows = rows.select(*names)
    null = rows.limit(2).withColumn("id", F.lit(None).cast("string"))
    again = rows.where(F.col("id") == some[0].id).withColumn("body", F.lit("another"))
    none = {k: spark.createDataFrame([], archive.KINDS[k]) for k in ("events", "memory_links", "event_links")}
    s = archive.ingest(empty(spark), {**none, "memories": rows.unionByName(again).unionByName(null)})
    assert sorted(str(r.id) for r in s.memories.select("id").collect()) == sorted([*(r.id for r in some), "None"])


