"""The store's calls, end to end."""

import pytest
from pyspark.sql import functions as F

from lethe.engine import AlreadyExists, Engine, InvalidArgument, NotFound
from lethe.model import DAY, Decay, EventFilter, MemoryFilter
from lethe.sources.snapshots import Store

NOW = 1000 * DAY


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(Store(spark, f"file://{tmp_path}/store"), lambda: NOW, Decay(method=1, unit_days=10.0, threshold=0.6), reinforce_fraction=0.5, summariser=lambda name, group, bodies: f"{name}: {len(bodies)}")
    e.store_event("first", "e1", 5, "a", time_start=NOW - 100 * DAY)
    e.store_memory("hello world", "m1", 10, "e1", "a", NOW - 90 * DAY)
    e.store_memory("good night world", "m2", 1, "e1", "a", NOW - 90 * DAY)
    e.store_memory("other words", "m3", 20, "", "b", NOW - DAY, linked={"m1": 7})
    return e


def ids(df):
    return sorted(r.id for r in df.collect())


def test_storing_and_listing(engine):
    page, total = engine.get_memories(order="significance")
    assert [r.id for r in page.orderBy(F.desc("significance")).collect()] == ["m3", "m1", "m2"] and total == 3
    assert {r.id: r.link_significance for r in page.collect()} == {"m1": 7, "m2": 0, "m3": 7}
    assert ids(engine.get_memories(linked_to="m1")[0]) == ["m3"]
    with pytest.raises(AlreadyExists):
        engine.store_memory("x", "m1")
    with pytest.raises(InvalidArgument):
        engine.store_memory("")
    above = engine.store_memory("placed", "m4", above="m1")
    assert engine.get_memories(MemoryFilter(ids=(above,)))[0].first().significance == 11
    engine.minimum_significance = 5
    assert engine.store_memory("too little", "m5", 2) == ""
    found, total = engine.get_events(EventFilter(group="a"))
    assert (found.first().memory_count, total) == (2, 1)
    assert engine.get_event("e1").first().memory_count == 2


def test_changes(engine, spark):
    engine.update_memory(spark.createDataFrame([("m2", "changed", 33)], "id string, body string, significance int"))
    row = engine.get_memories(MemoryFilter(ids=("m2",)))[0].first()
    assert (row.body, row.significance) == ("changed", 33)
    engine.end_event("e1")
    engine.update_event_significance("e1", 9)
    event = engine.get_event("e1").first()
    assert (event.time_end, event.significance) == (NOW, 9)
    engine.store_event("second", "e2")
    engine.merge_events("e2", "e1")
    assert ids(engine.get_memories(MemoryFilter(event_id="e2"))[0]) == ["m1", "m2"]
    engine.delete_event("e2")
    assert ids(engine.get_memories(MemoryFilter(has_event=True))[0]) == []
    engine.delete_event("e1", with_memories=True)
    assert engine.delete_memories(["m1", "zz"]) == 1
    assert {r.id: r.link_significance for r in engine.get_memories()[0].collect()} == {"m2": 0, "m3": 0}
    with pytest.raises(NotFound):
        engine.end_event("zz")


def test_recall_search_and_links(engine):
    got = engine.recall_memories(["m1", "m1"], include_linked=True)
    assert {(r.id, r.linked, r.recall_count) for r in got.collect()} == {("m1", False, 1), ("m3", True, 0)}
    assert engine.get_memories(MemoryFilter(ids=("m3",)))[0].first().time_recalled == NOW - DAY // 2
    assert [r.id for r in engine.search_memories("hello", reinforce=True).collect()] == ["m1"]
    assert engine.get_memories(MemoryFilter(ids=("m1",)))[0].first().recall_count == 2
    with pytest.raises(InvalidArgument):
        engine.search_memories("x", "semantic")
    engine.link_memories("m1", {"m2": 3})
    assert {(r.other, r.direction) for r in engine.get_memory_links("m1").collect()} == {("m2", "out"), ("m3", "in")}
    engine.unlink_memories("m2", ["m1"])
    assert engine.get_memory_links("m1", "out").count() == 0
    with pytest.raises(InvalidArgument):
        engine.link_memories("m1", {"m1": 3})
    with pytest.raises(NotFound):
        engine.link_memories("m1", {"zz": 3})
    engine.store_event("second", "e2")
    engine.link_events("e1", {"e2": 4})
    assert engine.get_event_links("e2").first().other == "e1"
    engine.unlink_events("e1", ["e2"])
    assert engine.get_event_links("e2").count() == 0


def test_forgetting(engine):
    told, more = engine.preview_consolidation()
    assert not more
    explained = {r.id: r.due for r in engine.explain_consolidation(["m1", "m2", "m3"]).collect()}
    assert {r.id for r in told} == {i for i, due in explained.items() if due}
    report = engine.sleep()
    log = engine.get_forgotten_memories()
    assert {r.id for r in log.collect()} == {r.id for r in told} and report.memories_consolidated == len(told)
    assert engine.get_consolidation_status().first().memories_consolidated == len(told)
    assert engine.delete_forgotten_memories(everything=True) == len(told)
    assert engine.decay_curve(10.0, points=5).count() == 5


def test_summaries(engine):
    assert [r.event_id for r in engine.get_summarisation_candidates(2).collect()] == ["e1"]
    engine.summarise_memories("e1")
    row = engine.get_memories(MemoryFilter(event_id="e1"))[0].collect()
    assert [(r.body, r.is_summary, r.significance) for r in row] == [("first: 2", True, 10)]
    assert engine.get_memory_links("m3").count() == 0


def test_groups_bound_a_caller(engine):
    bound = Engine(engine.store, engine.clock, engine.decay, groups=("b",))
    assert ids(bound.get_memories()[0]) == ["m3"]
    assert bound.get_memory_links("m3").count() == 0
    for call in (lambda: bound.recall_memories(["m1"]), lambda: bound.get_memory_links("m1"), lambda: bound.end_event("e1")):
        with pytest.raises(NotFound):
            call()
    for call in (bound.sleep, bound.purge, bound.preview_consolidation):
        with pytest.raises(InvalidArgument):
            call()
    assert bound.store_memory("mine", "m9") == "m9"
    assert bound.who_am_i() == {"groups": ["b"], "search_modes": ["keyword"]}


def test_moving_stores(engine, spark, tmp_path):
    manifest = engine.export(f"file://{tmp_path}/archive")
    other = Store(spark, f"file://{tmp_path}/other")
    engine.transfer(other, f"file://{tmp_path}/moved")
    assert ids(other.read().memories) == ["m1", "m2", "m3"]
    engine.recall_memories(["m1"])
    engine.clear_exported(manifest)
    # m1 was recalled since, and m3 moved with it as a neighbour.
    assert ids(engine.get_memories()[0]) == ["m1", "m3"] and ids(engine.get_events()[0]) == ["e1"]
    engine.import_archive(f"file://{tmp_path}/archive")
    assert ids(engine.get_memories()[0]) == ["m1", "m2", "m3"]
    rows = engine.store.read().memories.drop("significance_level_id").withColumn("id", F.concat(F.lit("n"), "id")).withColumn("significance", F.lit(4))
    engine.import_batch(memories=rows)
    assert engine.get_memories()[1] == 6
    engine.purge()
    assert engine.get_memories()[1] == 0
