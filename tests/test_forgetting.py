"""Decay curves, decisions, eviction, the cycle and its preview."""

import math

import pytest
from pyspark.sql import functions as F

from lethe.functions import decay
from lethe.model import DAY, NEVER, RULE_CONSOLIDATION, RULE_EVICTION, Decay
from lethe.operators import forget
from lethe.plans import cycle
from lethe.sources.snapshots import Snapshot, empty

NOW = 1000 * DAY


def value_of(spark, s, age, **settings):
    return spark.range(1).select(decay.value(F.lit(float(s)), F.lit(float(age)), Decay(**settings))).first()[0]


@pytest.mark.parametrize(
    ("settings", "s", "age", "want"),
    [
        ({"method": 1, "aggressiveness": 1.0}, 3, 2, 1.5),
        ({"method": 2, "aggressiveness": 0.0}, 6, 3, 2.0),
        ({"method": 3, "aggressiveness": 1.0}, 6, 3, 2.0),
        ({"method": 3, "aggressiveness": 0.1}, 6, 3, NEVER),
        ({"method": 3, "aggressiveness": 0.0}, 6, 3, NEVER),
        ({"method": 4, "aggressiveness": math.log(2)}, 8, 2, 2.0),
        ({"method": 4, "aggressiveness": 1.0}, 8, 1e5, 0.0),
        ({"method": 5, "aggressiveness": 2.0}, 8, 0, 4.0),
        ({"method": 5, "aggressiveness": 0.0}, 8, 1, NEVER),
        ({"method": 6, "aggressiveness": 10.0}, 8, 10, 4.0),
        ({"method": 6, "aggressiveness": 0.0}, 8, 1, 0.0),
        ({"method": 9}, 8, 1, NEVER),
    ],
)
def test_curves(spark, settings, s, age, want):
    assert value_of(spark, s, age, **settings) == pytest.approx(want)


@pytest.mark.parametrize("method", [1, 2, 3, 4, 5, 6])
def test_crossing_is_where_the_value_meets_the_limit(spark, method):
    d = Decay(method=method, aggressiveness=1.2)
    age = spark.range(1).select(decay.crossing_units(F.lit(50.0), 2.0, d)).first()[0]
    if age == -1:
        assert value_of(spark, 50, 1e6, method=method, aggressiveness=1.2) >= 2
    else:
        assert value_of(spark, 50, age, method=method, aggressiveness=1.2) == pytest.approx(2.0)


def test_pressure_and_floor():
    assert decay.pressure(5, 0, Decay()) == 1.0
    assert decay.pressure(50, 0, Decay(capacity_memories=100, pressure_exponent=2.0)) == 1.25
    assert decay.pressure(50, 90, Decay(capacity_memories=100, capacity_bytes=100)) == 1.9
    assert decay.eviction_floor(Decay(capacity_bytes=10, capacity_floor=0)) == 10
    assert decay.eviction_floor(Decay(capacity_bytes=10, capacity_floor=7)) == 7
    assert decay.eviction_floor(Decay(capacity_bytes=10, capacity_floor=11)) == 10


def store(spark):
    """20 levels; loose memories, an event that empties, one that stays, an empty event, a dangling one."""
    rows = []

    def memory(i, age, rank, event="", recalled=0, body="x" * 50):
        rows.append((f"m{i:02}", NOW - age * DAY, rank + 100 if rank else None, event, False, recalled, 1 if recalled else 0, False, "g", 0, body, None))

    for i in range(6):
        memory(i, 10 * (i + 1), i + 1)
    memory(10, 300, 1, "gone")
    memory(11, 300, 1, "old")
    memory(12, 300, 2, "old")
    memory(13, 300, 1, "mixed")
    memory(14, 2, 9, "mixed")
    memory(15, 300, 1, "", NOW - DAY)
    events = [(e, NOW - 400 * DAY, 0, 101, e, "", False, 0, "g", None) for e in ("old", "mixed", "nothing")]
    s = empty(spark)
    return s.replace(
        memories=spark.createDataFrame(rows, s.memories.schema), events=spark.createDataFrame(events, s.events.schema), levels=spark.range(1, 21).select((F.col("id") + 100).alias("id"), F.col("id").cast("int").alias("level_rank"))
    )


D1 = Decay(method=1, aggressiveness=1.0, unit_days=10.0, threshold=0.6, retention_days=5)


def resolved(s: Snapshot, name):
    from lethe.operators.relations import resolved as r

    return r(s.tables[name], s.levels)


def test_cycle_forgets_what_the_preview_says(spark):
    s = store(spark)
    used = forget.used_bytes(s.memories, s.events, s.memory_links, s.event_links).first()[0]
    for d in (D1, Decay(**{**D1.__dict__, "capacity_bytes": used // 2})):
        told = {(r.id, r.rule) for r in forget.preview(resolved(s, "memories"), resolved(s, "events"), NOW, d).collect()}
        after, report = cycle.run(s, NOW, d)
        left = {r.id for r in after.memories.collect()}
        log = {(r.id, r.rule) for r in after.tombstones.collect()}
        assert {x for x in log if x[1] == RULE_CONSOLIDATION} == told
        assert left == {r.id for r in s.memories.collect()} - {x for x, _ in log}
        assert report.memories_consolidated == len(told)
        assert report.memories_evicted == len([x for x in log if x[1] == RULE_EVICTION])
        if d.capacity_bytes:
            assert forget.used_bytes(after.memories, after.events, after.memory_links, after.event_links).first()[0] <= d.capacity_bytes
            assert report.memories_evicted


def test_cycle_details(spark):
    after, report = cycle.run(store(spark), NOW, D1)
    left = {r.id for r in after.memories.collect()}
    assert {"m14", "m15", "m00"} <= left  # retained, recalled a day ago, young enough
    assert not left & {"m10", "m11", "m12", "m13"}
    events = {r.id: r.memories_consolidated for r in after.events.collect()}
    assert events == {"mixed": True}  # emptied and empty ones go, survivors are flagged
    assert report.events_consolidated == 2
    assert sorted(r.seq for r in after.tombstones.collect()) == list(range(1, report.memories_consolidated + 1))


def test_eviction_takes_the_row_that_crosses_and_spares_retained_ones(spark):
    s = store(spark)
    rows = forget.valued(forget.candidates(resolved(s, "memories"), resolved(s, "events")), NOW, D1)
    order = [r.id for r in rows.where("not retained").orderBy("value", "id").collect()]
    size = 50 + 256
    for excess, n in ((0, 0), (1, 1), (size, 1), (size + 1, 2), (10**9, len(order))):
        assert {r.id for r in forget.evicted(rows, excess).collect()} == set(order[:n])


def test_prefix_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("n"))
    got = {r.k: r.before for r in forget.prefix_sums(rows, ["k"], "n").collect()}
    total = 0
    for r in sorted(rows.collect()):
        assert got[r.k] == total
        total += r.n


def test_log_pages_and_pruning(spark):
    s = store(spark)
    log = cycle.run(s, NOW, D1)[0].tombstones
    n = log.count()
    assert [r.seq for r in forget.forgotten(log, limit=2).collect()] == [n, n - 1]
    assert [r.seq for r in forget.forgotten(log, after_seq=n, limit=1).collect()] == [n - 1]
    assert forget.forgotten(log, event_id="old").count() == 2
    assert [r.seq for r in forget.prune_log(log, NOW, max_rows=2).orderBy("seq").collect()] == [n - 1, n]
    gappy = log.where(F.col("seq") != n - 1)
    assert forget.prune_log(gappy, NOW, max_rows=2).count() == 2
    assert forget.prune_log(log, NOW + 10 * DAY, max_age_days=5).count() == 0
    assert forget.delete_forgotten(log, before=NOW + 1).count() == 0
    with pytest.raises(ValueError):
        forget.delete_forgotten(log)


def test_recalled_rows_survive_a_stale_snapshot(spark):
    from lethe.operators.mutate import recall

    s = store(spark)
    snapshot = s.memories.select("id", "time_recalled", "recall_count")
    now = recall(s.memories, s.memories.where("id = 'm00'"), NOW)
    assert "m00" not in {r.id for r in forget.unrecalled(now, snapshot).collect()}
    assert forget.unrecalled(now, snapshot).count() == s.memories.count() - 1
