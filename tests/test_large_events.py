"""Events of more than 10,000 memories are judged, sent, summarised and drained like others."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lethe.operators import rules
from lethe.plans import engine_queries

DIR = "/root/testdata/sf0.001"
N = 10_001
#: (order, customer, priority, quantity, line number of one memory): urgent, weighty, held by one summary, held by none
LARGE = "(9000001, 1, '1-URGENT', 5, 2), (9000002, 2, '5-LOW', 45, 2), (9000003, 29, '5-LOW', 5, 1), (9000004, 29, '5-LOW', 5, 2)"


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """The smallest tables and four events of N memories each, and the connection that holds them."""
    path = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW v AS SELECT * FROM (VALUES {LARGE}) t(k, customer, priority, quantity, line)")
    con.execute(f"COPY (SELECT * FROM '{DIR}/orders.parquet' UNION ALL SELECT k::BIGINT, customer::BIGINT, 'O', 1.0::DOUBLE, TIMESTAMP '1996-01-01', priority FROM v) TO '{path}/orders.parquet'")
    con.execute(f"""COPY (SELECT * FROM '{DIR}/lineitem.parquet' UNION ALL SELECT k::BIGINT, 1 + 77 * (j // 1000), 1 + j % 1000, (CASE WHEN j = 77 THEN line ELSE 2 + j % 3 END)::INTEGER, (quantity + j % 5)::DOUBLE,
        (1000 + j)::DOUBLE, 0.01::DOUBLE, ((j % 9) / 100.0)::DOUBLE, 'A', 'F', TIMESTAMP '1996-01-02' + INTERVAL 1 SECOND * j FROM v, range({N}) r(j)) TO '{path}/lineitem.parquet'""")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["promoted_and_drained", "promoted_batches", "promoted_summaries"])
def test_query_matches_sql(spark, large, name):
    path, con = large
    want = con.execute(engine_queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = engine_queries.QUERIES[name](spark, path).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


FORMS = {
    "exists(memories, m -> m.significance > event.significance)": 1,
    "exists(memories, m -> m.is_summary)": 1,
    "NOT exists(memories, m -> m.significance > 2) AND event.significance >= 1": -1,
    "forall(memories, m -> m.significance >= 2) OR event.metadata['w'] = 'x'": -1,
    "NOT forall(memories, m -> m.metadata['w'] = 'x')": 1,
    "exists(memories, m -> m.body = 'b3') AND exists(memories, m -> m.is_summary)": 0,
    "exists(memories, m -> size(memories) > 3)": 0,
    "size(memories) > 3": 0,
}


def test_the_deciding_memory_stands_for_all(spark):
    """Conditions of each form, with nulls, give the same verdicts and errors as on whole arrays."""
    events = spark.range(40).select(
        F.concat(F.lit("e"), "id").alias("id"), F.lit(0).cast("long").alias("time_start"), F.lit(5).cast("long").alias("time_end"), F.lit("n").alias("name"), F.lit("").alias("description"), F.lit("g").alias("group_name"),
        (F.col("id") % 4).cast("int").alias("significance"), F.when(F.col("id") % 3 > 0, F.create_map(F.lit("w"), F.lit("x"))).alias("metadata"),
    )
    h = F.abs(F.hash("id"))
    memories = spark.range(100).select(
        F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("e"), h % 30).alias("event_id"), F.concat(F.lit("b"), h % 7).alias("body"), F.when(h % 5 > 0, h % 4).cast("int").alias("significance"), F.lit(False).alias("is_binary"),
        F.when(h % 11 > 0, h % 9 == 0).alias("is_summary"), F.lit(0).alias("recall_count"), F.col("id").alias("timestamp"), F.when(h % 3 > 0, F.create_map(F.lit("w"), F.when(h % 2 > 0, "x").otherwise("y"))).alias("metadata"),
    )
    told = lambda facts, ruleset: sorted(map(str, rules.judge(facts, ruleset).collect()))
    for when, side in FORMS.items():
        ruleset = rules.Ruleset("keep", (rules.Rule("a", when, "drop"), rules.Rule("b", "event.significance > 2", "promote")))
        assert ruleset.deciding(spark) == ({when: side} if side else None)
        facts = rules.facts_for(ruleset, events, memories).cache()
        assert not side or facts.where(F.size("memories") > 1).isEmpty()
        assert told(facts, ruleset) == told(rules.event_facts(events, memories), ruleset)
    simple = rules.Ruleset("keep", tuple(rules.Rule(when, when, "drop") for when, side in FORMS.items() if side))
    assert told(rules.facts_for(simple, events, memories), simple) == told(rules.event_facts(events, memories), simple)
    reads = rules.Ruleset("keep", (rules.Rule("a", "exists(memories, m -> m.is_summary)", "promote", set_event={"significance": "size(memories)"}),))
    assert reads.deciding(spark) is None
