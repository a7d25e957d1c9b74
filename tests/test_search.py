"""Search: what is shuffled for an index and for vectors, and that both stay right."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lethe.model import NotFound
from lethe.operators import relations, search
from lethe.plans import engine_queries
from lethe.plans import queries as Q
from lethe.sources.scratch import Scratch

TEXTS = [(1, "The thing, the clown. THE end", False), (2, "", False), (3, None, False), (4, "thing 7", True), (5, "a-b a_b; a b", False), (6, "solo", False)]


def memories(spark):
    return spark.createDataFrame(TEXTS, "id long, body string, is_binary boolean")


def joins(plan):
    """(left, right) outputs of each join of a plan."""
    if plan.nodeName() == "Join":
        yield plan.left().output().mkString(" "), plan.right().output().mkString(" ")
    for i in range(plan.children().size()):
        yield from joins(plan.children().apply(i))


def test_words_are_counted_without_a_shuffle(spark):
    rows = search.postings(memories(spark))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    counts = {1: "the thing the clown the end", 5: "a b a b a b", 6: "solo"}
    want = {(w, i, tf, len(t.split())) for i, t in counts.items() for w, tf in Counter(t.split()).items()}
    got = [(r.term, r.id, r.tf, r.dl) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want


def test_an_index_of_many_slices_holds_every_document_and_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SLICE_BYTES", 1)
    made = search.KeywordIndex(spark, f"file://{tmp_path}/index", buckets=4).add(memories(spark))
    assert (made.n, made.words) == (5, 13)  # null has no words
    want = sorted(map(tuple, search.postings(memories(spark)).collect()))
    assert sorted(map(tuple, made.postings().collect())) == want
    made.add(spark.createDataFrame([(1, "clown", False), (6, "", False)], "id long, body string, is_binary boolean"))
    assert (made.n, made.words) == (5, 7)
    assert sorted(map(tuple, made.postings().collect())) == sorted([x for x in want if x[1] == 5] + [("clown", 1, 1, 1)])
    assert [r.id for r in made.hits("clown solo").collect()] == [1]


def test_vectors_are_not_joined(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<float>")
    docs = memories(spark).withColumn("significance", F.lit(1)).withColumn("recall_count", F.lit(0))
    found = search.search(docs.unionAll(docs), "semantic", vectors=vectors, query=[1.0, 0.0], limit=20)
    sides = [side for pair in joins(found._jdf.queryExecution().optimizedPlan()) for side in pair]
    assert sides and not any("vector" in side for side in sides)
    assert {r.id for r in found.collect()} == {1, 2, 3, 4, 5, 6}


def test_a_search_by_vectors_builds_no_index(spark):
    key = (spark.sparkContext.applicationId, "/root/testdata/sf0.001")
    held = Q._INDEXES.pop(key, None)
    try:
        assert engine_queries.search_mode_semantic(spark, key[1]).count()
        assert key not in Q._INDEXES
    finally:
        if held is not None:
            Q._INDEXES[key] = held


def shuffled(spark):
    """Bytes that all stages of the session have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_search_without_an_index_writes_its_hits_only(spark, monkeypatch):
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, compression=None: written.append(write(self, df, name, compression)) or written[-1])
    got = [(r.id, round(r.score, 9)) for r in search.keyword_hits(memories(spark), "a clown").collect()]
    assert [x.count() for x in written] == [2]
    # Four of five text memories have words, 13 in all; the one of null counts as a document.
    n, avgdl = 5, 13 / 4
    idf = math.log((n - 1 + 0.5) / (1 + 0.5))
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 6 / avgdl)) for i, tf in ((1, 1), (5, 3))}
    assert got == [(i, round(want[i], 9)) for i in (5, 1)]
    assert search.keyword_hits(memories(spark).where("false"), "a").collect() == []


def test_all_that_match_are_told_without_a_cap(spark):
    found = search.matching(memories(spark), "thing SOLO b")
    assert sorted(r.id for r in found.collect()) == [1, 5, 6]
    plan = engine_queries.search_reinforced(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


def test_few_recalled_memories_are_found_without_a_shuffle_of_all(spark, monkeypatch):
    e = engine_queries.engine(spark, "/root/testdata/sf0.001", reinforce_fraction=0.5)
    ids = [r.id for r in e.store.read().memories.select("id").orderBy("id").limit(10).collect()]
    spent = []
    for few in (relations.MAX_BROADCAST_IDS, 0):
        monkeypatch.setattr(relations, "MAX_BROADCAST_IDS", few)
        before = shuffled(spark)
        e.recall_memories(ids)
        with pytest.raises(NotFound):
            e.recall_memories(e.store.read().memories.limit(1).select(F.lit("nobody").alias("id")))
        spent.append(shuffled(spark) - before)
    assert spent[0] < 20_000 < 10 * spent[0] < spent[1]
    got = e.store.read().memories
    assert sorted(r.id for r in got.where("recall_count >= 2").join(got.sparkSession.createDataFrame([(i,) for i in ids], "id string"), "id").collect()) == ids
    assert (e.recall_hits, e.recall_misses) == (20, 2)
