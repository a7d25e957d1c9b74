"""Rules, ingestion and Structured Streaming."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lethe.model import InvalidArgument
from lethe.operators import ingest, rules, topics
from lethe.sources import streams
from lethe.sources.snapshots import Store
from lethe.streaming import ingest as live

NOW = 1_700_000_000_000_000_000


def ruleset(spark, *items, default="keep"):
    return rules.parse(spark, json.dumps({"default": default, "rules": list(items)}))


def test_parsing(spark):
    good = ruleset(spark, {"name": "a", "when": "event.significance > 5", "action": "promote", "keep_top": 3, "set_event": {"name": "upper(event.name)"}})
    assert not good.needs_memories(spark)
    assert ruleset(spark, {"name": "a", "when": "size(memories) > 1", "action": "drop"}).needs_memories(spark)
    bad = [
        {"name": "a", "when": "event.significance", "action": "drop"},
        {"name": "a", "when": "nonsense >", "action": "drop"},
        {"name": "a", "when": "true", "action": "fly"},
        {"name": "a", "when": "true", "action": "drop", "keep_top": 1},
        {"name": "a", "when": "true", "action": "promote", "keep_top": 1, "summarise": True},
        {"name": "a", "when": "true", "action": "promote", "set_event": {"id": "'x'"}},
        {"name": "a", "when": "true", "action": "drop", "unknown": 1},
    ]
    for item in bad:
        with pytest.raises(InvalidArgument):
            ruleset(spark, item)
    with pytest.raises(InvalidArgument):
        ruleset(spark, {"name": "a", "when": "true", "action": "drop"}, {"name": "a", "when": "true", "action": "drop"})


def test_a_bad_file_keeps_the_last_ruleset(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"default": "drop", "rules": []}')
    good = rules.load(spark, f"file://{path}")
    path.write_text("{")
    assert rules.load(spark, f"file://{path}", good) is good


def test_first_match_wins_and_errors_are_told(spark):
    events = spark.createDataFrame([("e1", 0, 5, "n", "", "g", 7, {"w": "x"}), ("e2", 0, 5, "n", "", "g", 1, {"w": "3"}), ("e3", 0, 5, "n", "", "g", 1, None)], "id string, time_start long, time_end long, name string, description string, group_name string, significance int, metadata map<string,string>")
    none = spark.createDataFrame([], "id string, event_id string, body string, significance int, is_binary boolean, is_summary boolean, recall_count int, timestamp long, metadata map<string,string>")
    found = rules.judge(rules.event_facts(events, none), ruleset(spark, {"name": "num", "when": "try_cast(event.metadata['w'] AS INT) > 2", "action": "drop"}, {"name": "big", "when": "event.significance > 5", "action": "summarise"}))
    assert {r.id: (r.rule, r.action, r.errors) for r in found.collect()} == {"e1": ("big", "summarise", ["num"]), "e2": ("num", "drop", []), "e3": ("", "keep", ["num"])}


def test_messages(spark):
    rows = [("topic", b"hello", {"id": "a", "significance": "7", "group": "g", "meta-X y": "1"}, 5), ("topic", b"", {"significance": "-2"}, NOW * 2), ("topic", b"\xff\xfe", None, 7)]
    got = ingest.from_messages(spark.createDataFrame(rows, streams.MESSAGES), NOW).collect()
    assert [(r.significance, r.group_name, r.body, r.is_binary, r.timestamp) for r in got] == [(7, "g", "hello", False, 5), (1, "topic", "(empty)", False, NOW), (1, "topic", "//4=", True, 7)]
    assert got[0].id == "a" and len(got[1].id) == 64 and got[0].metadata == {"subject": "topic", "x_y": "1"}


def test_stream_into_a_store_is_idempotent(spark, tmp_path):
    source, store = f"file://{tmp_path}/in", Store(spark, f"file://{tmp_path}/store")
    rows = [("t", f"body {i % 5}".encode(), {"id": f"m{i % 5}"}, i + 1) for i in range(8)]
    for _ in range(2):  # the same messages land twice
        spark.createDataFrame(rows, streams.MESSAGES).coalesce(1).write.mode("append").parquet(source)
    q = live.bridge(streams.file_messages(spark, source, 1), lambda m: ingest.from_messages(m, NOW), store, f"file://{tmp_path}/cp", lambda: NOW, 0)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in store.read().memories.collect()) == [f"m{i}" for i in range(5)]
    assert live.store_batch(store, ingest.from_messages(spark.createDataFrame([("t", b"x", {"id": "m1"}, 1), ("t", b"x", {"id": "z"}, 1)], streams.MESSAGES), NOW), NOW, minimum=0) == {"stored": 1, "exists": 1, "rejected": 0}


def test_recall_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    live.store_batch(store, ingest.from_messages(spark.createDataFrame([("t", b"x", {"id": "a"}, 1), ("t", b"y", {"id": "b"}, 1)], streams.MESSAGES), NOW), NOW)
    ids = f"file://{tmp_path}/ids"
    spark.createDataFrame([("a",), ("a",), ("zz",)], "id string").coalesce(1).write.parquet(ids)
    q = live.recalls(spark.readStream.schema("id string").parquet(ids), store, f"file://{tmp_path}/cp", lambda: NOW, 0)
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.recall_count for r in store.read().memories.collect()} == {"a": 1, "b": 0}


def test_bucketed_stream(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = [("g", "2024-01-01 00:10:00"), ("g", "2024-01-01 00:50:00"), ("g", "2024-01-01 05:00:00"), ("g", "2024-01-02 05:00:00")]
    spark.createDataFrame(rows, "group_name string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    q = live.bucketed(spark.readStream.schema("group_name string, ts timestamp").parquet(path)).writeStream.outputMode("append").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM buckets").collect()) == [1, 2]


def test_feed_frames(spark):
    post = {"did": "d", "time_us": 5, "kind": "commit", "commit": {"operation": "create", "collection": "app.feed.post", "rkey": "1", "record": {"text": "hi", "langs": ["en"], "reply": {"root": {"uri": "at://r"}, "parent": {"uri": "at://p"}}}}}
    like = {"did": "d", "time_us": 6, "kind": "commit", "commit": {"operation": "create", "collection": "app.feed.like", "rkey": "2", "record": {"subject": {"uri": "at://p"}}}}
    posts, broken = streams.feed_frames(spark.createDataFrame([(json.dumps(post),), (json.dumps(like),), ("{oops",)], "value string"))
    assert broken.count() == 1
    assert [r.id for r in ingest.liked(posts).collect()] == ["at://p"]
    assert [r.event_id for r in ingest.threads(ingest.wanted_posts(posts, ("en",))).collect()] == ["at://r"]
    assert ingest.wanted_posts(posts, ("fr",)).count() == 0
    known = spark.createDataFrame([("at://p",)], "id string")
    assert ingest.captured(posts, known, known.limit(0)).count() == 1


def test_topics(spark):
    rows = [("a", ["x", "y", "z"]), ("b", ["x", "y"]), ("c", ["y", "z"]), ("d", ["q"])] + [(f"o{i}", ["common"]) for i in range(9)]
    got = topics.related(spark.createDataFrame(rows, "id string, terms array<string>"), 2, 1, 8).collect()
    assert {(r.id, r.other, r.shared) for r in got} == {("a", "b", 2), ("b", "a", 2), ("c", "a", 2)}
    assert topics.frequency_cap(1000, 5) == 50 and topics.frequency_cap(10, 5) == 8


def test_topic_index_over_a_stream(spark, tmp_path):
    from lethe.streaming.topics import related, shared_terms

    path = f"file://{tmp_path}/posts"
    for batch in ([("a", ["x", "y", "z"])], [("b", ["x", "y"]), ("c", ["z"])]):
        spark.createDataFrame(batch, "id string, terms array<string>").coalesce(1).write.mode("append").parquet(path)
    got = []
    stream = spark.readStream.schema("id string, terms array<string>").option("maxFilesPerTrigger", 1).parquet(path)
    q = shared_terms(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, related(df).collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="1 second").start()
    # Timeouts by processing time keep a query busy, so it is stopped once the second file has been seen.
    until = time.time() + 90
    while not got and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert {(frozenset(x[:2]), x[2]) for x in got} == {(frozenset("ab"), 2)}


def test_dead_letters_and_automatic_summaries(spark, tmp_path):
    from lethe.model import DAY
    from lethe.operators.relations import resolved
    from lethe.plans.summarise import automatic

    store = Store(spark, f"file://{tmp_path}/store")
    messages = [("t", b"x", {"id": "a", "event": "e"}, NOW - 50 * DAY), ("t", b"y", {"id": "b", "event": "e"}, NOW - 50 * DAY), ("t", b"z", {"id": "c" * 200}, 1)]
    batch = ingest.from_messages(spark.createDataFrame(messages, streams.MESSAGES), NOW)
    assert live.store_batch(store, batch, NOW, dead_letters=f"file://{tmp_path}/dead") == {"stored": 2, "exists": 0, "rejected": 1}
    assert [r.reason for r in spark.read.parquet(f"file://{tmp_path}/dead").collect()] == ["id"]
    s = store.read()
    events = spark.createDataFrame([("e", 0, 0, None, "E", "", False, 0, "t", None)], s.events.schema)
    done = list(automatic(resolved(s.memories, s.levels), resolved(events, s.levels), lambda name, group, bodies: "|".join(bodies), NOW, 2, 7 * DAY))
    assert [(e, row.first().body) for e, row in done] == [("e", "x|y")]


def test_counts_are_kept_for_a_while():
    from lethe.model import MemoryFilter
    from lethe.operators.listing import CountCache

    now, calls = [0.0], []
    cache = CountCache(10, lambda: now[0], most=2)
    count = lambda: calls.append(1) or len(calls)
    assert cache.get("m", MemoryFilter(), count) == cache.get("m", MemoryFilter(), count) == 1
    assert cache.get("m", MemoryFilter(group="g"), count) == 2
    now[0] = 11
    assert cache.get("m", MemoryFilter(), count) == 3


def test_long_messages_are_kept_whole_and_cut_between_characters(spark):
    long, bad = "x" * 65535 + "é" + "tail", b"\xff" * 70_000
    rows = spark.createDataFrame([("t", long.encode(), {"id": "a"}, 1), ("t", bad, {"id": "b"}, 1), ("t", b"", {"id": "c"}, 1)], streams.MESSAGES)
    body = lambda **s: {r.id: (r.body, r.is_binary) for r in ingest.from_messages(rows, NOW, ingest.MessageSettings(**s)).collect()}
    encoded = lambda b: __import__("base64").b64encode(b).decode()
    got = body()
    assert got["a"] == (long, False) and got["c"] == ("(empty)", False)
    assert (got["b"][0].replace("\r\n", ""), got["b"][1]) == (encoded(bad), True)
    assert body(max_body=65536)["a"] == ("x" * 65535, False)
    assert body(max_body=65537)["a"] == ("x" * 65535 + "é", False)


def test_summaries_read_all_texts_and_rank_with_binary_memories(spark):
    from lethe.plans.summarise import summarise

    rows = [("t", f"m{i}".encode(), {"id": f"{i:03}", "event": "e", "significance": str(9 if i == 249 else 1)}, i + 1) for i in range(450)]
    rows.append(("t", b"\xff", {"id": "z", "event": "e", "significance": "50"}, 500))
    memories = ingest.from_messages(spark.createDataFrame(rows, streams.MESSAGES), NOW)
    events = spark.createDataFrame([("e", "E", "g")], "id string, name string, group_name string")
    calls = []
    out = summarise(memories, events, "e", lambda name, group, bodies: calls.append(len(bodies)) or "|".join(bodies), NOW).collect()
    assert [(r.body.split("|"), r.significance, r.is_binary) for r in out] == [([f"m{i}" for i in range(450)], 50, False)]
    assert calls == [200, 200, 50, 3]
