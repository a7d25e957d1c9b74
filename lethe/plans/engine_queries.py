"""Named queries over stores made of the driver's tables: calls, cycles, archives, streams, validation, search modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.engine import Engine
from lethe.functions import decay
from lethe.functions import text as T
from lethe.model import DAY, SCHEMAS, Decay, InvalidArgument, MemoryFilter, Ranking, StoreError
from lethe.operators import filters, forget, ingest, levels, links, listing, mutate, relations, rules, search
from lethe.plans import changes, cycle, promote, summarise
from lethe.plans import queries as Q
from lethe.sources import archive, streams
from lethe.sources import driver_tables as D
from lethe.sources.driver_tables import EV, LINKS_SQL, MEM, NOW
from lethe.sources.scratch import Scratch
from lethe.sources.snapshots import Snapshot, Store, Tables
from lethe.streaming import ingest as bridge

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


# --- stores

_STORES: dict = {}
BASE = Decay(**{**Q.BASE.__dict__, "capacity_bytes": 6_000_000, "capacity_floor": 5_000_000})


def store(spark, sf_dir) -> Store:
    """A store of its own that begins with the driver's memories, events and levels; they are written once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        made = Store(spark, Scratch(spark, "store").path("base"))
        tables = {"memories": D.stored_memories(spark, sf_dir), "events": D.stored_events(spark, sf_dir), "levels": D.levels(spark)}
        made.commit(made.read().replace(**tables))
        _STORES[key] = made
    return _STORES[key].fork(Scratch(spark, "store").path("fork"))


def engine(spark, sf_dir, **settings) -> Engine:
    return Engine(store(spark, sf_dir), lambda: NOW, Q.BASE, **settings)


def turns(spark, sf_dir) -> Snapshot:
    """A snapshot of conversation turns and the links between them, with their sums."""
    t = D.turns(spark, sf_dir)
    rows = t.select(
        "id", F.lit(NOW - DAY).cast("long").alias("timestamp"), F.lit(None).cast("long").alias("significance_level_id"), "event_id", F.lit(False).alias("is_binary"), F.lit(0).cast("long").alias("time_recalled"),
        F.lit(0).alias("recall_count"), F.lit(False).alias("is_summary"), "group_name", "link_significance", F.col("text").alias("body"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    none = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    edges = D.memory_links(spark, sf_dir)
    return Snapshot(Tables({}, {**none, "memories": links.with_totals(rows, edges), "memory_links": edges, "levels": D.levels(spark)}))


def resolved(s: Snapshot, name: str):
    return relations.resolved(s.tables[name], s.levels)


@query("stored_rows", f"WITH {MEM} SELECT id, significance, body, m_flag, group_name FROM mem")
def stored_rows(spark, sf_dir):
    return resolved(store(spark, sf_dir).read(), "memories").select("id", "significance", "body", F.col("metadata")["flag"].alias("m_flag"), "group_name")


@query("stored_batch", f"WITH {MEM} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN strlen(body) > 1048576 THEN 'rejected' WHEN significance BETWEEN 1 AND 4 THEN 'rejected' WHEN k = 0 THEN 'exists' ELSE 'stored' END AS outcome FROM mem, (VALUES (0), (1)) t(k) WHERE recall_count = 2 ) GROUP BY outcome")
def stored_batch(spark, sf_dir):
    e = engine(spark, sf_dir, minimum_significance=5)
    old = Q.mem(spark, sf_dir).where("recall_count = 2")
    told = e.store_memories(old.unionByName(old.withColumn("id", F.concat(F.lit("new-"), "id"))))
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stored_one_by_one", f"WITH {MEM} SELECT count(*) + 1 AS memories, count(*) FILTER (event_id = '17') + 1 AS held, 30 AS significance FROM mem")
def stored_one_by_one(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.store_memory("an added body", "added", 30, "17")
    rows = resolved(e.store.read(), "memories")
    return rows.agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.col("event_id") == "17").alias("held"), F.max(F.when(F.col("id") == "added", F.col("significance"))).alias("significance"))


@query("changed_rows", f"WITH {MEM} SELECT id, CASE WHEN event_id = '5' THEN 'changed' ELSE body END AS body, CASE WHEN event_id = '5' THEN 77 ELSE significance END AS significance FROM mem")
def changed_rows(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.update_memory(e.store.read().memories.where("event_id = '5'").select("id", F.lit("changed").alias("body"), F.lit(77).alias("significance")))
    return resolved(e.store.read(), "memories").select("id", "body", "significance")


@query("recalled_by_call", f"WITH {MEM} SELECT id, CASE WHEN event_id = '17' THEN {NOW} ELSE time_recalled END AS time_recalled, recall_count + (event_id = '17')::INT AS recall_count FROM mem")
def recalled_by_call(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.recall_memories(e.store.read().memories.where("event_id = '17'").select("id"))
    return e.store.read().memories.select("id", "time_recalled", "recall_count")


@query("event_lifecycle", f"WITH {EV} SELECT id, CASE WHEN id = '7' THEN {NOW} ELSE time_end END AS time_end, CASE WHEN id = '9' THEN 41 ELSE significance END AS significance, name FROM ev WHERE id <> '11' UNION ALL SELECT 'new', 0, 3, 'a new one'")
def event_lifecycle(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.store_event("a new one", "new", 3)
    e.ensure_event("new", name="again")
    e.end_event("7")
    e.update_event_significance("9", 41)
    e.delete_event("11")
    return resolved(e.store.read(), "events").select("id", "time_end", "significance", "name")


@query("event_deleted", f"WITH {MEM} SELECT id, event_id FROM mem WHERE event_id <> '17'")
def event_deleted(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.delete_event("17", with_memories=True)
    return e.store.read().memories.select("id", "event_id")


@query("event_merged_and_detached", f"WITH {MEM} SELECT id, CASE event_id WHEN '17' THEN '5' WHEN '23' THEN '' ELSE event_id END AS event_id FROM mem")
def event_merged_and_detached(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.merge_events("5", "17")
    e.delete_event("23")
    return e.store.read().memories.select("id", "event_id")


@query("nested_memory", f"WITH {MEM} SELECT count(*) + 1 AS memories, 1::BIGINT AS linked FROM mem")
def nested_memory(spark, sf_dir):
    e = engine(spark, sf_dir)
    event_id, memory_id = e.store_event_with_memory("with its first memory", "the body", significance=4)
    return e.store.read().memories.agg(F.count(F.lit(1)).alias("memories"), F.count_if((F.col("id") == memory_id) & (F.col("event_id") == event_id)).alias("linked"))


@query("purged", "SELECT 0::BIGINT AS memories, 0::BIGINT AS events, 2 AS version")
def purged(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.purge()
    s = e.store.read()
    return s.memories.agg(F.count(F.lit(1)).alias("memories")).join(s.events.agg(F.count(F.lit(1)).alias("events"))).withColumn("version", F.lit(s.version))


@query("old_version_read", f"WITH {MEM} SELECT count(*) AS before, count(*) FILTER (event_id <> '17') AS after, true AS refused FROM mem")
def old_version_read(spark, sf_dir):
    """A version stays as it was, a stale commit and one of a read-only store are refused."""
    e = engine(spark, sf_dir)
    stale = e.store.read()
    e.delete_event("17", with_memories=True)
    refused = 0
    for target in (e.store, Store(spark, e.store.path, read_only=True)):
        try:
            target.commit(stale)
        except StoreError:
            refused += 1
    count = lambda s, name: s.memories.agg(F.count(F.lit(1)).alias(name))
    return count(e.store.read(1), "before").join(count(e.store.read(), "after")).withColumn("refused", F.lit(refused == 2))


# --- the cycle

_P1 = f"WITH {Q.CAND}, p1 AS (SELECT id, event_id, body_bytes FROM eff WHERE {Q._DUE(1)}), left_ AS (SELECT * FROM mem WHERE id NOT IN (SELECT id FROM p1))"
_GONE_EVENTS = f"""em AS (SELECT e.id FROM ev e WHERE EXISTS (SELECT 1 FROM mem m WHERE m.event_id = e.id) AND NOT EXISTS (SELECT 1 FROM left_ l WHERE l.event_id = e.id)),
xe AS (SELECT *, significance::DOUBLE + {Q._LINK("link_significance")} AS s, ({NOW} - greatest(time_start, time_end))::DOUBLE / 86400000000000.0 / 30.0 AS age, ({NOW} - greatest(time_start, time_end)) // 86400000000000 AS days
  FROM ev WHERE id NOT IN (SELECT event_id FROM mem WHERE event_id <> '')), old AS (SELECT id FROM xe WHERE {Q._DUE(1)})"""


@query("cycle_snapshot", f"{_P1} SELECT id, event_id FROM left_")
def cycle_snapshot(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sleep()
    return e.store.read().memories.select("id", "event_id")


@query("cycle_events", f"{_P1}, {_GONE_EVENTS} SELECT id, EXISTS (SELECT 1 FROM mem m WHERE m.event_id = ev.id) AS memories_consolidated FROM ev WHERE id NOT IN (SELECT id FROM em) AND id NOT IN (SELECT id FROM old)")
def cycle_events(spark, sf_dir):
    after, _ = cycle.run(store(spark, sf_dir).read(), NOW, Q.BASE)
    return after.events.select("id", "memories_consolidated")


@query("cycle_report", f"{_P1}, {_GONE_EVENTS} SELECT (SELECT count(*) FROM p1) AS memories_consolidated, (SELECT count(*) FROM em) + (SELECT count(*) FROM old) AS events_consolidated, 0::BIGINT AS memories_evicted")
def cycle_report(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sleep()
    return e.get_consolidation_status().select("memories_consolidated", "events_consolidated", "memories_evicted")


@query("cycle_log", f"{_P1} SELECT id, 1 AS rule, {NOW} AS forgotten_at FROM p1")
def cycle_log(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sleep()
    return e.store.read().tombstones.select("id", "rule", "forgotten_at")


@query("cycle_deletions_told", f"{_P1} SELECT id FROM p1")
def cycle_deletions_told(spark, sf_dir):
    told = []
    engine(spark, sf_dir, on_deleted=told.append).sleep()
    return told[0]


@query("preview_sample", f"WITH {Q.CAND}, v AS (SELECT *, {Q.CURVES[1]} AS value FROM eff) SELECT id, round(value, 6) AS value, 1 AS rule FROM v WHERE {Q._DUE(1)} ORDER BY v.value, id LIMIT 20")
def preview_sample(spark, sf_dir):
    rows, more = engine(spark, sf_dir).preview_consolidation(20)
    assert more
    return spark.createDataFrame([(r.id, round(r.value, 6), r.rule) for r in rows], "id string, value double, rule int")


@query("explain_in_order", f"WITH {MEM}, a AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS place FROM mem WHERE event_id = '17') SELECT id, place FROM a")
def explain_in_order(spark, sf_dir):
    e = engine(spark, sf_dir)
    asked = sorted((r.id for r in e.store.read().memories.where("event_id = '17'").select("id").collect()), reverse=True)
    got = [r.id for r in e.explain_consolidation(asked).collect()]
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(got)], "id string, place long")


@query("unknown_method_keeps", f"WITH {MEM} SELECT count(*) AS n, 0::BIGINT AS doomed FROM mem")
def unknown_method_keeps(spark, sf_dir):
    d = Decay(**{**Q.BASE.__dict__, "method": 99})
    rows = forget.candidates(Q.mem(spark, sf_dir), Q.ev(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(forget.is_doomed(NOW, d)).alias("doomed"))


def _log(spark, sf_dir):
    rows = forget.valued(forget.candidates(Q.mem(spark, sf_dir), Q.ev(spark, sf_dir)), NOW, Q.BASE)
    gone = forget.doomed(rows, NOW, Q.BASE)
    log = forget.tombstones(gone, 1, Q.BASE.threshold, NOW)
    return Scratch(spark, "log").write(log.withColumn("forgotten_at", NOW - F.col("seq") % 10 * F.lit(DAY)), "log")


_LOG = f"WITH {Q.CAND}, g AS (SELECT *, row_number() OVER (ORDER BY id) AS seq FROM eff WHERE {Q._DUE(1)}), lg AS (SELECT seq, id, group_name, {NOW} - seq % 10 * {DAY} AS forgotten_at FROM g)"


@query("log_pruned", f"{_LOG}, y AS (SELECT * FROM lg WHERE forgotten_at >= {NOW - 4 * DAY}), r AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS rn FROM y) SELECT seq, id FROM r WHERE rn <= 300")
def log_pruned(spark, sf_dir):
    return forget.prune_log(_log(spark, sf_dir), NOW, 4, 300).select("seq", "id")


@query("log_deleted", f"{_LOG} SELECT seq, id FROM lg WHERE NOT (forgotten_at < {NOW - 4 * DAY} AND group_name IN ('A', 'N'))")
def log_deleted(spark, sf_dir):
    return forget.delete_forgotten(_log(spark, sf_dir), NOW - 4 * DAY, groups=("A", "N")).select("seq", "id")


@query("log_counts", f"{_LOG} SELECT count(*) AS n, count(*) FILTER (group_name = 'R') AS seen, count(*) * 192 AS log_bytes FROM lg")
def log_counts(spark, sf_dir):
    log = _log(spark, sf_dir)
    seen = forget.count_forgotten(log, ("R",)).withColumnRenamed("n", "seen")
    return forget.count_forgotten(log).join(seen).join(forget.log_bytes(log))


@query("log_pages", f"{_LOG}, a AS (SELECT seq, row_number() OVER (ORDER BY seq DESC) AS rn FROM lg WHERE group_name = 'A') SELECT (rn - 1) // 100 AS page, count(*) AS n, max(seq) AS first FROM a WHERE rn <= 300 GROUP BY page")
def log_pages(spark, sf_dir):
    """Three pages of the log, each continued by the cursor of the one before."""
    log, cursor, out = _log(spark, sf_dir), 0, []
    for page in range(3):
        rows = forget.forgotten(log, group="A", after_seq=cursor).collect()
        if rows:
            out.append((page, len(rows), rows[0].seq))
        cursor = forget.next_cursor(rows, 100)
        if not cursor:
            break
    return spark.createDataFrame(out, "page long, n long, first long")


# --- summaries


def _summarise(name: str, group: str, bodies: list[str]) -> str:
    return f"{name}/{group}: {len(bodies)} texts, {sum(map(len, bodies))} characters"


@query("event_summary", f"WITH {MEM}, {EV} SELECT id, significance, body, is_summary FROM mem WHERE event_id <> '17' UNION ALL SELECT 'summary-17-{NOW}', (SELECT max(significance) FROM mem WHERE event_id = '17'), (SELECT e.name || '/' || e.group_name || ': ' || count(*) || ' texts, ' || sum(length(m.body)) || ' characters' FROM mem m JOIN ev e ON m.event_id = e.id WHERE e.id = '17' AND NOT m.is_binary GROUP BY e.name, e.group_name), true")
def event_summary(spark, sf_dir):
    e = engine(spark, sf_dir, summariser=_summarise)
    e.summarise_memories("17")
    return resolved(e.store.read(), "memories").select("id", "significance", "body", "is_summary")


_QUIET = f"q AS (SELECT e.id, e.name, count(*) AS n FROM memb m JOIN ev e ON m.event_id = e.id WHERE NOT m.is_summary GROUP BY e.id, e.name HAVING count(*) >= 4 AND max(m.since) < {NOW - 200 * DAY}), top AS (SELECT id FROM q WHERE EXISTS (SELECT 1 FROM mem m WHERE m.event_id = q.id AND NOT m.is_binary) ORDER BY n DESC, id LIMIT 3)"


@query("automatic_summaries", f"WITH {MEM}, {EV}, {_QUIET} SELECT top.id AS event_id, max(significance) AS significance, count(*) AS replaced FROM top JOIN mem ON mem.event_id = top.id GROUP BY top.id")
def automatic_summaries(spark, sf_dir):
    rows, done = Q.mem(spark, sf_dir), []
    for event_id, row in summarise.automatic(rows, Q.ev(spark, sf_dir), _summarise, NOW, 4, 200 * DAY, 3):
        done.append(row.select(F.lit(event_id).alias("event_id"), "significance"))
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    counts = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("replaced"))
    return found.join(counts, "event_id")


@query("summary_prompts", f"WITH {MEM}, {EV}, b AS (SELECT event_id, body, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, id) AS i FROM mem WHERE event_id <> '' AND NOT is_binary), p AS (SELECT event_id, string_agg(i || '. ' || body, chr(10) ORDER BY i) AS listed FROM b WHERE i <= 3 GROUP BY event_id) SELECT p.event_id, left('Event: ' || ev.name || chr(10) || 'Group: ' || ev.group_name || chr(10) || listed, 60) AS prompt FROM p JOIN ev ON ev.id = p.event_id")
def summary_prompts(spark, sf_dir):
    rows = Q.mem(spark, sf_dir).where((F.col("event_id") != "") & ~F.col("is_binary"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", "body"))), lambda x: x["body"])
    held = rows.groupBy("event_id").agg(bodies.alias("bodies"))
    named = Q.ev(spark, sf_dir).select(F.col("id").alias("event_id"), "name", F.col("group_name").alias("g"))
    return held.join(named, "event_id").select("event_id", summarise.prompt(F.col("name"), F.col("g"), F.col("bodies"), 3, 60).alias("prompt"))


# --- archives


def _archived(spark, sf_dir, **options):
    path = Scratch(spark, "archive").path("archive")
    return path, archive.export(spark, store(spark, sf_dir).read(), path, **options)


@query("archive_round_trip", f"WITH {MEM} SELECT id, timestamp, significance, event_id, is_binary, time_recalled, recall_count, is_summary, group_name, body, m_flag FROM mem")
def archive_round_trip(spark, sf_dir):
    path, _ = _archived(spark, sf_dir)
    s = archive.ingest(Store(spark, Scratch(spark, "target").path("t")).read(), archive.read(spark, path))
    return resolved(s, "memories").select("id", "timestamp", "significance", "event_id", "is_binary", "time_recalled", "recall_count", "is_summary", "group_name", "body", F.col("metadata")["flag"].alias("m_flag"))


@query("archive_events", f"WITH {EV} SELECT id, time_start, time_end, significance, name, group_name FROM ev WHERE group_name = 'F'")
def archive_events(spark, sf_dir):
    path, _ = _archived(spark, sf_dir, groups=("F",))
    return archive.read(spark, path)["events"].select("id", "time_start", "time_end", "significance", "name", "group_name")


@query("archive_manifest", f"WITH {MEM} SELECT id, time_recalled, recall_count, true AS refused FROM mem")
def archive_manifest(spark, sf_dir):
    _, manifest = _archived(spark, sf_dir)
    try:
        _archived(spark, sf_dir, max_rows=10)
        refused = False
    except StoreError:
        refused = True
    return manifest.withColumn("refused", F.lit(refused))


@query("cleared_export", f"WITH {MEM} SELECT id FROM mem WHERE event_id = '17'")
def cleared_export(spark, sf_dir):
    """What was recalled after the export stays."""
    e = engine(spark, sf_dir)
    manifest = e.export(Scratch(spark, "archive").path("archive"))
    e.recall_memories(e.store.read().memories.where("event_id = '17'").select("id"))
    e.clear_exported(manifest)
    return e.store.read().memories.select("id")


@query("transferred", f"WITH {MEM}, {EV} SELECT (SELECT count(*) FROM mem) AS memories, (SELECT count(*) FROM ev) AS events")
def transferred(spark, sf_dir):
    target = Store(spark, Scratch(spark, "target").path("t"))
    engine(spark, sf_dir).transfer(target, Scratch(spark, "archive").path("archive"))
    s = target.read()
    return s.memories.agg(F.count(F.lit(1)).alias("memories")).join(s.events.agg(F.count(F.lit(1)).alias("events")))


@query("imported_batch", f"WITH {MEM} SELECT id, CASE WHEN event_id = '17' THEN 'imported' ELSE body END AS body, link_significance FROM mem UNION ALL SELECT 'x-' || id, 'imported', 0 FROM mem WHERE event_id = '17'")
def imported_batch(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = Q.mem(spark, sf_dir).where("event_id = '17'").withColumn("body", F.lit("imported"))
    e.import_batch(memories=rows.unionByName(rows.withColumn("id", F.concat(F.lit("x-"), "id"))))
    return e.store.read().memories.select("id", "body", "link_significance")


@query("byte_batches", f"WITH {MEM}, b AS (SELECT id, coalesce(sum(strlen(body) + strlen(id) + strlen(event_id) + strlen(group_name) + coalesce(strlen(m_json), 0) + 128) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mem) SELECT (before // 1000000)::BIGINT AS batch, count(*) AS n FROM b GROUP BY 1")
def byte_batches(spark, sf_dir):
    return archive.byte_batches(D.stored_memories(spark, sf_dir), 1_000_000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


# --- streams


@query("batch_stored", f"WITH {MEM} SELECT (SELECT count(*) FROM mem) + (SELECT count(*) FROM mem WHERE event_id = '17') AS memories, (SELECT count(*) FROM mem WHERE event_id = '17') AS stored, (SELECT count(*) FROM mem WHERE event_id = '17') AS again")
def batch_stored(spark, sf_dir):
    """A micro-batch stored twice: the second time its ids are there."""
    target = store(spark, sf_dir)
    batch = Q.mem(spark, sf_dir).where("event_id = '17'").withColumn("id", F.concat(F.lit("s-"), "id"))
    first, second = (bridge.store_batch(target, batch, NOW) for _ in range(2))
    return target.read().memories.agg(F.count(F.lit(1)).alias("memories")).select("memories", F.lit(first["stored"]).cast("long").alias("stored"), F.lit(second["exists"]).cast("long").alias("again"))


@query("batch_recalled", f"WITH {MEM} SELECT count(*) FILTER (event_id = '17') AS hits, 1::BIGINT AS misses, sum(recall_count) + count(*) FILTER (event_id = '17') AS recalls FROM mem")
def batch_recalled(spark, sf_dir):
    target = store(spark, sf_dir)
    ids = target.read().memories.where("event_id = '17'").select("id").union(spark.createDataFrame([("nobody",)], "id string"))
    hits, misses = bridge.recall_batch(target, ids.union(ids), NOW)
    return target.read().memories.agg(F.lit(hits).cast("long").alias("hits"), F.lit(misses).cast("long").alias("misses"), F.sum("recall_count").alias("recalls"))


@query("batch_deleted", f"WITH {MEM} SELECT count(*) FILTER (event_id <> '17') AS memories, count(*) FILTER (event_id = '17') AS deleted, sum(recall_count) FILTER (event_id <> '17') + count(*) FILTER (event_id = '5') AS recalls FROM mem")
def batch_deleted(spark, sf_dir):
    target = store(spark, sf_dir)
    of = lambda event: target.read().memories.where(F.col("event_id") == event).select("id")
    n = bridge.delete_batch(target, of("5"), of("17"), NOW)
    return target.read().memories.agg(F.count(F.lit(1)).alias("memories"), F.lit(n).cast("long").alias("deleted"), F.sum("recall_count").alias("recalls"))


def _frames(spark, sf_dir):
    """Frames of a feed from the event stream: posts, replies, likes, deletions, and lines that are no frames."""
    e = D.raw(spark, sf_dir, "events")
    n = F.col("event_id")
    kind = F.when(n % 5 == 4, "app.bsky.feed.like").otherwise("app.bsky.feed.post")
    uri = lambda x: F.concat(F.lit("at://root/app.bsky.feed.post/"), x.cast("string"))
    record = F.struct(
        F.when(n % 5 != 4, F.col("event_type")).alias("text"), F.when(n % 3 == 0, F.array(F.lit("en"))).when(n % 3 == 1, F.array(F.lit("de"))).alias("langs"),
        F.when(n % 5 == 1, F.struct(F.struct(uri(n % 7).alias("uri")).alias("root"), F.struct(uri(n % 11).alias("uri")).alias("parent"))).alias("reply"),
        F.when(n % 5 == 4, F.struct(uri(n % 13).alias("uri"))).alias("subject"),
    )
    commit = F.struct(F.when(n % 17 == 0, "delete").otherwise("create").alias("operation"), kind.alias("collection"), n.cast("string").alias("rkey"), record.alias("record"))
    frame = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("did"), D.nanos(F.col("ts")).alias("time_us"), F.lit("commit").alias("kind"), commit.alias("commit")))
    return e.select(F.when(n % 19 == 0, F.lit("no frame {")).otherwise(frame).alias("value"))


_POSTS = """p AS (SELECT event_id AS n, 'at://u' || user_id || '/app.bsky.feed.' || CASE WHEN event_id % 5 = 4 THEN 'like' ELSE 'post' END || '/' || event_id AS uri, 'u' || user_id AS author,
  CASE WHEN event_id % 5 = 4 THEN 'like' ELSE 'post' END AS collection, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'create' END AS operation, CASE WHEN event_id % 5 <> 4 THEN event_type END AS text,
  CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang, CASE WHEN event_id % 5 = 1 THEN 'at://root/app.bsky.feed.post/' || event_id % 7 END AS reply_root,
  CASE WHEN event_id % 5 = 1 THEN 'at://root/app.bsky.feed.post/' || event_id % 11 END AS reply_parent, CASE WHEN event_id % 5 = 4 THEN 'at://root/app.bsky.feed.post/' || event_id % 13 END AS subject FROM events WHERE event_id % 19 <> 0)"""


@query("feed_frames", f"WITH {_POSTS} SELECT uri, author, collection, operation, text, reply_root, reply_parent, subject AS subject_uri FROM p")
def feed_frames(spark, sf_dir):
    return streams.feed_frames(_frames(spark, sf_dir))[0].select("uri", "author", "collection", "operation", "text", "reply_root", "reply_parent", "subject_uri")


@query("feed_undecodable", "SELECT 'no frame {' AS value, count(*) AS n FROM events WHERE event_id % 19 = 0")
def feed_undecodable(spark, sf_dir):
    return streams.feed_frames(_frames(spark, sf_dir))[1].groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("feed_wanted", f"WITH {_POSTS} SELECT uri FROM p WHERE collection = 'post' AND operation = 'create' AND length(text) >= 5 AND (lang IS NULL OR lang = 'en')")
def feed_wanted(spark, sf_dir):
    return ingest.wanted_posts(streams.feed_frames(_frames(spark, sf_dir))[0], ("en",), 5).select("uri")


@query("feed_captured", f"WITH {_POSTS} SELECT uri FROM p WHERE reply_parent IN ('at://root/app.bsky.feed.post/3', 'at://root/app.bsky.feed.post/4') OR author IN ('u1', 'u2')")
def feed_captured(spark, sf_dir):
    known = spark.createDataFrame([(f"at://root/app.bsky.feed.post/{i}",) for i in (3, 4)], "id string")
    return ingest.captured(streams.feed_frames(_frames(spark, sf_dir))[0], known, spark.createDataFrame([("u1",), ("u2",)], "id string")).select("uri")


@query("feed_threads", f"WITH {_POSTS} SELECT coalesce(reply_root, uri) AS event_id, count(*) AS n FROM p GROUP BY 1")
def feed_threads(spark, sf_dir):
    return ingest.threads(streams.feed_frames(_frames(spark, sf_dir))[0]).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("feed_liked", f"WITH {_POSTS} SELECT DISTINCT subject AS id FROM p WHERE collection = 'like' AND operation = 'create'")
def feed_liked(spark, sf_dir):
    return ingest.liked(streams.feed_frames(_frames(spark, sf_dir))[0])


@query("kafka_messages", "SELECT event_type AS subject, props AS body, user_id::VARCHAR AS user_id, epoch_us(ts) * 1000 AS timestamp FROM events")
def kafka_messages(spark, sf_dir):
    e = D.raw(spark, sf_dir, "events")
    header = F.array(F.struct(F.lit("user").alias("key"), F.col("user_id").cast("string").cast("binary").alias("value")))
    records = e.select(F.col("event_type").alias("topic"), F.col("props").cast("binary").alias("value"), header.alias("headers"), F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))).alias("timestamp"))
    return streams.kafka_rows(records).select("subject", F.col("data").cast("string").alias("body"), F.col("headers")["user"].alias("user_id"), "timestamp")


# --- links


@query("links_after_delete", f"WITH {LINKS_SQL}, {Q._SEEDS}, k AS (SELECT * FROM ends WHERE id NOT IN (SELECT id FROM seeds) AND other NOT IN (SELECT id FROM seeds)) SELECT t.id, coalesce(sum(k.significance), 0)::BIGINT AS link_significance FROM (SELECT conv_id || ':' || turn AS id FROM conversations) t LEFT JOIN k ON k.id = t.id WHERE t.id NOT IN (SELECT id FROM seeds) GROUP BY t.id")
def links_after_delete(spark, sf_dir):
    scratch = Scratch(spark, "removed")
    return changes.removed(turns(spark, sf_dir), "memories", Q._seeds(spark, sf_dir), scratch.write).memories.select("id", "link_significance")


@query("links_added", f"WITH {LINKS_SQL}, a AS (SELECT id, significance FROM ends UNION ALL SELECT '0:0', 50 UNION ALL SELECT '1:0', 50) SELECT id, sum(significance)::BIGINT AS link_significance FROM a GROUP BY id")
def links_added(spark, sf_dir):
    new = spark.createDataFrame([("0:0", "1:0", 50, NOW)], SCHEMAS["memory_links"])
    s = changes.linked(turns(spark, sf_dir), "memories", new)
    return s.memories.join(links.ends(s.memory_links).select("id").distinct(), "id", "left_semi").select("id", "link_significance")


@query("links_deleted", f"WITH {LINKS_SQL} SELECT from_id, to_id FROM lk WHERE NOT (from_id = '0:1' AND to_id = '0:2') AND NOT (from_id = '0:0' AND to_id = '0:1')")
def links_deleted(spark, sf_dir):
    return links.delete_links(D.memory_links(spark, sf_dir), "0:1", spark.createDataFrame([("0:2",), ("0:0",), ("9:9",)], "id string")).select("from_id", "to_id")


@query("linked_appended", f"WITH {LINKS_SQL}, {Q._SEEDS}, n AS (SELECT DISTINCT other AS id FROM ends WHERE id IN (SELECT id FROM seeds) AND other NOT IN (SELECT id FROM seeds)) SELECT id, false AS linked FROM seeds UNION ALL SELECT c.conv_id || ':' || c.turn, true FROM conversations c JOIN n ON n.id = c.conv_id || ':' || c.turn WHERE c.role = 'assistant'")
def linked_appended(spark, sf_dir):
    t = D.turns(spark, sf_dir)
    found = t.join(Q._seeds(spark, sf_dir), "id", "left_semi")
    return links.with_linked(found, t, D.memory_links(spark, sf_dir), ("assistant",)).select("id", "linked")


@query("links_refused", f"WITH {LINKS_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN significance % 5 = 0 THEN 'self' WHEN significance % 5 = 1 THEN 'significance' END AS reason FROM lk) GROUP BY reason HAVING reason IS NOT NULL")
def links_refused(spark, sf_dir):
    lk = D.memory_links(spark, sf_dir)
    kind = F.col("significance") % 5
    bad = lk.select("from_id", F.when(kind == 0, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"), F.when(kind == 1, F.lit(2_000_000)).otherwise(F.col("significance")).alias("significance"), "created")
    return links.invalid_links(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("links_over_capacity", "SELECT 'hub' AS id, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) HAVING count(*) > 128")
def links_over_capacity(spark, sf_dir):
    star = D.turns(spark, sf_dir).select(F.lit("hub").alias("from_id"), F.col("id").alias("to_id"), F.lit(1).alias("significance"), F.lit(NOW).alias("created"))
    return links.over_capacity(star, star.limit(0))


# --- levels


@query("level_anchor", f"WITH {MEM} SELECT max(significance) + 1 AS above, max(significance) AS below FROM mem WHERE event_id = '17' AND significance > 0")
def level_anchor(spark, sf_dir):
    """Where a record lands above and below the highest memory of an event."""
    rows = D.stored_memories(spark, sf_dir)
    top = Q.mem(spark, sf_dir).where("event_id = '17'").orderBy(F.desc("significance"), "id").first().id
    rank = levels.anchor_rank(rows, D.levels(spark), top)
    return spark.createDataFrame([(levels.place(D.levels(spark), above=rank)[2], levels.place(D.levels(spark), below=rank)[2])], "above int, below int")


@query("level_found_or_created", "SELECT i + 1000 AS id, i::INT AS level_rank FROM range(1, 51) t(i) UNION ALL SELECT 1051, 90")
def level_found_or_created(spark, sf_dir):
    registry, found = levels.find_or_create(D.levels(spark), 7)
    assert found == 1007
    return levels.find_or_create(registry, 90)[0]


@query("levels_migrated", f"WITH {MEM}, r AS (SELECT significance, row_number() OVER (ORDER BY significance) AS level FROM (SELECT DISTINCT significance FROM mem WHERE significance > 0)) SELECT mem.id, r.level AS significance_level_id FROM mem LEFT JOIN r USING (significance)")
def levels_migrated(spark, sf_dir):
    return levels.from_significance(Q.mem(spark, sf_dir).drop("significance_level_id"))[1].select("id", "significance_level_id")


@query("levels_too_high", "SELECT i AS id, i::INT AS level_rank FROM range(1, 4) t(i)")
def levels_too_high(spark, sf_dir):
    high = spark.createDataFrame([(1, 5), (2, 1 << 29), (3, 1 << 30)], SCHEMAS["levels"])
    return levels.compact_if_high(high)


# --- validation, scope, lookups


@query("invalid_events", f"WITH {EV} SELECT CASE WHEN strlen(name) > 4 THEN 'name' WHEN time_end > 0 AND time_end < time_start + 20 * {DAY} THEN 'time' ELSE 'good' END AS reason, count(*) AS n FROM ev GROUP BY 1")
def invalid_events(spark, sf_dir):
    rows = Q.ev(spark, sf_dir).withColumn("time_start", F.col("time_start") + 20 * DAY).withColumn("name", F.when(F.octet_length("name") > 4, F.repeat("name", 60)).otherwise(F.col("name")))
    return rows.groupBy(F.coalesce(mutate.invalid_event_reason(), F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("invalid_metadata", "SELECT event_id % 4 = 0 AS good, count(*) AS n FROM events GROUP BY 1")
def invalid_metadata(spark, sf_dir):
    n = F.col("event_id") % 4
    key = F.when(n == 1, F.lit("-bad")).when(n == 2, F.repeat(F.lit("k"), 65)).otherwise(F.lit("a.b/c:d_e-f"))
    rows = D.raw(spark, sf_dir, "events").select(F.create_map(key, F.when(n == 3, F.repeat(F.lit("v"), 513)).otherwise(F.col("event_type"))).alias("m"))
    return rows.groupBy(T.valid_metadata(F.col("m")).alias("good")).agg(F.count(F.lit(1)).alias("n"))


def _refused(call, *arguments) -> bool:
    try:
        call(*arguments)
        return False
    except InvalidArgument:
        return True


@query("requests_refused", "SELECT * FROM (VALUES ('extremum', true), ('good', false), ('groups', true), ('order', true), ('pairs', true), ('range', true), ('time', true), ('whole store', true)) t(name, refused)")
def requests_refused(spark, sf_dir):
    from lethe.model import EventFilter

    bound = engine(spark, sf_dir, groups=("A", "N"))
    told = [
        ("range", _refused(filters.check_memory_filter, MemoryFilter(timestamp_min=9, timestamp_max=3))),
        ("extremum", _refused(filters.check_memory_filter, MemoryFilter(extremum="max", significance_min=3))),
        ("time", _refused(filters.check_event_filter, EventFilter(time_start_min=9, time_end_max=3))),
        ("good", _refused(filters.check_memory_filter, MemoryFilter(timestamp_min=3, timestamp_max=9))),
        ("pairs", _refused(filters.parse_metadata_filters, ["no sign"])),
        ("groups", _refused(filters.write_group, ("A", "N"), "R")),
        ("order", _refused(listing.checked_order, listing.MEMORY_ORDERS, "colour")),
        ("whole store", _refused(bound.purge)),
    ]
    return spark.createDataFrame(told, "name string, refused boolean")


@query("metadata_pairs", f"WITH {MEM} SELECT id FROM mem WHERE m_flag = 'A' AND m_status = 'F'")
def metadata_pairs(spark, sf_dir):
    return filters.filter_memories(Q.mem(spark, sf_dir), MemoryFilter(metadata=filters.parse_metadata_filters(["flag=A", "status=F"]))).select("id")


@query("scoped_listing", f"WITH {MEM} SELECT id FROM mem WHERE group_name IN ('A', 'N') ORDER BY timestamp DESC, id LIMIT 200")
def scoped_listing(spark, sf_dir):
    return engine(spark, sf_dir, groups=("A", "N")).get_memories(MemoryFilter(groups=("A", "N")), limit=1000)[0].select("id")


@query("listing_totals", f"WITH {MEM}, {EV} SELECT (SELECT count(*) FROM mem WHERE group_name = 'A') AS memories, (SELECT count(*) FROM ev WHERE group_name = 'F') AS events, 1::BIGINT AS asked")
def listing_totals(spark, sf_dir):
    """Totals of listings, the second time from the cache."""
    from lethe.model import EventFilter

    e, asked = engine(spark, sf_dir), []
    cache = listing.CountCache(60.0, lambda: 0.0)
    f = MemoryFilter(group="A")
    n = [cache.get("memories", f, lambda: asked.append(1) or e.get_memories(f)[1]) for _ in range(2)]
    return spark.createDataFrame([(n[1], e.get_events(EventFilter(group="F"))[1], len(asked))], "memories long, events long, asked long")


@query("events_page", f"WITH {EV} SELECT id FROM ev WHERE id > '3' ORDER BY id LIMIT 500")
def events_page(spark, sf_dir):
    return relations.page(D.stored_events(spark, sf_dir), "3", 500).select("id")


@query("lookups", f"WITH {MEM}, {EV} SELECT (SELECT count(*) FROM mem WHERE event_id IN ('5', '17')) AS found, EXISTS (SELECT 1 FROM ev WHERE id = '17') AS there, false AS nowhere, (SELECT name FROM ev WHERE id = '17') AS name")
def lookups(spark, sf_dir):
    m, e = D.stored_memories(spark, sf_dir), Q.ev(spark, sf_dir)
    ids = m.where(F.col("event_id").isin("5", "17")).select("id")
    one = relations.one(e, "17").select("name")
    return relations.by_ids(m, ids.union(ids)).agg(F.count(F.lit(1)).alias("found"), F.lit(relations.exists(e, "17")).alias("there"), F.lit(relations.exists(e, "nobody")).alias("nowhere")).join(one)


@query("unique_ids", "SELECT user_id::VARCHAR AS id, min(event_id) AS position FROM events GROUP BY user_id")
def unique_ids(spark, sf_dir):
    ids = D.raw(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.col("user_id").cast("string").alias("id"))
    return relations.unique_ids(ids.union(ids.select("position", F.lit("")))).select("id", "position")


@query("empty_event_deleted", f"WITH {MEM}, {EV} SELECT id FROM ev WHERE id <> (SELECT min(id) FROM ev WHERE id NOT IN (SELECT event_id FROM mem))")
def empty_event_deleted(spark, sf_dir):
    m, e = D.stored_memories(spark, sf_dir), D.stored_events(spark, sf_dir)
    empty = forget.empty_events(e, m).agg(F.min("id")).first()[0]
    return mutate.delete_event_if_empty(mutate.delete_event_if_empty(e, m, empty), m, m.where("event_id <> '' AND event_id NOT LIKE 'gone%'").first().event_id).select("id")


# --- scalar functions


@query("topic_terms", r"WITH t AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: strlen(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + r")) AS r FROM benchmark), u AS (SELECT id, list_filter(r, lambda x, i: list_position(r, x) = i) AS d FROM t) SELECT id, array_to_string(d[1:24], ',') AS terms FROM u")
def topic_terms(spark, sf_dir):
    return D.raw(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_join(T.topic_terms(F.col("text")), ",").alias("terms"))


@query("normalised_keys", "SELECT event_id, left(regexp_replace(regexp_replace(lower('_-X ' || event_type || '/' || user_id || ' É'), '[^a-z0-9._:/-]', '_', 'g'), '^[^a-z0-9]+', ''), 64) AS k FROM events")
def normalised_keys(spark, sf_dir):
    name = F.concat(F.lit("_-X "), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(" É"))
    return D.raw(spark, sf_dir, "events").select("event_id", T.normalised_key(name).alias("k"))


@query("merged_metadata", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'old' ELSE event_type END AS a, CASE WHEN user_id % 2 = 0 THEN event_type END AS b, 'kept' AS c FROM events")
def merged_metadata(spark, sf_dir):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("c"), F.lit("kept"))
    new = F.create_map(F.when(F.col("user_id") % 2 == 0, "b").otherwise("a"), F.col("event_type"))
    m = T.merged_metadata(old, new)
    return D.raw(spark, sf_dir, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("bounded_metadata", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n, event_id % 3 <> 0 AS b FROM events")
def bounded_metadata(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("é"), 257)).otherwise(F.col("event_type"))
    m = T.bounded_metadata(F.create_map(F.lit("b"), value, F.lit("a"), F.col("event_type"), F.lit("c"), F.col("event_type")), max_keys=2)
    m = F.when(F.col("event_id") % 3 == 0, F.map_filter(m, lambda k, v: k != "c")).otherwise(m)
    return D.raw(spark, sf_dir, "events").select("event_id", F.size(m).alias("n"), F.map_contains_key(m, "b").alias("b"))


@query("parsed_metadata", "SELECT event_id, props->>'$.k' AS k FROM (SELECT event_id, json_object('k', event_type) AS props FROM events)")
def parsed_metadata(spark, sf_dir):
    text = F.to_json(F.create_map(F.lit("k"), F.col("event_type")))
    return D.raw(spark, sf_dir, "events").select("event_id", T.parse_metadata(text)["k"].alias("k"))


@query("truncated_bodies", "SELECT doc_id AS id, strlen(text) <= 100 AS whole, strlen(text) AS n FROM documents WHERE text IS NOT NULL")
def truncated_bodies(spark, sf_dir):
    """A cut of at most 100 bytes is a prefix of whole characters, and shorter than that by fewer than four bytes."""
    d = D.raw(spark, sf_dir, "documents").where(F.col("text").isNotNull()).withColumn("cut", T.truncate_utf8(F.col("text"), F.lit(100)))
    good = F.startswith("text", "cut") & (F.octet_length("cut") <= 100) & ((F.octet_length("cut") > 96) | (F.col("cut") == F.col("text")))
    return d.where(good).select(F.col("doc_id").alias("id"), (F.col("cut") == F.col("text")).alias("whole"), F.octet_length("text").cast("long").alias("n"))


@query("stale_instances", f"SELECT event_id, CASE WHEN user_id % 3 = 0 THEN false ELSE {NOW} - epoch_us(ts) * 1000 > 2 * (user_id % 3) * 900000000 * 1000000000 END AS stale FROM events")
def stale_instances(spark, sf_dir):
    rows = D.raw(spark, sf_dir, "events").select("event_id", D.nanos(F.col("ts")).alias("last_seen"), (F.col("user_id") % 3 * 900_000_000).alias("heartbeat_seconds"))
    return rows.select("event_id", T.stale(NOW).alias("stale"))


@query("last_segments", "SELECT page_id AS id, CASE WHEN regexp_extract(url, '[^/]*$') = '' THEN url ELSE regexp_extract(url, '[^/]*$') END AS segment, least(greatest(page_id % 300, 10), 200) AS clamped FROM pages")
def last_segments(spark, sf_dir):
    return D.raw(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.last_segment(F.col("url")).alias("segment"), T.clamp(F.col("page_id") % 300, 10, 200).alias("clamped"))


@query("default_fields", f"SELECT count(*) AS n, count(DISTINCT event_id) AS ids, {NOW} AS timestamp FROM events")
def default_fields(spark, sf_dir):
    e = D.raw(spark, sf_dir, "events").select(F.lit("").alias("id"), F.lit(0).cast("long").alias("timestamp"), F.col("props").alias("body"), "event_id")
    return mutate.with_defaults(e, NOW).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max("timestamp").alias("timestamp"))


@query("curve_points", "SELECT i AS place, round(20.0 / pow(i * 5.0 / 30.0, 0.8), 6) AS value FROM range(1, 31) t(i)")
def curve_points(spark, sf_dir):
    rows = decay.curve(spark, 20.0, Q.BASE, Q.BASE.threshold, 150.0, 30)
    return rows.select(F.round(F.col("age_days") / 5).cast("long").alias("place"), F.round("value", 6).alias("value"))


# --- search modes

_WEIGHTS = Ranking(significance=0.0, recall=0.0)


def _searched(spark, sf_dir, mode: str):
    docs, vectors = D.texts(spark, sf_dir), D.vectors(spark, sf_dir)
    index = None if mode == "semantic" else Q.keyword_index(spark, sf_dir)  # a search by vectors alone needs none
    return search.search(docs, mode, " ".join(Q._ASKED), vectors, Q._query_vector(spark, sf_dir), _WEIGHTS, 15, index).select("id", F.round("score", 6).alias("score"))


_VH = Q._cosine_sql(15).replace("FROM embeddings, q ORDER", "FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents) ORDER")


@query("search_mode_keyword", f"WITH {Q._bm25(15)} SELECT id, round(score, 6) AS score FROM kw")
def search_mode_keyword(spark, sf_dir):
    return _searched(spark, sf_dir, "keyword")


@query("search_mode_semantic", f"WITH {_VH} SELECT id, round(score, 6) AS score FROM vh")
def search_mode_semantic(spark, sf_dir):
    return _searched(spark, sf_dir, "semantic")


@query("search_mode_hybrid", f"WITH {Q._bm25(15)}, {_VH}, p AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY score DESC, id) - 1 AS pos FROM kw UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) - 1 FROM vh), f AS (SELECT id, sum(1 / (60.0 + pos)) AS score, min(l * 1000 + pos) AS first FROM p GROUP BY id) SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, first LIMIT 15")
def search_mode_hybrid(spark, sf_dir):
    return _searched(spark, sf_dir, "hybrid")


@query("search_modes", "SELECT unnest(['keyword', 'semantic', 'hybrid']) AS mode, true AS refused_without_embedder")
def search_modes(spark, sf_dir):
    e = engine(spark, sf_dir)
    refused = _refused(e.search_memories, "words", "semantic")
    return spark.createDataFrame([(m, refused) for m in search.search_modes(True)], "mode string, refused_without_embedder boolean")


@query("search_reinforced", f"WITH {MEM}, h AS (SELECT id FROM mem WHERE NOT is_binary AND regexp_matches(body, '^(AF)+$')) SELECT count(*) AS hits, 10::BIGINT AS recalled FROM h")
def search_reinforced(spark, sf_dir):
    """Of all hits of a word, the ranked ones that are returned are recalled."""
    e = engine(spark, sf_dir)
    word = " ".join("af" * (3 * i) for i in range(1, 8))
    e.search_memories(word, limit=10, reinforce=True)
    s = e.store.read()
    old = e.store.read(1).memories
    hits = search.matching(old, word).agg(F.count(F.lit(1)).alias("hits"))
    before = old.agg(F.sum("recall_count")).first()[0]
    return hits.join(s.memories.agg((F.sum("recall_count") - before).alias("recalled")))


@query("index_updated", f"WITH {Q._WORDS}, p AS (SELECT id, unnest(terms) AS term FROM w WHERE id % 3 <> 0 UNION ALL SELECT doc_id, unnest(['changed', 'text']) FROM documents WHERE doc_id % 3 = 0) SELECT term, count(DISTINCT id) AS df FROM p GROUP BY term")
def index_updated(spark, sf_dir):
    """An index after a third of its documents were indexed anew."""
    docs = D.texts(spark, sf_dir)
    index = search.KeywordIndex(spark, Scratch(spark, "index").path("index"), buckets=8).add(docs)
    index.add(docs.where("id % 3 = 0").withColumn("body", F.lit("Changed text")))
    return index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _embed(text: str) -> list[float]:
    return [float(len(text)), float(text.count("e")), 1.0]


@query("embedded_bodies", "SELECT doc_id AS id, length(coalesce(text, ''))::DOUBLE AS a, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS b FROM documents")
def embedded_bodies(spark, sf_dir):
    rows = search.embedded(D.texts(spark, sf_dir).withColumn("body", F.coalesce("body", F.lit(""))), _embed)
    return rows.select("id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"))


# --- rules and promotion

_RAISING = rules.Ruleset("keep", (
    rules.Rule("ratio", "event.significance / event.memory_count > 1", "promote"),
    rules.Rule("cast", "cast(event.name AS int) > 0", "drop"),
    rules.Rule("rest", "event.significance >= 2", "summarise"),
))


@query("rules_raising", f"WITH {Q._FACTS} SELECT id, CASE WHEN n > 0 AND significance::DOUBLE / n > 1 THEN 'ratio' WHEN significance >= 2 THEN 'rest' ELSE '' END AS rule, CASE WHEN n > 0 AND significance::DOUBLE / n > 1 THEN 0 WHEN n = 0 THEN 2 ELSE 1 END AS errors FROM f")
def rules_raising(spark, sf_dir):
    facts = rules.facts_for(_RAISING, Q.ev(spark, sf_dir), Q.mem(spark, sf_dir))
    return rules.judge(facts, _RAISING).select("id", "rule", F.size("errors").alias("errors"))


@query("rules_over_cap", f"WITH {Q._FACTS} SELECT id, n > 4 AS skipped, CASE WHEN n > 4 THEN '' ELSE rule END AS rule FROM j")
def rules_over_cap(spark, sf_dir):
    e, m = Q.ev(spark, sf_dir), Q.mem(spark, sf_dir)
    verdicts = rules.judge(rules.facts_for(Q.RULESET, e, m, 4), Q.RULESET)
    skipped = rules.over_cap(e, m, 4).select("id", F.lit(True).alias("skipped"), F.lit("").alias("rule"))
    return verdicts.select("id", F.lit(False).alias("skipped"), "rule").unionByName(skipped)


@query("rules_refused", "SELECT * FROM (VALUES ('aggregate', true), ('double name', true), ('good', false), ('keep with set', true), ('no default', true), ('not boolean', true), ('raises', true), ('set type', true), ('summary and top', true), ('unknown field', true)) t(name, refused)")
def rules_refused(spark, sf_dir):
    import json

    rule = {"name": "r", "when": "event.significance > 3", "action": "promote"}
    texts = {
        "good": {"default": "keep", "rules": [rule]}, "no default": {"rules": [rule]}, "double name": {"default": "keep", "rules": [rule, rule]}, "unknown field": {"default": "keep", "rules": [{**rule, "colour": 1}]},
        "not boolean": {"default": "keep", "rules": [{**rule, "when": "event.significance"}]}, "raises": {"default": "keep", "rules": [{**rule, "when": "raise_error('x')"}]},
        "aggregate": {"default": "keep", "rules": [{**rule, "when": "max(event.significance) > 3"}]}, "keep with set": {"default": "keep", "rules": [{**rule, "action": "keep", "set_event": {"name": "'x'"}}]},
        "set type": {"default": "keep", "rules": [{**rule, "set_event": {"significance": "'much'"}}]}, "summary and top": {"default": "keep", "rules": [{**rule, "summarise": True, "keep_top": 2}]},
    }
    return spark.createDataFrame([(name, _refused(rules.parse, spark, json.dumps(x))) for name, x in texts.items()], "name string, refused boolean")


@query("rules_need_memories", "SELECT true AS all_rules, false AS without_held, false AS texts")
def rules_need_memories(spark, sf_dir):
    fewer = rules.Ruleset("keep", Q.RULESET.rules[:3])
    return spark.createDataFrame([(Q.RULESET.needs_memories(spark), fewer.needs_memories(spark), Q.RULESET.needs_texts(spark))], "all_rules boolean, without_held boolean, texts boolean")


@query("promoted_batches", f"WITH {Q._FACTS}, s AS (SELECT id, coalesce(sum(strlen(body) + strlen(id) + strlen(event_id) + coalesce(strlen(m_json), 0) + 128) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kept) SELECT (before // 50000)::BIGINT AS batch, count(*) AS n FROM s GROUP BY 1")
def promoted_batches(spark, sf_dir):
    facts, verdicts = Q._judged(spark, sf_dir)
    sent = rules.changed_memories(Q.mem(spark, sf_dir), facts, verdicts, Q.RULESET)
    return promote.batched(sent, Q.RULESET, most=50_000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("promoted_and_drained", f"WITH {Q._FACTS}, done AS (SELECT * FROM jj WHERE time_end > 0 AND time_end <= {NOW}) SELECT (SELECT count(*) FROM done WHERE action = 'promote') AS sent_events, (SELECT count(*) FROM kept WHERE event_id IN (SELECT id FROM done)) AS sent_memories, (SELECT count(*) FROM ev) - (SELECT count(*) FROM done WHERE action IN ('promote', 'drop')) AS left_events, (SELECT count(*) FROM mem WHERE event_id NOT IN (SELECT id FROM done WHERE action IN ('promote', 'drop'))) AS left_memories")
def promoted_and_drained(spark, sf_dir):
    source, target = store(spark, sf_dir), Store(spark, Scratch(spark, "target").path("t"))
    promote.run(source, target, Q.RULESET, NOW)
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    t, s = target.read(), source.read()
    return count(t.events, "sent_events").join(count(t.memories, "sent_memories")).join(count(s.events, "left_events")).join(count(s.memories, "left_memories"))


@query("promoted_summaries", f"WITH {Q._FACTS}, u AS (SELECT * FROM ms WHERE rule = 'urgent') SELECT event_id, max(sig2)::INT AS significance, count(*) FILTER (NOT is_binary) || ' texts' AS body FROM u GROUP BY event_id HAVING count(*) FILTER (NOT is_binary) > 0")
def promoted_summaries(spark, sf_dir):
    ruleset = rules.Ruleset("keep", (rules.Rule("urgent", Q.RULESET.rules[0].when, "promote", summarise=True),))
    e, m = Q.ev(spark, sf_dir), Q.mem(spark, sf_dir)
    facts = rules.facts_for(ruleset, e, m)
    sent = rules.changed_memories(m, facts, rules.judge(facts, ruleset), ruleset)
    return rules.summarised(sent.where("action = 'promote'"), ruleset, lambda event, bodies: summarise.Tally(bodies), NOW).select("event_id", "significance", "body")


@query("drain_guard", f"WITH {Q._FACTS} SELECT id AS event_id FROM jj WHERE action = 'promote' AND id <> '17'")
def drain_guard(spark, sf_dir):
    """An event that got a memory after it was judged isn't drained."""
    facts, verdicts = Q._judged(spark, sf_dir)
    judged = facts.join(verdicts.where((F.col("action") == "promote") | (F.col("id") == "17")), "id").select(F.col("id").alias("event_id"), "event.memory_count")
    late = Q.mem(spark, sf_dir).where("event_id = '5'").limit(1).withColumn("event_id", F.lit("17"))
    return rules.drainable(judged, Q.mem(spark, sf_dir).unionByName(late))
