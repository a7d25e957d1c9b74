"""Named queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.functions import decay
from lethe.functions import text as T
from lethe.model import DAY, Decay, EventFilter, MemoryFilter, Ranking
from lethe.operators import filters, forget, ingest, levels, links, listing, mutate, relations, rules, search, topics
from lethe.plans import summarise
from lethe.sources import driver_tables as D
from lethe.sources.driver_tables import EV, LINKS_SQL, MEM, NOW
from lethe.sources.scratch import Scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def mem(spark, sf_dir):
    return relations.resolved(D.stored_memories(spark, sf_dir), D.levels(spark), D.N_LEVELS)


def ev(spark, sf_dir):
    return relations.resolved(D.stored_events(spark, sf_dir), D.levels(spark), D.N_LEVELS)


# --- decay and forgetting

DECAYS = {m: Decay(method=m, aggressiveness=a, unit_days=30.0, minimum_age_days=10, retention_days=60, threshold=t, link_weight=0.5, recall_weight=0.25, default_event_significance=3) for m, a, t in ((1, 0.8, 1.0), (2, 0.3, 0.5), (3, 1.5, 0.5), (4, 0.05, 4.0), (5, 1.3, 8.0), (6, 40.0, 20.0))}
BASE = DECAYS[1]

_LINK = lambda c: f"(CASE WHEN {c} > 0 THEN 0.5 * ln(1 + {c}::DOUBLE) ELSE 0.0 END)"
CAND = f"""{MEM}, {EV}, cand AS (SELECT m.*, coalesce(e.significance, 0) AS e_sig, coalesce(e.link_significance, 0) AS e_link, e.id IS NOT NULL AS has_event
  FROM memb m LEFT JOIN ev e ON m.event_id = e.id),
eff AS (SELECT *, (CASE WHEN e_sig = 0 THEN 3 ELSE e_sig END)::DOUBLE + significance::DOUBLE + {_LINK("e_link")} + {_LINK("link_significance")} + 0.25 * recall_count AS s,
  ({NOW} - since)::DOUBLE / 86400000000000.0 / 30.0 AS age, ({NOW} - since) // 86400000000000 AS days FROM cand)"""
CURVES = {
    1: "s / pow(age, 0.8)", 2: "s / (age * exp(0.3))", 3: "s / (age * (1 + ln(1.5)))", 4: "s / exp(age * 0.05)", 5: "s / (1.3 * ln(age + exp(1)))",
    6: "s / (1 + exp(5.0 * (age / 40.0 - 1)))",
}


def _valued(m):
    def run(spark, sf_dir):
        rows = forget.valued(forget.candidates(mem(spark, sf_dir), ev(spark, sf_dir)), NOW, DECAYS[m])
        return rows.select("id", F.when(F.col("value") > 1e300, F.lit(-1.0)).otherwise(F.round("value", 6)).alias("value"))

    return run


for _m, _sql in CURVES.items():
    query(f"decay_value_m{_m}", f"WITH {CAND} SELECT id, CASE WHEN age <= 0 THEN -1.0 ELSE round({_sql}, 6) END AS value FROM eff")(_valued(_m))
_DUE = lambda m, pressure=1.0: f"days >= 60 AND days >= 10 AND age > 0 AND {CURVES[m]} < {DECAYS[m].threshold * pressure}"


@query("forgettable_by_event", f"WITH {CAND} SELECT event_id, count(*) AS n, sum(body_bytes)::BIGINT AS bytes FROM eff WHERE {_DUE(1)} GROUP BY event_id")
def forgettable_by_event(spark, sf_dir):
    rows = forget.doomed(forget.candidates(mem(spark, sf_dir), ev(spark, sf_dir)), NOW, BASE)
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("body_bytes").alias("bytes"))


@query("consolidate_eventless", f"WITH {CAND} SELECT id FROM eff WHERE event_id = '' AND {_DUE(4)}")
def consolidate_eventless(spark, sf_dir):
    rows = forget.candidates(forget.event_less(mem(spark, sf_dir)), None)
    return forget.doomed(rows, NOW, DECAYS[4]).select("id")


@query("consolidate_event_memories", f"WITH {CAND}, g AS (SELECT * FROM eff WHERE event_id <> ''), d AS (SELECT event_id, count(*) FILTER ({_DUE(4)}) AS doomed, count(*) AS n, bool_or(has_event) AS known FROM g GROUP BY event_id) SELECT event_id, doomed, known AND doomed = n AS emptied FROM d WHERE doomed > 0")
def consolidate_event_memories(spark, sf_dir):
    rows = forget.candidates(mem(spark, sf_dir).where(F.col("event_id") != ""), ev(spark, sf_dir))
    return forget.by_event(rows, forget.is_doomed(NOW, DECAYS[4])).where(F.col("doomed") > 0).select("event_id", "doomed", "emptied")


@query("consolidate_events", f"WITH {MEM}, {EV}, x AS (SELECT *, significance::DOUBLE + {_LINK('link_significance')} AS s, ({NOW} - greatest(time_start, time_end))::DOUBLE / 86400000000000.0 / 30.0 AS age, ({NOW} - greatest(time_start, time_end)) // 86400000000000 AS days FROM ev WHERE id NOT IN (SELECT event_id FROM mem WHERE event_id <> '')) SELECT id FROM x WHERE {_DUE(1)}")
def consolidate_events(spark, sf_dir):
    return forget.doomed_events(ev(spark, sf_dir), mem(spark, sf_dir), NOW, BASE).select("id")


@query("empty_events", f"WITH {MEM}, {EV} SELECT id FROM ev WHERE id NOT IN (SELECT event_id FROM mem WHERE event_id <> '')")
def empty_events(spark, sf_dir):
    return forget.empty_events(ev(spark, sf_dir), D.stored_memories(spark, sf_dir)).select("id")


@query("dangling_events", f"WITH {MEM}, {EV} SELECT event_id, count(*) AS n FROM mem WHERE event_id <> '' AND event_id NOT IN (SELECT id FROM ev) GROUP BY event_id")
def dangling_events(spark, sf_dir):
    named = D.stored_memories(spark, sf_dir).where(F.col("event_id") != "")
    known = D.stored_events(spark, sf_dir).select(F.col("id").alias("event_id"))
    return named.join(known, "event_id", "left_anti").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


EXCESS = 1_000_000
_EVICT = f"ret AS (SELECT *, {CURVES[1]} AS value FROM eff WHERE days >= 60), run AS (SELECT *, coalesce(sum(body_bytes + 256) OVER (ORDER BY round(value, 9), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM ret)"


@query("evict_budget", f"WITH {CAND}, {_EVICT} SELECT id, round(value, 6) AS value, freed_before FROM run WHERE freed_before < {EXCESS}")
def evict_budget(spark, sf_dir):
    rows = forget.valued(forget.candidates(mem(spark, sf_dir), ev(spark, sf_dir)), NOW, BASE)
    return forget.evicted(Scratch(spark, "evict").write(rows, "valued"), EXCESS).select("id", F.round("value", 6).alias("value"), "freed_before")


CAPACITY, USED = 6_000_000, 16_000_000
_CAPPED = Decay(**{**BASE.__dict__, "capacity_bytes": CAPACITY, "capacity_floor": 5_000_000})


@query("preview_forgetting", f"WITH {CAND}, v AS (SELECT *, {CURVES[1]} AS value FROM eff), a AS (SELECT * FROM v WHERE {_DUE(1)}), freed AS (SELECT coalesce(sum(body_bytes + 256), 0) AS f FROM a), x AS (SELECT CASE WHEN {USED} - f > {CAPACITY} THEN {USED} - f - 5000000 ELSE 0 END AS excess FROM freed), r AS (SELECT *, coalesce(sum(body_bytes + 256) OVER (ORDER BY round(value, 9), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v WHERE days >= 60 AND id NOT IN (SELECT id FROM a)), z AS (SELECT 1 AS rule, body_bytes FROM a UNION ALL SELECT 2, body_bytes FROM r, x WHERE b < excess) SELECT rule, count(*) AS n, sum(body_bytes)::BIGINT AS bytes FROM z GROUP BY rule")
def preview_forgetting(spark, sf_dir):
    found = forget.preview(mem(spark, sf_dir), ev(spark, sf_dir), NOW, _CAPPED, USED)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("body_bytes").alias("bytes"))


@query("forgotten_log", f"WITH {CAND}, g AS (SELECT *, row_number() OVER (ORDER BY id) AS seq FROM eff WHERE {_DUE(1)}) SELECT seq, id, event_id, significance, body_bytes, 1 AS rule, {NOW} AS forgotten_at FROM g")
def forgotten_log(spark, sf_dir):
    rows = forget.valued(forget.candidates(mem(spark, sf_dir), ev(spark, sf_dir)), NOW, BASE)
    log = forget.tombstones(forget.doomed(rows, NOW, BASE), 1, BASE.threshold, NOW)
    return log.select("seq", "id", "event_id", "significance", "body_bytes", "rule", "forgotten_at")


@query("forgotten_page", f"WITH {CAND}, g AS (SELECT *, row_number() OVER (ORDER BY id) AS seq FROM eff WHERE {_DUE(1)}) SELECT seq, id FROM g WHERE group_name = 'A' AND seq < 2000 ORDER BY seq DESC LIMIT 50")
def forgotten_page(spark, sf_dir):
    rows = forget.valued(forget.candidates(mem(spark, sf_dir), ev(spark, sf_dir)), NOW, BASE)
    log = forget.tombstones(forget.doomed(rows, NOW, BASE), 1, BASE.threshold, NOW)
    return forget.forgotten(log, group="A", after_seq=2000, limit=50).select("seq", "id")


@query("explain_valuation", f"WITH {CAND}, v AS (SELECT *, {CURVES[1]} AS value, pow(s, 1 / 0.8) AS crossing FROM eff), c AS (SELECT *, greatest(CASE WHEN s / pow(1e6, 0.8) >= 1.0 THEN -1 ELSE crossing END * 30.0, 10.0, 60.0) AS dd FROM v) SELECT id, round(age * 30, 6) AS age_days, round(s, 6) AS effective, days < 60 AS retained, {_DUE(1)} AS due, CASE WHEN dd <= age * 30 THEN 0.0 ELSE round(dd - age * 30, 4) END AS days_left FROM c")
def explain_valuation(spark, sf_dir):
    out = forget.explain(forget.candidates(mem(spark, sf_dir), ev(spark, sf_dir)), NOW, BASE)
    return out.select("id", F.round("age_days", 6).alias("age_days"), F.round("effective", 6).alias("effective"), "retained", "due", F.round("days_left", 4).alias("days_left"))


@query("decay_curve", "SELECT round(i * 2.5, 6) AS age_days, round(20.0 / pow(i * 2.5 / 30.0, 0.8), 6) AS value FROM range(1, 61) t(i)")
def decay_curve(spark, sf_dir):
    return decay.curve(spark, 20.0, BASE, BASE.threshold, 150.0).select(F.round("age_days", 6).alias("age_days"), F.round("value", 6).alias("value"))


@query("retained_stats", f"WITH {MEM} SELECT count(*) AS n, (coalesce(sum(body_bytes), 0) + count(*) * 256)::BIGINT AS bytes FROM memb WHERE since >= {NOW - 400 * DAY}")
def retained_stats(spark, sf_dir):
    return forget.retained_stats(D.stored_memories(spark, sf_dir), NOW - 400 * DAY)


@query("used_bytes", f"WITH {MEM}, {EV}, {LINKS_SQL} SELECT ((SELECT sum(body_bytes + 256) FROM memb) + (SELECT sum(256 + strlen(name) + coalesce(strlen('{{\"priority\":\"' || m_priority || '\"}}'), 0)) FROM ev) + (SELECT count(*) * 256 FROM lk))::BIGINT AS used_bytes")
def used_bytes(spark, sf_dir):
    edges = D.memory_links(spark, sf_dir)
    return forget.used_bytes(D.stored_memories(spark, sf_dir), D.stored_events(spark, sf_dir), edges, edges.limit(0))


@query("event_percentile", f"WITH {EV} SELECT quantile_disc(significance, 0.9)::INT AS significance FROM ev")
def event_percentile(spark, sf_dir):
    return forget.event_percentile(ev(spark, sf_dir), 90)


@query("capacity_pressure", f"WITH {MEM} SELECT round(1 + pow(greatest(count(*) / 50000.0, sum(body_bytes + 256) / 20000000.0), 2.0), 9) AS pressure FROM memb")
def capacity_pressure(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(forget.body_bytes() + 256).alias("b")).first()
    d = Decay(capacity_memories=50_000, capacity_bytes=20_000_000, pressure_exponent=2.0)
    return spark.createDataFrame([(round(decay.pressure(rows.n, rows.b, d), 9),)], "pressure double")


@query("summarisation_candidates", f"WITH {MEM}, {EV} SELECT e.id AS event_id, e.name, count(*) AS n, max(m.since) AS newest FROM memb m JOIN ev e ON m.event_id = e.id WHERE NOT m.is_summary GROUP BY e.id, e.name HAVING count(*) >= 4 AND max(m.since) < {NOW - 200 * DAY}")
def summarisation_candidates(spark, sf_dir):
    return forget.summarisation_candidates(mem(spark, sf_dir), ev(spark, sf_dir), 4, NOW - 200 * DAY).select("event_id", "name", "n", "newest")


@query("summary_event_texts", f"""WITH {MEM}, {EV}, r AS (SELECT event_id, body, significance, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, id) AS r FROM memb
  WHERE event_id <> '' AND NOT is_binary)
  SELECT r.event_id, substr('Event: ' || e.name || chr(10) || 'Group: ' || e.group_name || chr(10) || string_agg(r.r::VARCHAR || '. ' || r.body, chr(10) ORDER BY r.r) FILTER (r.r <= 3), 1, 120) AS prompt,
    max(r.significance) AS top FROM r JOIN ev e ON r.event_id = e.id GROUP BY r.event_id, e.name, e.group_name""")
def summary_event_texts(spark, sf_dir):
    return summarise.event_texts(mem(spark, sf_dir), ev(spark, sf_dir), 3, 120)


# --- scans, filters, counts, listings

_ROW = "id, timestamp, significance, event_id, recall_count, group_name"
MFILTERS = {
    "time_and_group": (MemoryFilter(timestamp_min=NOW - 900 * DAY, timestamp_max=NOW - 300 * DAY, group="R"), f"timestamp BETWEEN {NOW - 900 * DAY} AND {NOW - 300 * DAY} AND group_name = 'R'"),
    "scope_no_event": (MemoryFilter(groups=("A", "N"), has_event=False), "group_name IN ('A', 'N') AND event_id = ''"),
    "one_event": (MemoryFilter(event_id="77"), "event_id = '77'"),
    "metadata": (MemoryFilter(metadata={"flag": "A", "status": "F"}), "m_flag = 'A' AND m_status = 'F'"),
    "recalled": (MemoryFilter(recalled=True, recall_count_min=3, recall_count_max=5, time_recalled_max=NOW - 100 * DAY), f"recall_count BETWEEN 3 AND 5 AND time_recalled > 0 AND time_recalled <= {NOW - 100 * DAY}"),
    "never_recalled": (MemoryFilter(recalled=False, is_summary=False, is_binary=True), "recall_count = 0 AND NOT is_summary AND is_binary"),
    "significance": (MemoryFilter(significance_min=12, significance_max=19), "significance BETWEEN 12 AND 19"),
}
for _name, (_f, _where) in MFILTERS.items():
    query(f"filter_{_name}", f"WITH {MEM} SELECT {_ROW} FROM mem WHERE {_where}")(lambda s, d, f=_f: filters.filter_memories(mem(s, d), f).select(*_ROW.split(", ")))
    query(f"count_{_name}", f"WITH {MEM} SELECT count(*) AS n FROM mem WHERE {_where}")(lambda s, d, f=_f: listing.count_memories(D.stored_memories(s, d), D.levels(s), f))
for _which in ("max", "min"):
    query(f"extremum_{_which}", f"WITH {MEM} SELECT {_ROW} FROM mem WHERE group_name = 'N' AND significance = (SELECT {_which}(significance) FROM mem WHERE group_name = 'N')")(
        lambda s, d, w=_which: filters.filter_memories(mem(s, d), MemoryFilter(group="N", extremum=w)).select(*_ROW.split(", "))
    )
_EROW = "id, time_start, time_end, significance, name, group_name"
EFILTERS = {
    "ended_or_open": (EventFilter(time_end_max=NOW - 1500 * DAY), f"time_end <= {NOW - 1500 * DAY}"),
    "started": (EventFilter(time_start_min=NOW - 2000 * DAY, time_start_max=NOW - 1500 * DAY, group="O", significance_min=2), f"time_start BETWEEN {NOW - 2000 * DAY} AND {NOW - 1500 * DAY} AND group_name = 'O' AND significance >= 2"),
    "metadata": (EventFilter(metadata={"priority": "1-URGENT"}), "m_priority = '1-URGENT'"),
}
for _name, (_f, _where) in EFILTERS.items():
    query(f"events_{_name}", f"WITH {EV} SELECT {_EROW} FROM ev WHERE {_where}")(lambda s, d, f=_f: filters.filter_events(ev(s, d), f).select(*_EROW.split(", ")))
    query(f"count_events_{_name}", f"WITH {EV} SELECT count(*) AS n FROM ev WHERE {_where}")(lambda s, d, f=_f: listing.count_events(D.stored_events(s, d), D.levels(s), f))


def _sql_order(orders, name, up):
    columns, naturally = orders[name]
    up = naturally if up is None else up
    way, tie = ("ASC", "DESC") if up else ("DESC", "ASC")
    return ", ".join([f"{c} {way}" for c in columns] + [f"id {tie if columns else way}"])


for _name in listing.MEMORY_ORDERS:
    for _up, _tag in ((None, ""), (not listing.MEMORY_ORDERS[_name][1], "_reversed")):
        _o = _sql_order(listing.MEMORY_ORDERS, _name, _up)
        query(f"list_memories_{_name}{_tag}", f"WITH {MEM} SELECT id, row_number() OVER (ORDER BY {_o}) AS place FROM mem WHERE event_id <> '' ORDER BY {_o} LIMIT 50 OFFSET 10")(
            lambda s, d, n=_name, u=_up: _placed(listing.list_memories(mem(s, d), MemoryFilter(has_event=True), n, u, 50, 10), listing.order_by(listing.MEMORY_ORDERS, n, u), 10)
        )
for _name in listing.EVENT_ORDERS:
    for _up, _tag in ((None, ""), (not listing.EVENT_ORDERS[_name][1], "_reversed")):
        _o = _sql_order(listing.EVENT_ORDERS, _name, _up)
        query(f"list_events_{_name}{_tag}", f"WITH {EV} SELECT id, row_number() OVER (ORDER BY {_o}) AS place FROM ev ORDER BY {_o} LIMIT 25")(
            lambda s, d, n=_name, u=_up: _placed(listing.list_events(ev(s, d), EventFilter(), n, u, 25), listing.order_by(listing.EVENT_ORDERS, n, u), 0)
        )


def _placed(page, order, offset):
    """A page's ids with their places; the page is bounded by its limit."""
    from pyspark.sql import Window

    return page.select("id", (F.row_number().over(Window.orderBy(*order)) + offset).alias("place"))


@query("memories_page", f"WITH {MEM} SELECT id FROM mem WHERE id > '3' AND group_name IN ('A', 'R') ORDER BY id LIMIT 500")
def memories_page(spark, sf_dir):
    return relations.page(D.stored_memories(spark, sf_dir), "3", 500, ("A", "R")).select("id")


@query("indexable_page", f"WITH {MEM} SELECT id FROM mem WHERE id > '2' AND NOT is_binary ORDER BY id LIMIT 300")
def indexable_page(spark, sf_dir):
    return relations.indexable_page(D.stored_memories(spark, sf_dir), "2", 300).select("id")


def _ids(spark, *ids):
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "position long, id string")


@query("memories_of_events", f"WITH {MEM} SELECT event_id, id FROM mem WHERE event_id IN ('5', '17', '4711', 'none')")
def memories_of_events(spark, sf_dir):
    return relations.of_events(mem(spark, sf_dir), _ids(spark, "5", "17", "4711", "none", "5")).select("event_id", "id")


@query("missing_ids", "SELECT 'nobody' AS id, 1::BIGINT AS position UNION ALL SELECT '-3', 3")
def missing_ids(spark, sf_dir):
    return relations.missing(_ids(spark, "5", "nobody", "17", "-3"), D.stored_events(spark, sf_dir)).select("id", "position")


@query("outside_groups", f"WITH {EV}, q(id) AS (VALUES ('1'), ('2'), ('3'), ('4'), ('gone')) SELECT id FROM q WHERE id NOT IN (SELECT id FROM ev WHERE group_name IN ('F'))")
def outside_groups(spark, sf_dir):
    return relations.outside_groups(_ids(spark, "1", "2", "3", "4", "gone"), D.stored_events(spark, sf_dir), ("F",)).select("id")


@query("count_by_membership", f"WITH {MEM} SELECT count(*) FILTER (event_id <> '') AS with_event, count(*) FILTER (event_id = '') AS without_event FROM mem")
def count_by_membership(spark, sf_dir):
    return listing.count_by_membership(D.stored_memories(spark, sf_dir))


@query("count_by_event", f"WITH {MEM}, {EV} SELECT ev.id AS event_id, count(mem.id) AS n FROM ev LEFT JOIN mem ON mem.event_id = ev.id AND mem.group_name IN ('A', 'N') GROUP BY ev.id")
def count_by_event(spark, sf_dir):
    return listing.count_by_event(D.stored_memories(spark, sf_dir), D.stored_events(spark, sf_dir), ("A", "N"))


@query("significance_bands", f"WITH {MEM}, b AS (SELECT CASE WHEN significance <= 25 THEN '1-25' WHEN significance <= 50 THEN '26-50' WHEN significance <= 75 THEN '51-75' ELSE '76-100' END AS band FROM mem WHERE significance > 0) SELECT band, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM b), 6) AS percent FROM b GROUP BY band")
def significance_bands(spark, sf_dir):
    return listing.histogram(mem(spark, sf_dir)).select("band", "n", F.round(F.col("percent").cast("double"), 6).alias("percent"))


@query("events_with_memories", f"WITH {MEM}, {EV} SELECT ev.id, count(mem.id) AS memory_count, coalesce(string_agg(mem.id, ',' ORDER BY mem.timestamp, mem.id), '') AS ids FROM ev LEFT JOIN mem ON mem.event_id = ev.id GROUP BY ev.id")
def events_with_memories(spark, sf_dir):
    out = listing.with_memories(ev(spark, sf_dir), mem(spark, sf_dir))
    return out.select("id", "memory_count", F.array_join(F.transform("memories", lambda m: m["id"]), ",").alias("ids"))


# --- links

@query("link_totals", f"WITH {LINKS_SQL} SELECT id, sum(significance)::BIGINT AS link_significance FROM ends GROUP BY id")
def link_totals(spark, sf_dir):
    return links.link_totals(D.memory_links(spark, sf_dir))


_SEEDS = "seeds AS (SELECT conv_id || ':' || turn AS id FROM conversations WHERE role = 'user' AND turn % 3 = 0)"


def _seeds(spark, sf_dir):
    t = D.raw(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.col("turn") % 3 == 0))
    return t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))


@query("neighbours_one_hop", f"WITH {LINKS_SQL}, {_SEEDS} SELECT DISTINCT other AS id FROM ends WHERE id IN (SELECT id FROM seeds) AND other NOT IN (SELECT id FROM seeds)")
def neighbours_one_hop(spark, sf_dir):
    return links.neighbours(D.memory_links(spark, sf_dir), _seeds(spark, sf_dir))


@query("edges_of_both", f"WITH {LINKS_SQL} SELECT id, other, significance, direction FROM ends WHERE id = '0:1'")
def edges_of_both(spark, sf_dir):
    return links.edges_of(D.memory_links(spark, sf_dir), "0:1").select("id", "other", "significance", "direction")


@query("edges_in_scope", f"WITH {LINKS_SQL} SELECT e.id, e.other FROM ends e JOIN conversations c ON e.other = c.conv_id || ':' || c.turn WHERE c.role = 'assistant'")
def edges_in_scope(spark, sf_dir):
    return links.in_scope(links.ends(D.memory_links(spark, sf_dir)), D.turns(spark, sf_dir), ("assistant",)).select("id", "other")


@query("linked_listing", f"WITH {LINKS_SQL}, {_SEEDS}, n AS (SELECT DISTINCT other AS id FROM ends WHERE id IN (SELECT id FROM seeds) AND other NOT IN (SELECT id FROM seeds)) SELECT c.conv_id || ':' || c.turn AS id, c.role AS group_name FROM conversations c JOIN n ON n.id = c.conv_id || ':' || c.turn")
def linked_listing(spark, sf_dir):
    return links.linked_to(D.turns(spark, sf_dir), D.memory_links(spark, sf_dir), _seeds(spark, sf_dir)).select("id", "group_name")


@query("outgoing_links", f"WITH {LINKS_SQL} SELECT t.id, coalesce(string_agg(lk.to_id || '=' || lk.significance, ',' ORDER BY lk.to_id), '') AS links FROM (SELECT conv_id || ':' || turn AS id FROM conversations) t LEFT JOIN lk ON lk.from_id = t.id GROUP BY t.id")
def outgoing_links(spark, sf_dir):
    out = links.outgoing(D.turns(spark, sf_dir), D.memory_links(spark, sf_dir))
    return out.select("id", F.array_join(F.transform("links", lambda x: F.concat(x["to_id"], F.lit("="), x["significance"].cast("string"))), ",").alias("links"))


@query("pruned_links", f"WITH {LINKS_SQL}, {_SEEDS} SELECT from_id, to_id FROM lk WHERE from_id NOT IN (SELECT id FROM seeds) AND to_id NOT IN (SELECT id FROM seeds)")
def pruned_links(spark, sf_dir):
    return links.prune(D.memory_links(spark, sf_dir), _seeds(spark, sf_dir)).select("from_id", "to_id")


@query("upserted_links", f"WITH {LINKS_SQL} SELECT from_id, to_id, CASE WHEN significance % 2 = 0 THEN 7 ELSE significance END AS significance, {NOW}::BIGINT AS created FROM lk")
def upserted_links(spark, sf_dir):
    have = D.memory_links(spark, sf_dir)
    new = have.where(F.col("significance") % 2 == 0).withColumn("significance", F.lit(7)).withColumn("created", F.lit(NOW + 1))
    return links.upsert_links(have, new)


@query("imported_links", f"WITH {LINKS_SQL}, t AS (SELECT conv_id || ':' || turn AS id FROM conversations WHERE role = 'user') SELECT from_id, to_id FROM lk WHERE from_id IN (SELECT id FROM t) AND to_id IN (SELECT id FROM t)")
def imported_links(spark, sf_dir):
    items = D.turns(spark, sf_dir).where(F.col("group_name") == "user")
    have = D.memory_links(spark, sf_dir)
    return mutate.import_links(items, have.limit(0), have)[0].select("from_id", "to_id")


# --- levels

@query("level_gap_open", "SELECT i + 1000 AS id, (CASE WHEN i >= 20 THEN i + 1 ELSE i END)::INT AS level_rank FROM range(1, 51) t(i)")
def level_gap_open(spark, sf_dir):
    return levels.open_gap(D.levels(spark), 20)


@query("level_placed", "SELECT i + 1000 AS id, (CASE WHEN i >= 6 THEN i + 1 ELSE i END)::INT AS level_rank FROM range(1, 51) t(i) UNION ALL SELECT 1051, 6")
def level_placed(spark, sf_dir):
    return levels.place(D.levels(spark), above=5)[0]


@query("level_compact", "SELECT i + 1000 AS id, (i // 3)::INT AS level_rank FROM range(3, 51, 3) t(i)")
def level_compact(spark, sf_dir):
    return levels.compact(D.levels(spark).where(F.col("level_rank") % 3 == 0))


@query("levels_registered", f"WITH {MEM}, n AS (SELECT DISTINCT significance FROM mem WHERE significance > 25) SELECT i + 1000 AS id, i::INT AS level_rank FROM range(1, 26) t(i) UNION ALL SELECT 1025 + row_number() OVER (ORDER BY significance), significance::INT FROM n")
def levels_registered(spark, sf_dir):
    return levels.register_ranks(D.levels(spark).where("level_rank <= 25"), mem(spark, sf_dir))


# --- mutations

@query("recalled", f"WITH {MEM} SELECT id, CASE WHEN group_name = 'A' THEN {NOW} ELSE time_recalled END AS time_recalled, CASE WHEN group_name = 'A' THEN recall_count + 1 ELSE recall_count END AS recall_count FROM mem")
def recalled(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir)
    asked = rows.where(F.col("group_name") == "A").select("id")
    return mutate.recall(rows, asked.union(asked), NOW).select("id", "time_recalled", "recall_count")


@query("reinforced", f"WITH {MEM} SELECT id, CASE WHEN recall_count = 2 AND since < {NOW} THEN since + trunc(({NOW} - since)::DOUBLE * 0.25)::BIGINT ELSE time_recalled END AS time_recalled FROM memb")
def reinforced(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir)
    return mutate.reinforce(rows, rows.where("recall_count = 2"), NOW, 0.25).select("id", "time_recalled")


@query("updated", f"WITH {MEM} SELECT id, CASE WHEN significance = 0 THEN 'fixed' ELSE body END AS body, CASE WHEN significance = 0 THEN '' ELSE event_id END AS event_id, group_name FROM mem")
def updated(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir)
    changes = rows.where(F.col("significance_level_id").isNull()).select("id", F.lit("fixed").alias("body"), F.lit("").alias("group_name"))
    return mutate.update(rows, changes, clear=("event_id",)).select("id", "body", "event_id", "group_name")


@query("merged_events", f"WITH {MEM} SELECT id, CASE WHEN event_id = '17' THEN '5' ELSE event_id END AS event_id FROM mem")
def merged_events(spark, sf_dir):
    return mutate.move_event(D.stored_memories(spark, sf_dir), "17", "5").select("id", "event_id")


@query("upserted", f"WITH {MEM} SELECT id, CASE WHEN is_summary THEN 'new' ELSE body END AS body, link_significance FROM mem UNION ALL SELECT 'n' || id, 'new', 0 FROM mem WHERE is_summary")
def upserted(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir)
    new = rows.where("is_summary").withColumn("body", F.lit("new")).withColumn("link_significance", F.lit(99).cast("long"))
    return mutate.upsert(rows, new.unionByName(new.withColumn("id", F.concat(F.lit("n"), "id")))).select("id", "body", "link_significance")


@query("guarded_delete", f"WITH {MEM} SELECT id FROM mem WHERE NOT (event_id = '' AND group_name <> 'R')")
def guarded_delete(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir)
    snapshot = rows.where("event_id = ''").select("id", "time_recalled", "recall_count")
    now = mutate.recall(rows, rows.where("event_id = '' AND group_name = 'R'"), NOW)
    return mutate.delete(now, forget.unrecalled(now, snapshot)).select("id")


@query("invalid_rows", f"WITH {MEM} SELECT CASE WHEN strlen(body) > 40 THEN 'size' WHEN timestamp > {NOW - 100 * DAY + 300_000_000_000} THEN 'timestamp' ELSE 'good' END AS reason, count(*) AS n FROM mem GROUP BY 1")
def invalid_rows(spark, sf_dir):
    reason = F.coalesce(mutate.invalid_reason(NOW - 100 * DAY, 40), F.lit("good"))
    return mem(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("summary_replaced", f"WITH {MEM} SELECT id, is_summary FROM mem WHERE event_id <> '5' UNION ALL SELECT 's5', true")
def summary_replaced(spark, sf_dir):
    rows = D.stored_memories(spark, sf_dir)
    return mutate.replace_with_summary(rows, "5", rows.where("event_id <> '5'").orderBy("id").limit(1).withColumn("id", F.lit("s5"))).select("id", "is_summary")


# --- search

_WORDS = "w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms, (n_chars % 100)::INT AS significance, (doc_id % 7)::INT AS recall_count FROM documents)"
_ASKED = ["clown", "thing", "the"]


def _bm25(limit):
    tf = ", ".join(f"len(list_filter(terms, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(_ASKED))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3))
    return f"{_WORDS}, c AS (SELECT id, significance, recall_count, len(terms) AS dl, {tf} FROM w), t AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM c), kw AS (SELECT id, significance, recall_count, {score} AS score FROM c, t WHERE tf0 + tf1 + tf2 > 0 ORDER BY score DESC, id LIMIT {limit})"


_INDEXES: dict = {}


def keyword_index(spark, sf_dir) -> search.KeywordIndex:
    """The stored index of the documents, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = search.KeywordIndex(spark, Scratch(spark, "keyword-index").path("index")).add(D.texts(spark, sf_dir))
    return _INDEXES[key]


@query("keyword_scan_bm25", f"WITH {_bm25(20)} SELECT id, round(score, 6) AS score FROM kw")
def keyword_scan_bm25(spark, sf_dir):
    return search.keyword_hits(D.texts(spark, sf_dir), "The CLOWN, thing!", 20).select("id", F.round("score", 6).alias("score"))


@query("keyword_search_bm25", f"WITH {_bm25(20)} SELECT id, round(score, 6) AS score FROM kw")
def keyword_search_bm25(spark, sf_dir):
    return keyword_index(spark, sf_dir).hits("The CLOWN, thing!", 20).select("id", F.round("score", 6).alias("score"))


def _cosine_sql(limit):
    return f"q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), vh AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q ORDER BY round(score, 9) DESC, id LIMIT {limit})"


def _query_vector(spark, sf_dir):
    return D.vectors(spark, sf_dir).where("id = 7").first().vector


@query("cosine_topk", f"WITH {_cosine_sql(15)} SELECT id, round(score, 6) AS score FROM vh")
def cosine_topk(spark, sf_dir):
    return search.vector_hits(D.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 15).select("id", F.round("score", 6).alias("score"))


@query("rrf_hybrid", f"WITH {_bm25(40)}, {_cosine_sql(40)}, p AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY score DESC, id) - 1 AS pos FROM kw UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) - 1 FROM vh) SELECT id, round(sum(1 / (60.0 + pos)), 9) AS score FROM p GROUP BY id")
def rrf_hybrid(spark, sf_dir):
    a = keyword_index(spark, sf_dir).hits(" ".join(_ASKED), 40)
    b = search.vector_hits(D.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 40)
    return search.fuse(a, b).select("id", F.round("score", 9).alias("score"))


@query("blended_rank", f"WITH {_bm25(40)}, b AS (SELECT id, score / max(score) OVER () + 0.3 * significance / max(significance) OVER () + 0.2 * ln(1 + recall_count) / max(ln(1 + recall_count)) OVER () AS blend FROM kw) SELECT id, round(blend, 6) AS blend FROM b ORDER BY b.blend DESC LIMIT 10")
def blended_rank(spark, sf_dir):
    docs = D.texts(spark, sf_dir)
    w = Ranking()
    return search.rank(keyword_index(spark, sf_dir).hits(" ".join(_ASKED), w.candidates(10)), docs, w, 10).select("id", F.round("blend", 6).alias("blend"))


@query("postings", f"WITH {_WORDS}, p AS (SELECT id, unnest(terms) AS term FROM w) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY term")
def postings(spark, sf_dir):
    return keyword_index(spark, sf_dir).postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("topic_links", r"""WITH t AS (SELECT item_id AS id, unnest(list_slice(list_distinct(regexp_extract_all(text, '[a-z]{7,}')), 1, 10000)) AS term FROM benchmark),
df AS (SELECT term, count(*) AS n FROM t GROUP BY term HAVING count(*) BETWEEN 2 AND 8), r AS (SELECT t.* FROM t JOIN df USING (term)),
s AS (SELECT a.id, b.id AS other, count(*) AS shared FROM r a JOIN r b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rn FROM s WHERE shared >= 1) SELECT id, other, shared FROM k WHERE rn <= 5""")
def topic_links(spark, sf_dir):
    items = D.raw(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0)).alias("terms"))
    return topics.related(items, min_shared=1, limit=5, cap=topics.frequency_cap(100, 8.0))


@query("vector_norms", "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    dot = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return D.vectors(spark, sf_dir).select("id", F.round(F.sqrt(dot), 6).alias("norm"))


# --- rules

RULESET = rules.Ruleset("keep", (
    rules.Rule("urgent", "event.metadata['priority'] = '1-URGENT' AND event.memory_count >= 2", "promote", keep_top=2, set_event={"significance": "event.significance + 10"}),
    rules.Rule("weighty", "event.significance_mean > 30 AND event.memory_count > 0", "promote", min_significance=20, set_memory={"significance": "memory.significance + 1"}),
    rules.Rule("short", "event.duration_seconds > 0 AND event.duration_seconds < 86400 * 3", "summarise"),
    rules.Rule("held", "exists(memories, m -> m.is_summary)", "drop"),
))
_FACTS = f"""{MEM}, {EV}, mf AS (SELECT event_id, count(*) AS n, sum(strlen(body))::BIGINT AS bytes, min(significance) AS lo, max(significance) AS hi, avg(significance) AS mean, bool_or(is_summary) AS summ FROM mem WHERE event_id <> '' GROUP BY event_id),
f AS (SELECT ev.*, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, coalesce(mean, 0.0) AS mean, coalesce(summ, false) AS summ, CASE WHEN time_end > 0 THEN (time_end - time_start) / 1e9 ELSE 0.0 END AS dur FROM ev LEFT JOIN mf ON mf.event_id = ev.id),
j AS (SELECT *, CASE WHEN m_priority = '1-URGENT' AND n >= 2 THEN 'urgent' WHEN mean > 30 AND n > 0 THEN 'weighty' WHEN dur > 0 AND dur < 259200 THEN 'short' WHEN summ THEN 'held' ELSE '' END AS rule FROM f),
jj AS (SELECT *, CASE rule WHEN 'urgent' THEN 'promote' WHEN 'weighty' THEN 'promote' WHEN 'short' THEN 'summarise' WHEN 'held' THEN 'drop' ELSE 'keep' END AS action FROM j),
ms AS (SELECT mem.*, jj.rule, jj.action, mem.significance + CASE WHEN jj.rule = 'weighty' THEN 1 ELSE 0 END AS sig2 FROM mem JOIN jj ON mem.event_id = jj.id),
red AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sig2 DESC, timestamp DESC, id) AS rn FROM ms WHERE action = 'promote' AND (rule <> 'weighty' OR sig2 >= 20)),
kept AS (SELECT * FROM red WHERE rule <> 'urgent' OR rn <= 2)"""


def _judged(spark, sf_dir):
    facts = rules.facts_for(RULESET, ev(spark, sf_dir), mem(spark, sf_dir))
    return facts, rules.judge(facts, RULESET)


@query("event_facts", f"WITH {_FACTS} SELECT id, n AS memory_count, bytes AS body_bytes, lo::INT AS low, hi::INT AS high, round(mean, 6) AS mean, dur AS seconds FROM f")
def event_facts(spark, sf_dir):
    e = rules.event_facts(ev(spark, sf_dir), mem(spark, sf_dir), False)
    return e.select("id", "event.memory_count", "event.body_bytes", F.col("event.significance_min").alias("low"), F.col("event.significance_max").alias("high"), F.round("event.significance_mean", 6).alias("mean"), F.col("event.duration_seconds").alias("seconds"))


@query("rules_first_match", f"WITH {_FACTS} SELECT id, rule, action FROM jj")
def rules_first_match(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("id", "rule", "action")


@query("rules_errors", f"WITH {_FACTS} SELECT count(*) FILTER (m_priority IS NULL AND n >= 2) AS errors FROM f")
def rules_errors(spark, sf_dir):
    return _judged(spark, sf_dir)[1].agg(F.count_if(F.array_contains("errors", "urgent")).alias("errors"))


@query("rules_event_overrides", f"WITH {_FACTS} SELECT id, (significance + CASE WHEN rule = 'urgent' THEN 10 ELSE 0 END)::INT AS significance FROM jj")
def rules_event_overrides(spark, sf_dir):
    facts, verdicts = _judged(spark, sf_dir)
    return rules.changed_events(facts, verdicts, RULESET).select("id", "event.significance")


@query("rules_reduced", f"WITH {_FACTS} SELECT event_id, id, rule, sig2::INT AS significance FROM kept")
def rules_reduced(spark, sf_dir):
    facts, verdicts = _judged(spark, sf_dir)
    return rules.reduced(rules.changed_memories(mem(spark, sf_dir), facts, verdicts, RULESET), RULESET).select("event_id", "id", "rule", "significance")


@query("rules_dry_run", f"WITH {_FACTS}, k AS (SELECT rule, count(*) AS promoted FROM kept GROUP BY rule) SELECT ms.action, ms.rule, count(*) AS memories, coalesce(max(k.promoted), 0) AS promoted FROM ms LEFT JOIN k ON k.rule = ms.rule GROUP BY ms.action, ms.rule")
def rules_dry_run(spark, sf_dir):
    facts, verdicts = _judged(spark, sf_dir)
    return rules.dry_run(rules.changed_memories(mem(spark, sf_dir), facts, verdicts, RULESET), RULESET)


@query("rules_orphans", f"WITH {MEM} SELECT id FROM mem WHERE event_id = '' AND timestamp <= {NOW - 500 * DAY}")
def rules_orphans(spark, sf_dir):
    return rules.orphans(mem(spark, sf_dir), "promote", NOW - 500 * DAY).select("id")


@query("settled_events", f"WITH {EV} SELECT id FROM ev WHERE time_end > 0 AND time_end <= {NOW - 700 * DAY}")
def settled_events(spark, sf_dir):
    return rules.settled(ev(spark, sf_dir), NOW, 700 * DAY).select("id")


# --- ingestion

_LATER = 1_800_000_000_000_000_000


@query("messages_to_memories", "SELECT epoch_us(ts) * 1000 AS timestamp, CASE WHEN floor(value / 10) > 0 THEN floor(value / 10)::INT ELSE 1 END AS significance, 'u' || user_id AS event_id, event_type AS group_name, props AS body, event_type AS subject, user_id::VARCHAR AS user_id, false AS is_binary FROM events")
def messages_to_memories(spark, sf_dir):
    m = ingest.from_messages(D.messages(spark, sf_dir), _LATER)
    return m.select("timestamp", "significance", "event_id", "group_name", "body", F.col("metadata")["subject"].alias("subject"), F.col("metadata")["user_id"].alias("user_id"), "is_binary")


for _mode, _size, _fmt in (("day", DAY, "%Y-%m-%d"), ("hour", DAY // 24, "%Y-%m-%dT%H")):
    query({"day": "daily", "hour": "hourly"}[_mode] + "_event_buckets", f"SELECT event_type || ':' || strftime(date_trunc('{_mode}', ts), '{_fmt}') AS id, event_type AS group_name, epoch_us(max(ts)) * 1000 AS time_end, count(*) AS n FROM events GROUP BY event_type, date_trunc('{_mode}', ts)")(
        lambda s, d, m=_mode: ingest.bucket_events(D.messages(s, d).select(F.col("subject").alias("group_name"), "timestamp"), m).select("id", "group_name", "time_end", "n")
    )


def _logs(spark, sf_dir):
    e = D.raw(spark, sf_dir, "events")
    return e.select(
        D.nanos(F.col("ts")).alias("time"), F.lit(0).cast("long").alias("observed"), (F.col("user_id") % 25).cast("int").alias("severity_number"), F.col("event_type").alias("severity_text"),
        F.col("props").alias("body"), F.create_map(F.lit("service.name"), F.col("event_type")).alias("attributes"), F.create_map(F.lit("group"), F.lit("g")).alias("resource"),
    )


@query("logs_to_memories", "WITH b AS (SELECT *, CASE WHEN user_id % 25 BETWEEN 1 AND 24 THEN (user_id % 25 - 1) // 4 * 4 + 1 WHEN upper(event_type) = 'ERROR' THEN 17 ELSE 0 END AS bk FROM events) SELECT epoch_us(ts) * 1000 AS timestamp, CASE bk WHEN 1 THEN 5 WHEN 5 THEN 10 WHEN 9 THEN 25 WHEN 13 THEN 50 WHEN 17 THEN 75 WHEN 21 THEN 95 ELSE 1 END AS significance, event_type || ':' || strftime(ts, '%Y-%m-%d') AS event_id, '[' || upper(event_type) || '] ' || props AS body, 'g' AS group_name FROM b")
def logs_to_memories(spark, sf_dir):
    return ingest.from_logs(_logs(spark, sf_dir), _LATER).select("timestamp", "significance", "event_id", "body", "group_name")


@query("ingest_outcomes", "SELECT CASE WHEN v > 0 AND v < 3 THEN 'rejected' WHEN event_id % 10 = 0 THEN 'exists' ELSE 'stored' END AS outcome, count(*) AS n FROM (SELECT event_id, floor(value / 10)::INT AS v FROM events) GROUP BY 1")
def ingest_outcomes(spark, sf_dir):
    m = D.messages(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.floor(F.col("value") / 10).cast("int").alias("significance"))
    there = m.where(F.col("id").cast("long") % 10 == 0)
    return ingest.outcomes(m, there, 3).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("worst_outcomes", "SELECT user_id AS message, CASE max(CASE WHEN value < 5 THEN 2 WHEN value < 20 THEN 1 ELSE 0 END) WHEN 2 THEN 'rejected' WHEN 1 THEN 'exists' ELSE 'stored' END AS outcome FROM events GROUP BY user_id")
def worst_outcomes(spark, sf_dir):
    o = F.when(F.col("value") < 5, "rejected").when(F.col("value") < 20, "exists").otherwise("stored")
    return ingest.worst_outcome(D.messages(spark, sf_dir).select(F.col("user_id").alias("message"), o.alias("outcome")))


@query("url_slugs", "SELECT page_id AS id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_slugs(spark, sf_dir):
    return D.raw(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.url_path(F.col("url")).alias("path"))


@query("seeded_recalls", "SELECT o_orderkey AS id, round(ln(1 + o_custkey % 900 + 3))::INT AS recalls FROM orders")
def seeded_recalls(spark, sf_dir):
    return D.raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.seeded_recalls(F.col("o_custkey") % 900, F.lit(3)).alias("recalls"))


@query("metadata_terms", f"WITH {MEM} SELECT id, 'flag=' || m_flag || ',status=' || m_status AS terms, coalesce(strlen(m_json), 0)::BIGINT AS bytes FROM mem WHERE m_flag IS NOT NULL")
def metadata_terms(spark, sf_dir):
    m = D.stored_memories(spark, sf_dir).where(F.col("metadata").isNotNull())
    return m.select("id", F.array_join(T.metadata_terms(F.col("metadata")), ",").alias("terms"), T.metadata_bytes(F.col("metadata")).alias("bytes"))


@query("transfer_sizes", f"WITH {MEM} SELECT sum(strlen(body) + strlen(id) + strlen(event_id) + strlen(group_name) + coalesce(strlen(m_json), 0) + 128)::BIGINT AS bytes FROM mem")
def transfer_sizes(spark, sf_dir):
    return D.stored_memories(spark, sf_dir).agg(F.sum(T.transfer_bytes()).alias("bytes"))


@query("latency_quantiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(value) FILTER (i = floor(0.5 * (n - 1))) AS q50, max(value) FILTER (i = floor(0.99 * (n - 1))) AS q99 FROM r GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    return listing.floor_quantiles(D.raw(spark, sf_dir, "events"), "value", "event_type", 0.5, 0.99)


@query("parsed_times", "SELECT event_id, epoch_us(date_trunc('second', ts)) * 1000 - 3600000000000 AS nanos FROM events")
def parsed_times(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+01:00'")
    return D.raw(spark, sf_dir, "events").select("event_id", T.parse_time(text).alias("nanos"))


@query("cosine_by_label", "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = (SELECT min(vec_id) FROM embeddings c WHERE c.label = a.label)")
def cosine_by_label(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("vector", "id").alias("first"))
    return v.join(first, "label").select("id", F.round(T.cosine(F.col("vector"), F.col("first")), 6).alias("score"))
