"""Promotion rules: a declarative way to route events and their memories.

A rule's condition is a SQL boolean over ``event`` (a struct) and ``memories`` (an array of structs);
the first rule that holds decides. Rules become one CASE over whole tables. Conditions are built without
ANSI mode, where what can't be computed on a row, such as a division by zero, is null: the rule doesn't
hold there, counts as an error of that rule, and later rules are tried. Functions that raise all the
same are refused when rules are parsed.

Memories enter as aggregates; events of any number of memories are judged. Where a condition holds once it
holds for one of the memories (or for all of them), the memory that decides it is found by an aggregate and stands
for all. Only rulesets with other conditions over ``memories`` collect an event's memories in one row, without
their texts unless they read those. A caller may set ``most`` to leave larger events alone; nothing does by default.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.functions.text import merged_metadata, valid_metadata
from lethe.model import InvalidArgument
from lethe.session import setting

ANSI = "spark.sql.ansi.enabled"
ACTIONS = ("promote", "drop", "keep", "summarise")
ORPHANS = ("ignore", "promote", "drop")
EVENT_FACTS = (
    "id string, name string, description string, group string, significance int, metadata map<string,string>, time_start long, time_end long, "
    "duration_seconds double, memory_count long, body_bytes long, significance_min int, significance_max int, significance_mean double"
)
MEMORY_FACTS = "id string, body string, significance int, is_binary boolean, is_summary boolean, recall_count int, time_stamp long, metadata map<string,string>"
NARROW_FACTS = "id string, significance int, is_binary boolean, is_summary boolean, recall_count int, time_stamp long"
RAISING = ("raise_error(", "assert_true(")
EVENT_SET = {"significance": "int", "name": "string", "description": "string", "group": "string", "metadata": "map<string,string>"}
MEMORY_SET = {"significance": "int", "metadata": "map<string,string>"}
FITS = {"int": ("tinyint", "smallint", "int", "bigint"), "string": ("string",), "map<string,string>": ("map<string,string>",)}  # types of expressions that a field takes
MAX_CONDITION = 10_000  # characters
MAX_NAME, MAX_DESCRIPTION = 256, 1024


@dataclass(frozen=True)
class Rule:
    name: str
    when: str
    action: str
    keep_top: int = 0
    min_significance: int = 0
    summarise: bool = False
    set_event: dict[str, str] = field(default_factory=dict)
    set_memory: dict[str, str] = field(default_factory=dict)

    @property
    def reduces(self) -> bool:
        return bool(self.keep_top or self.min_significance or self.summarise)


@dataclass(frozen=True)
class Ruleset:
    default: str
    rules: tuple[Rule, ...]

    def needs_memories(self, spark: SparkSession) -> bool:
        """Whether a condition reads memories: it doesn't resolve without them."""
        return any(not _resolves(_facts(spark).drop("memories"), r.when) for r in self.rules)

    def needs_texts(self, spark: SparkSession) -> bool:
        """Whether a condition reads memories' bodies or metadata."""
        rows = spark.createDataFrame([], f"event struct<{EVENT_FACTS}>, memories array<struct<{NARROW_FACTS}>>")
        return any(not _resolves(rows, r.when) for r in self.rules)

    def deciding(self, spark: SparkSession) -> dict[str, int] | None:
        """For each condition that reads memories, 1 if it is as true as for its best memory and -1 if as for its worst.

        None if a condition is of another kind, or a setting reads memories.
        """
        without = _facts(spark).drop("memories")
        if any(not _resolves(without, e) for r in self.rules for e in r.set_event.values()):
            return None
        sides = {r.when: _side(_condition(spark, r.when)) for r in self.rules if not _resolves(without, r.when)}
        return sides if all(sides.values()) else None


def _condition(spark: SparkSession, text: str) -> JavaObject:
    """A condition's resolved expression."""
    return _facts(spark).select(F.expr(text))._jdf.queryExecution().analyzed().expressions().apply(0)


def _side(node: JavaObject) -> int:
    """1 if an expression's value is the largest (false, null, true) of its values for the memories one by one, -1 if the least, else 0.

    That is so for one ``exists`` or ``forall`` over memories below ANDs, ORs and NOTs with what doesn't read memories.
    """
    parts = [node.children().apply(i) for i in range(node.children().size())]
    reading = [i for i, part in enumerate(parts) if "memories#" in part.references().toString()]
    if len(reading) != 1:
        return 0
    kind, part = node.nodeName(), parts[reading[0]]
    if kind in ("exists", "forall"):
        whole = reading == [0] and part.nodeName() == "AttributeReference"
        return (1 if kind == "exists" else -1) if whole else 0
    return {"Alias": 1, "And": 1, "Or": 1, "Not": -1}.get(kind, 0) * _side(part)


def _facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"event struct<{EVENT_FACTS}>, memories array<struct<{MEMORY_FACTS}>>")


def _type_of(rows: DataFrame, text: str) -> str | None:
    """The type of an expression over rows, or None if it doesn't resolve or may raise."""
    try:
        out = rows.select(F.expr(text).alias("x"))
        plan = out._jdf.queryExecution().analyzed().toString()
        whole = plan.startswith(("Aggregate", "Window", "Generate"))  # an expression over many rows is none of a row
        return None if whole or any(f in plan for f in RAISING) else out.schema[0].dataType.simpleString()
    except Exception as e:
        if type(e).__name__ not in ("AnalysisException", "ParseException"):
            raise
        return None


def _resolves(rows: DataFrame, text: str) -> bool:
    return _type_of(rows, text) is not None


def parse(spark: SparkSession, text: str) -> Ruleset:
    """A ruleset from JSON; unknown fields, double names and conditions that aren't boolean are refused."""
    data = json.loads(text)
    if set(data) - {"default", "rules"} or data.get("default") not in ACTIONS:
        raise InvalidArgument("a ruleset has a default action and rules")
    rules, names = [], set()
    for item in data.get("rules", []):
        try:
            rule = Rule(**item)
        except TypeError as e:
            raise InvalidArgument(str(e)) from e
        if not rule.name or rule.name in names:
            raise InvalidArgument(f"rule names are unique: {rule.name!r}")
        names.add(rule.name)
        if rule.action not in ACTIONS:
            raise InvalidArgument(f"unknown action {rule.action}")
        if (rule.reduces or rule.set_event or rule.set_memory) and rule.action != "promote":
            raise InvalidArgument("only what is promoted is reduced or changed")
        if rule.summarise and (rule.keep_top or rule.min_significance):
            raise InvalidArgument("a summary takes no other reduction")
        facts = _facts(spark)
        if len(rule.when) > MAX_CONDITION or _type_of(facts, rule.when) != "boolean":
            raise InvalidArgument(f"rule {rule.name}: not a condition: {rule.when}")
        for sets, kinds, rows in ((rule.set_event, EVENT_SET, facts), (rule.set_memory, MEMORY_SET, facts.select("event", F.explode("memories").alias("memory")))):
            for name, expression in sets.items():
                found = _type_of(rows, expression) if name in kinds and len(expression) <= MAX_CONDITION else None
                if found is None or found not in FITS[kinds[name]]:
                    raise InvalidArgument(f"rule {rule.name}: cannot set {name}")
        rules.append(rule)
    return Ruleset(data["default"], tuple(rules))


def load(spark: SparkSession, path: str, last: Ruleset | None = None) -> Ruleset:
    """The ruleset of a file; a bad file keeps the last good one."""
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        return parse(spark, text)
    except (InvalidArgument, ValueError):
        if last is None:
            raise
        return last


def event_facts(events: DataFrame, memories: DataFrame, with_memories: bool = True, texts: bool = True, most: int | None = None, deciding: dict[str, int] | None = None) -> DataFrame:
    """(id, event, memories) for each event, or each of at most ``most`` memories.

    Without texts, memories have neither body nor metadata. With ``deciding`` conditions they are one memory for each of these.
    """
    named = memories.where(F.col("event_id") != "")
    totals = named.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("memory_count"), F.sum(F.octet_length("body").cast("long")).alias("body_bytes"), F.min("significance").alias("low"),
        F.max("significance").alias("high"), F.avg("significance").alias("mean"),
    )
    rows = events.join(totals, events["id"] == totals["event_id"], "left").drop("event_id")
    if most is not None:
        rows = rows.where(F.coalesce("memory_count", F.lit(0)) <= most)
        named = named.join(totals.where(F.col("memory_count") <= most).select("event_id"), "event_id", "left_semi")
    none = F.create_map().cast("map<string,string>")
    span = F.when(F.col("time_end") > 0, (F.col("time_end") - F.col("time_start")) / F.lit(1e9)).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    event = F.struct(
        "id", "name", "description", F.col("group_name").alias("group"), "significance", F.coalesce("metadata", none).alias("metadata"),
        "time_start", "time_end", span.alias("duration_seconds"), zero("memory_count").alias("memory_count"), zero("body_bytes").alias("body_bytes"),
        zero("low").alias("significance_min"), zero("high").alias("significance_max"), F.coalesce("mean", F.lit(0.0)).alias("significance_mean"),
    )
    facts = rows.select("id", event.alias("event"))
    empty = F.array().cast(f"array<struct<{MEMORY_FACTS if texts else NARROW_FACTS}>>")
    if not with_memories:
        return facts.withColumn("memories", empty)
    narrow = [F.col("id"), F.col("significance"), F.col("is_binary"), F.col("is_summary"), F.col("recall_count"), F.col("timestamp").alias("time_stamp")]
    item = F.struct(narrow[0], "body", *narrow[1:], F.coalesce("metadata", none).alias("metadata")) if texts else F.struct(*narrow)
    if deciding:
        held = _deciding_memories(named.select("event_id", item.alias("memory")), facts, deciding)
    else:
        listed = F.array_sort(F.collect_list(item), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
        held = named.groupBy("event_id").agg(listed.alias("held"))
    return facts.join(held, F.col("id") == F.col("event_id"), "left").select("id", "event", F.coalesce("held", empty).alias("memories"))


def _deciding_memories(rows: DataFrame, facts: DataFrame, deciding: dict[str, int]) -> DataFrame:
    """(event_id, held): for each condition the memory for which it is most true, or least. Event facts are joined only where a condition reads them."""
    spark = rows.sparkSession
    if any(not _resolves(_facts(spark).drop("event"), when) for when in deciding):
        rows = rows.join(facts.select(F.col("id").alias("event_id"), "event"), "event_id")
    rows = rows.withColumn("memories", F.array("memory"))
    with setting(spark, ANSI, "false"):
        rows = rows.select("event_id", "memory", *(F.expr(when).alias(f"c{i}") for i, when in enumerate(deciding)))
    truth = [F.when(F.col(f"c{i}"), 2).when(~F.col(f"c{i}"), 0).otherwise(1) for i in range(len(deciding))]
    found = [(F.max_by if side > 0 else F.min_by)("memory", t) for t, side in zip(truth, deciding.values())]
    return rows.groupBy("event_id").agg(F.array(*found).alias("held"))


def facts_for(ruleset: Ruleset, events: DataFrame, memories: DataFrame, most: int | None = None) -> DataFrame:
    """The facts that a ruleset's conditions read, and no more."""
    spark = events.sparkSession
    return event_facts(events, memories, ruleset.needs_memories(spark), ruleset.needs_texts(spark), most, ruleset.deciding(spark))


def over_cap(events: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """(id, memory_count) of the events that a caller's cap passes over."""
    n = memories.where(F.col("event_id") != "").groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("memory_count"))
    return n.where(F.col("memory_count") > most).join(events.select("id"), "id", "left_semi")


def judge(facts: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(id, rule, action, errors) for each event: the first rule that holds, else the default; errors of the rules tried."""
    with setting(facts.sparkSession, ANSI, "false"):
        conditions = facts.select("id", *(F.expr(rule.when).alias(f"c{i}") for i, rule in enumerate(ruleset.rules)))
    choice = F.lit(len(ruleset.rules))
    for i in reversed(range(len(ruleset.rules))):
        choice = F.when(F.col(f"c{i}"), F.lit(i)).otherwise(choice)
    rows = conditions.withColumn("at", choice)
    errors = [F.when(F.col(f"c{i}").isNull() & (F.lit(i) < F.col("at")), F.lit(rule.name)) for i, rule in enumerate(ruleset.rules)]
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("at") + 1)
    return rows.select("id", pick([*(r.name for r in ruleset.rules), ""]).alias("rule"), pick([*(r.action for r in ruleset.rules), ruleset.default]).alias("action"), found.alias("errors"))


def settled(events: DataFrame, now: int, settle: int) -> DataFrame:
    """Events that ended long enough ago for late memories to have come."""
    return events.where((F.col("time_end") > 0) & (F.col("time_end") <= now - settle))


def changed_events(facts: DataFrame, verdicts: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(id, event) after the matched rules' settings; values out of bounds leave the field as it is."""
    rows = facts.join(verdicts.select("id", "rule"), "id")
    bounds = {"significance": lambda v: v >= 0, "name": lambda v: F.octet_length(v).between(1, MAX_NAME), "description": lambda v: F.octet_length(v) <= MAX_DESCRIPTION, "metadata": valid_metadata}
    fields = []
    with setting(facts.sparkSession, ANSI, "false"):
        for name, kind in ((f.split()[0], f.split()[1]) for f in EVENT_FACTS.split(", ")):
            value = F.col(f"event.{name}")
            for rule in ruleset.rules:
                if name in rule.set_event:
                    new = F.expr(rule.set_event[name]).cast(EVENT_SET.get(name, kind))
                    good = bounds[name](new) if name in bounds else new.isNotNull()
                    value = F.when((F.col("rule") == rule.name) & new.isNotNull() & good, new).otherwise(value)
            fields.append(value.alias(name))
        return rows.select("id", F.struct(*fields).alias("event"))


def changed_memories(memories: DataFrame, facts: DataFrame, verdicts: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(event_id, rule, action, memory fields) of the judged events' memories, after the matched rules' settings.

    Verdicts are joined to the table of memories; event facts only where a setting reads them.
    """
    sets = [e for r in ruleset.rules for e in r.set_memory.values()]
    # No event has an empty id; the memories of none would all meet in one task.
    rows = memories.where(F.col("event_id") != "").join(verdicts.select(F.col("id").alias("event_id"), "rule", "action"), "event_id")
    if any("event" in e for e in sets):
        rows = rows.join(facts.select(F.col("id").alias("event_id"), "event"), "event_id")
    none = F.create_map().cast("map<string,string>")
    item = F.struct("id", "body", "significance", "is_binary", "is_summary", "recall_count", F.col("timestamp").alias("time_stamp"), F.coalesce("metadata", none).alias("metadata"))
    rows = rows.withColumn("memory", item) if sets else rows
    significance, metadata = F.col("significance"), F.coalesce("metadata", none)
    with setting(memories.sparkSession, ANSI, "false"):
        for rule in ruleset.rules:
            hit = F.col("rule") == rule.name
            if "significance" in rule.set_memory:
                new = F.expr(rule.set_memory["significance"]).cast("int")
                significance = F.when(hit & (new >= 0), new).otherwise(significance)
            if "metadata" in rule.set_memory:
                new = merged_metadata(F.col("metadata"), F.expr(rule.set_memory["metadata"]))
                metadata = F.when(hit & valid_metadata(new), new).otherwise(metadata)
        return rows.select("event_id", "rule", "action", "id", "body", significance.alias("significance"), "is_binary", "is_summary", "recall_count", "timestamp", metadata.alias("metadata"))


def reduced(memories: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Promoted memories that their rule's reduction keeps: a least significance, the top n of an event.

    What rules summarise is left to ``summarised``.
    """
    least, top = F.lit(0), F.lit(0)
    for rule in ruleset.rules:
        least = F.when(F.col("rule") == rule.name, rule.min_significance).otherwise(least)
        top = F.when(F.col("rule") == rule.name, rule.keep_top).otherwise(top)
    rows = memories.where(F.col("action") == "promote").withColumn("__top", top).where(F.col("significance") >= least)
    best = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("significance"), F.desc("timestamp"), "id"))
    return rows.withColumn("__r", best).where((F.col("__top") == 0) | (F.col("__r") <= F.col("__top"))).drop("__top", "__r")


def summarised(memories: DataFrame, ruleset: Ruleset, summariser: Callable[[str, list[str]], str], now: int) -> DataFrame:
    """Promoted memories, where those of events that a rule summarises are one summary.

    An event's texts pass through one task, sorted and read as they come; no event's texts are held at once.
    """
    names = [r.name for r in ruleset.rules if r.summarise]
    hit = F.col("rule").isin(*names) & (F.col("action") == "promote") if names else F.lit(False)
    rest, asked = memories.where(~hit), memories.where(hit)
    if not names:
        return rest
    wanted = asked.where(~F.col("is_binary")).select("event_id", "timestamp", "id", "body")

    def run(batches):
        """A summary of each event, whose rows lie side by side in order; a pass over rows, since most events are small."""
        from lethe.plans.summarise import whole_summary

        rows = (row for batch in batches for row in zip(batch.column("event_id").to_pylist(), batch.column("body").to_pylist()))
        done = ((event_id, whole_summary((body for _, body in texts), partial(summariser, event_id))) for event_id, texts in groupby(rows, itemgetter(0)))
        while some := list(islice(done, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some)], ["event_id", "body"])

    dealt = wanted.repartition("event_id").sortWithinPartitions("event_id", "timestamp", "id").select("event_id", "body")
    texts = dealt.mapInArrow(run, "event_id string, body string")
    top = asked.groupBy("event_id", "rule", "action").agg(F.max("significance").alias("significance"))
    new = texts.join(top, "event_id").select(
        "event_id", "rule", "action", F.concat(F.lit("summary-"), "event_id", F.lit(f"-{now}")).alias("id"), "body", "significance", F.lit(False).alias("is_binary"), F.lit(True).alias("is_summary"),
        F.lit(0).alias("recall_count"), F.lit(now).cast("long").alias("timestamp"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return rest.unionByName(new)


def dry_run(memories: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(action, rule, memories, promoted) without doing anything."""
    kept = reduced(memories, ruleset).groupBy("rule").agg(F.count(F.lit(1)).alias("promoted"))
    counts = memories.groupBy("action", "rule").agg(F.count(F.lit(1)).alias("memories"))
    return counts.join(kept, "rule", "left").select("action", "rule", "memories", F.when(F.col("action") == "promote", F.coalesce("promoted", F.lit(0))).otherwise(F.lit(0)).alias("promoted"))


def orphans(memories: DataFrame, policy: str, cutoff: int = 0) -> DataFrame:
    """Memories of no event that a policy promotes or drops; none if it ignores them."""
    if policy not in ORPHANS:
        raise InvalidArgument(f"a policy is one of {', '.join(ORPHANS)}")
    rows = memories.where(F.col("event_id") == "")
    if cutoff:
        rows = rows.where(F.col("timestamp") <= cutoff)
    return rows.where(F.lit(policy != "ignore")).withColumn("action", F.lit(policy))


def drainable(judged: DataFrame, memories: DataFrame) -> DataFrame:
    """(event_id) of promoted events whose memory count is still what was judged."""
    current = memories.where(F.col("event_id") != "").groupBy("event_id").agg(F.count(F.lit(1)).alias("now"))
    return judged.join(current, "event_id", "left").where(F.coalesce("now", F.lit(0)) == F.col("memory_count")).select("event_id")
