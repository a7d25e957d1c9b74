"""Summaries in place of an event's memories, through a summariser that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.model import InvalidArgument
from lethe.operators.mutate import replace_with_summary

Summariser = Callable[[str, str, list[str]], str]
MAX_BODIES, MAX_CHARS = 100, 20_000
PART_BODIES, PART_CHARS = 200, 32_000  # of one call of a summariser; nothing is left out


def prompt(name: Column, group: Column, bodies: Column, most: int = MAX_BODIES, chars: int = MAX_CHARS) -> Column:
    """Header lines and numbered bodies, cut at a number of bodies and of characters."""
    head = F.concat(F.lit("Event: "), name, F.lit("\nGroup: "), group, F.lit("\n"))
    listed = F.transform(F.slice(bodies, 1, most), lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b))
    return F.substring(F.concat(head, F.array_join(listed, "\n")), 1, chars)


def event_texts(memories: DataFrame, events: DataFrame, most: int = MAX_BODIES, chars: int = MAX_CHARS) -> DataFrame:
    """(event_id, prompt, top) of each event's text memories in order of time.

    A prompt shows the first ``most`` of them, so no more are gathered; top is the largest significance of all.
    """
    rows = memories.where((F.col("event_id") != "") & ~F.col("is_binary"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("timestamp", "id"))
    first = rows.select("event_id", "timestamp", "id", "body").withColumn("place", place).where(F.col("place") <= most)
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"])
    held = first.groupBy("event_id").agg(bodies.alias("bodies"))
    tops = rows.groupBy("event_id").agg(F.max("significance").alias("top"))
    named = events.select(F.col("id").alias("event_id"), "name", F.col("group_name").alias("g"))
    told = held.join(tops, "event_id").join(named, "event_id")
    return told.select("event_id", prompt(F.col("name"), F.col("g"), F.col("bodies"), most, chars).alias("prompt"), "top")


def parts(bodies: Iterable[str]) -> Iterator[list[str]]:
    """All bodies in runs of bounded number and characters, of at least two bodies but for the last."""
    part, chars = [], 0
    for body in bodies:
        if len(part) > 1 and (len(part) >= PART_BODIES or chars + len(body) > PART_CHARS):
            yield part
            part, chars = [], 0
        part.append(body)
        chars += len(body)
    if part:
        yield part


def whole_summary(bodies: Iterable[str], summariser: Callable[[list[str]], str]) -> str | None:
    """A summary of all bodies, or of the summaries of their parts, level by level; none of nothing."""
    texts = [summariser(part) for part in parts(bodies)]
    while len(texts) > 1:
        texts = [summariser(part) if len(part) > 1 else part[0] for part in parts(texts)]
    return texts[0] if texts else None


class Tally(str):
    """A stand-in for a summary, which tells of how many texts it is, counting those behind summaries it is made of."""

    texts: int

    def __new__(cls, bodies: list[str]) -> Tally:
        n = sum(body.texts if isinstance(body, Tally) else 1 for body in bodies)
        made = super().__new__(cls, f"{n} texts")
        made.texts = n
        return made


def summary(memories: DataFrame, events: DataFrame, event_id: str, summariser: Summariser, now: int, minimum: int = 0) -> DataFrame:
    """One row: the summary of all the event's texts; it takes the largest significance of what it replaces."""
    held = memories.where(F.col("event_id") == event_id)
    event = events.where(F.col("id") == event_id).first()
    top = held.orderBy(F.desc("significance"), "timestamp", "id").select("id", "significance").first()
    texts = held.where(~F.col("is_binary"))
    if event is None or texts.isEmpty():
        raise InvalidArgument("nothing to summarise")
    if 0 < top.significance < minimum:
        raise InvalidArgument("the summary would rank below what the store takes")
    bodies = (r.body for r in texts.orderBy("timestamp", "id").select("body").toLocalIterator())
    text = whole_summary(bodies, lambda part: summariser(event.name, event.group_name, part))
    row = memories.where(F.col("id") == top.id).limit(1)
    row = row.withColumn("id", F.lit(f"summary-{event_id}-{now}")).withColumn("body", F.lit(text)).withColumn("timestamp", F.lit(now).cast("long"))
    return row.withColumn("metadata", F.lit(None).cast("map<string,string>"))


def summarise(memories: DataFrame, events: DataFrame, event_id: str, summariser: Summariser, now: int, minimum: int = 0) -> DataFrame:
    """memories with one summary in place of the event's."""
    return replace_with_summary(memories, event_id, summary(memories, events, event_id, summariser, now, minimum))


def automatic(memories: DataFrame, events: DataFrame, summariser: Summariser, now: int, least: int, quiet_nanos: int, limit: int = 10) -> Iterator[tuple[str, DataFrame]]:
    """(event id, summary) of the fullest quiet events, at most ``limit``; one that fails is passed over."""
    from lethe.operators.forget import summarisation_candidates

    for row in summarisation_candidates(memories, events, least, now - quiet_nanos, limit).collect():  # bounded by limit
        try:
            yield row.event_id, summary(memories, events, row.event_id, summariser, now)
        except InvalidArgument:
            continue
