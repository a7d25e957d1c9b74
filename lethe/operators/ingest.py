"""Messages and log records as memories and events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import text as T
from lethe.model import DAY

#: A message transformer, for ``streaming.ingest``: messages in, memories out.
Transformer = Callable[[DataFrame], DataFrame]
OUTCOMES = ("stored", "exists", "rejected")


@dataclass(frozen=True)
class MessageSettings:
    """How (subject, data, headers, timestamp) becomes a memory."""

    group: str = ""
    group_from_subject: bool = True
    significance: int = 1
    group_header: str = "group"
    significance_header: str = "significance"
    event_header: str = "event"
    metadata_headers: tuple[str, ...] = ()
    metadata_prefix: str = "meta-"
    fixed: tuple[tuple[str, str], ...] = ()
    max_body: int = 0  # no limit


def from_messages(messages: DataFrame, now: int, s: MessageSettings = MessageSettings()) -> DataFrame:
    """Memories of broker messages. Headers win over fixed settings; times in the future become now."""
    head = lambda name: F.col("headers")[name]
    body, binary = T.message_body(F.col("data"), s.max_body)
    fixed = F.create_map(*(F.lit(x) for kv in (*s.fixed,) for x in kv)).cast("map<string,string>") if s.fixed else F.create_map().cast("map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    headers = F.coalesce("headers", empty)
    named = F.map_filter(headers, lambda k, v: k.isin(*s.metadata_headers)) if s.metadata_headers else empty
    prefixed = F.map_filter(headers, lambda k, v: k.startswith(s.metadata_prefix))
    stripped = F.map_from_entries(
        F.transform(F.map_entries(prefixed), lambda e: F.struct(T.normalised_key(F.substring(e["key"], len(s.metadata_prefix) + 1, 1000)).alias("key"), e["value"].alias("value")))
    )
    metadata = T.merged_metadata(T.merged_metadata(T.merged_metadata(fixed, F.create_map(F.lit("subject"), F.col("subject"))), named), stripped)
    subject = F.col("subject") if s.group_from_subject else F.lit("")
    row_id = F.sha2(F.concat_ws("\u0001", "subject", F.hex("data"), F.col("timestamp").cast("string")), 256)
    return messages.select(
        T.first_set(head("id"), row_id).alias("id"),
        T.clamped_time(F.col("timestamp"), now).alias("timestamp"),
        T.header_significance(head(s.significance_header), s.significance).alias("significance"),
        T.first_set(head(s.event_header)).alias("event_id"),
        binary.alias("is_binary"),
        F.lit(0).cast("long").alias("time_recalled"),
        F.lit(0).alias("recall_count"),
        F.lit(False).alias("is_summary"),
        T.first_set(head(s.group_header), F.lit(s.group), subject).alias("group_name"),
        F.lit(0).cast("long").alias("link_significance"),
        body.alias("body"),
        T.bounded_metadata(metadata).alias("metadata"),
    )


@dataclass(frozen=True)
class LogSettings:
    """How log records become memories in time-bucketed events."""

    base: tuple[tuple[int, int], ...] = ((1, 5), (5, 10), (9, 25), (13, 50), (17, 75), (21, 95))
    low: int = 1
    high: int = 100
    jitter: int = 0
    bucket: str = "day"
    key: tuple[str, ...] = ("service.name",)


def from_logs(logs: DataFrame, now: int, s: LogSettings = LogSettings()) -> DataFrame:
    """Memories of log records (time, observed, severity_number, severity_text, body, attributes, resource).

    Times fall back from the event's to the observer's to now; jitter is a hash of the row, so replays agree.
    """
    empty = F.create_map().cast("map<string,string>")
    both = lambda name: T.first_set(F.coalesce("attributes", empty)[name], F.coalesce("resource", empty)[name])
    ts = F.least(F.coalesce(F.nullif("time", F.lit(0)), F.nullif("observed", F.lit(0)), F.lit(now)), F.lit(now))
    label = T.severity_label(F.col("severity_number"), F.col("severity_text"))
    shift = F.pmod(F.xxhash64("time", "body"), F.lit(2 * s.jitter + 1)).cast("int") - s.jitter if s.jitter else F.lit(0)
    return logs.select(
        F.sha2(F.concat_ws("\u0001", F.col("time").cast("string"), F.col("observed").cast("string"), "body"), 256).alias("id"),
        ts.alias("timestamp"),
        T.severity_significance(F.col("severity_number"), F.col("severity_text"), dict(s.base), shift, s.low, s.high).alias("significance"),
        F.concat_ws(":", *(both(k) for k in s.key), T.time_bucket(ts, s.bucket)).alias("event_id"),
        both("group").alias("group_name"),
        F.when(label != "", F.concat(F.lit("["), label, F.lit("] "), F.coalesce("body", F.lit("")))).otherwise(F.coalesce("body", F.lit(""))).alias("body"),
        T.bounded_metadata(F.coalesce("attributes", empty)).alias("metadata"),
    )


def bucket_events(memories: DataFrame, mode: str = "day") -> DataFrame:
    """(id, group_name, time_start, time_end, n): one event for each group and day or hour, closed at its last record."""
    size = DAY if mode == "day" else DAY // 24
    start = F.col("timestamp") - F.pmod("timestamp", F.lit(size))
    rows = memories.select("group_name", start.alias("time_start"), "timestamp")
    out = rows.groupBy("group_name", "time_start").agg(F.max("timestamp").alias("time_end"), F.count(F.lit(1)).alias("n"))
    return out.select(F.concat_ws(":", "group_name", T.time_bucket(F.col("time_start"), mode)).alias("id"), "group_name", "time_start", "time_end", "n")


def worst_outcome(results: DataFrame) -> DataFrame:
    """(message, outcome): the worst of a message's memories."""
    rank = F.create_map(*(F.lit(x) for i, o in enumerate(OUTCOMES) for x in (o, i)))
    return results.groupBy("message").agg(F.element_at(F.array(*map(F.lit, OUTCOMES)), F.max(rank[F.col("outcome")]) + 1).alias("outcome"))


def outcomes(new: DataFrame, items: DataFrame, minimum: int = 0) -> DataFrame:
    """(id, outcome) of new memories: refused, already there, or stored."""
    there = items.select("id", F.lit(True).alias("there"))
    outcome = F.when((F.col("significance") > 0) & (F.col("significance") < minimum), "rejected").when(F.col("there"), "exists").otherwise("stored")
    return new.join(there, "id", "left").select("id", outcome.alias("outcome"))


def wanted_posts(posts: DataFrame, languages: tuple[str, ...] = (), least_chars: int = 1, collection: str = "post") -> DataFrame:
    """Created posts of a collection, long enough, in a wanted language or in none."""
    rows = posts.where((F.col("collection") == collection) & (F.col("operation") == "create") & (F.char_length("text") >= least_chars))
    if languages:
        rows = rows.where((F.size(F.coalesce("langs", F.array().cast("array<string>"))) == 0) | F.arrays_overlap("langs", F.array(*map(F.lit, languages))))
    return rows


def captured(replies: DataFrame, known: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts that answer a known post or come from a known author."""
    a = replies.join(known.select(F.col("id").alias("reply_parent")), "reply_parent", "left_semi")
    b = replies.join(authors.select(F.col("id").alias("author")), "author", "left_semi")
    return a.select(*replies.columns).union(b.select(*replies.columns)).dropDuplicates(["uri"])


def threads(posts: DataFrame) -> DataFrame:
    """Posts with the event of their thread: the root that a reply names, else the post itself."""
    return posts.withColumn("event_id", F.coalesce("reply_root", "uri"))


def liked(posts: DataFrame) -> DataFrame:
    """(id) of what likes and reposts refer to: memories to recall."""
    return posts.where(F.col("collection").isin("like", "repost") & (F.col("operation") == "create")).select(F.col("subject_uri").alias("id")).distinct()
