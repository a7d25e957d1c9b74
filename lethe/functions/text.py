"""Scalar functions of ingestion, metadata and search, as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

METADATA_KEY = "^[A-Za-z0-9][A-Za-z0-9._:/-]{0,63}$"
MAX_KEYS, MAX_KEY_BYTES, MAX_VALUE_BYTES, MAX_METADATA_BYTES = 32, 64, 512, 4096

#: Words that make no topic.
STOP_WORDS = tuple("about after again also because been before being could does down each from have here into just like more most much only other over same should some such than that them then there these they this those through time under very were what when where which while will with would your".split())


def metadata_json(m: Column) -> Column:
    """Canonical JSON with sorted keys; NULL when empty."""
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.when(m.isNotNull() & (F.size(m) > 0), F.to_json(sorted_map))


def metadata_bytes(m: Column) -> Column:
    return F.coalesce(F.octet_length(metadata_json(m)), F.lit(0)).cast("long")


def metadata_terms(m: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def parse_metadata(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def merged_metadata(existing: Column, stamped: Column) -> Column:
    """Both, where what is stamped wins."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(existing, empty), F.coalesce(stamped, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def valid_metadata(m: Column) -> Column:
    entries = F.map_entries(m)
    good = F.forall(entries, lambda e: e["key"].rlike(METADATA_KEY) & (F.octet_length(e["value"]) <= MAX_VALUE_BYTES))
    return m.isNull() | ((F.size(m) <= MAX_KEYS) & good & (metadata_bytes(m) <= MAX_METADATA_BYTES))


def normalised_key(name: Column) -> Column:
    """Lower case, other characters to _, leading marks dropped, 64 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._:/-]", "_"), "^[^a-z0-9]+", ""), 1, MAX_KEY_BYTES)


def bounded_metadata(m: Column, max_keys: int = MAX_KEYS, budget: int = MAX_METADATA_BYTES) -> Column:
    """Entries in key order, without oversize values, while count and bytes (both lengths and 6) allow."""
    entries = F.array_sort(F.filter(F.map_entries(m), lambda e: F.octet_length(e["value"]) <= MAX_VALUE_BYTES))
    size = lambda e: F.octet_length(e["key"]) + F.octet_length(e["value"]) + 6
    none = F.array().cast("array<struct<key:string,value:string>>")
    start = F.struct(none.alias("kept"), F.lit(0).alias("used"))
    fits = lambda acc, e: (F.size(acc["kept"]) < max_keys) & (acc["used"] + size(e) <= budget)
    folded = F.aggregate(
        entries,
        start,
        lambda acc, e: F.struct(
            F.when(fits(acc, e), F.concat(acc["kept"], F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits(acc, e), acc["used"] + size(e)).otherwise(acc["used"]).alias("used"),
        ),
        lambda acc: acc["kept"],
    )
    return F.map_from_entries(folded)


def query_terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def topic_terms(text: Column, most: int = 24, shortest: int = 4) -> Column:
    """The first distinct terms of at least four bytes, without numbers and stop words."""
    runs = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9\u0080-\x{10FFFF}]+")
    good = F.filter(runs, lambda t: (F.octet_length(t) >= shortest) & ~t.rlike("^[0-9]+$") & ~t.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(good), 1, most)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def source_terms(url: Column, text: Column) -> Column:
    """Terms of the address's path if it has any, else of the text."""
    slug = topic_terms(F.coalesce(url_path(url), F.lit("")))
    return F.when(F.size(slug) > 0, slug).otherwise(topic_terms(text))


def cosine(a: Column, b: Column) -> Column:
    """In DOUBLE; 0 for vectors of different lengths or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


@F.pandas_udf(StringType())
def truncate_utf8(text: pd.Series, most: pd.Series) -> pd.Series:
    """At most so many bytes, cut between characters."""
    return pd.Series([None if t is None else t.encode()[:n].decode(errors="ignore") for t, n in zip(text, most)])


@F.pandas_udf(StringType())
def gunzip(body: pd.Series) -> pd.Series:
    """Bodies of archives that were compressed one by one."""
    import gzip

    return pd.Series([None if b is None else gzip.decompress(b).decode() for b in body])


def message_body(data: Column, most: int = 0) -> tuple[Column, Column]:
    """(body, is_binary): text as it is, other bytes in base 64, a placeholder for nothing.

    At most so many bytes if ``most`` isn't 0; text is cut between characters.
    """
    text = lambda bytes_: F.try_validate_utf8(bytes_.cast("string"))
    start = lambda n: F.substring(data, 1, max(0, n))
    held, cut = text(data), start(most) if most else data
    kept = F.when(held.isNotNull(), F.coalesce(*(text(start(most - i)) for i in range(4)))) if most else held  # a character has four bytes at most
    body = F.when(F.octet_length(data) == 0, F.lit("(empty)")).otherwise(F.coalesce(kept, F.base64(cut)))
    return body, (F.octet_length(data) > 0) & held.isNull()


def header_significance(header: Column, default: int) -> Column:
    n = header.try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


def first_set(*choices: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit(""))


def clamped_time(ts: Column, now: int) -> Column:
    return F.when(ts.isNull() | (ts <= 0) | (ts > now), F.lit(now)).otherwise(ts)


#: Severity names and the numbers of their buckets.
SEVERITIES = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "INFORMATION": 9, "NOTICE": 9, "WARN": 13, "WARNING": 13, "ERROR": 17, "ERR": 17, "FATAL": 21, "CRITICAL": 21, "CRIT": 21, "ALERT": 21, "EMERGENCY": 21}
BUCKETS = {1: "TRACE", 5: "DEBUG", 9: "INFO", 13: "WARN", 17: "ERROR", 21: "FATAL"}


def severity_bucket(number: Column, text: Column) -> Column:
    """1, 5, 9, 13, 17 or 21 by number, else by name; 0 for neither."""
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))[F.upper(F.trim(text))], F.lit(0))
    return F.when(number.between(1, 24), ((number - 1) / 4).cast("int") * 4 + 1).otherwise(named)


def severity_label(number: Column, text: Column) -> Column:
    bucket = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))[severity_bucket(number, text)]
    return first_set(F.upper(F.trim(text)), bucket)


def clamp(v: Column, low: Column | int, high: Column | int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(v, as_col(low)), as_col(high))


def severity_significance(number: Column, text: Column, base: dict[int, int], jitter: Column, low: int, high: int) -> Column:
    start = F.coalesce(F.create_map(*(F.lit(x) for kv in base.items() for x in kv))[severity_bucket(number, text)], F.lit(low))
    return clamp(start + jitter, low, high)


def time_bucket(ts_nanos: Column, mode: str) -> Column:
    """The day or hour in UTC, as text."""
    pattern = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH"}[mode]
    size = {"day": 86400, "hour": 3600}[mode]
    seconds = F.floor(ts_nanos / F.lit(1_000_000_000 * size)) * size
    return F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), pattern)


def seeded_recalls(likes: Column, reposts: Column) -> Column:
    return F.round(F.log1p((F.coalesce(likes, F.lit(0)) + F.coalesce(reposts, F.lit(0))).cast("double"))).cast("int")


def last_segment(uri: Column) -> Column:
    tail = F.substring_index(uri, "/", -1)
    return F.when(tail == "", uri).otherwise(tail)


def band(significance: Column) -> Column:
    return F.when(significance <= 25, "1-25").when(significance <= 50, "26-50").when(significance <= 75, "51-75").otherwise("76-100")


def transfer_bytes() -> Column:
    return (F.octet_length("body") + F.octet_length("id") + F.octet_length("event_id") + F.octet_length("group_name")).cast("long") + metadata_bytes(F.col("metadata")) + 128


def stale(now: int) -> Column:
    """Whether an instance's last sign of life is over two heartbeats old."""
    return F.when(F.col("heartbeat_seconds") > 0, F.lit(now) - F.col("last_seen") > 2 * F.col("heartbeat_seconds") * F.lit(1_000_000_000)).otherwise(F.lit(False))


def parse_time(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 time; null if it isn't one."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(shape, F.unix_micros(F.try_to_timestamp(F.upper(text))) * 1000)
