"""Filters as Columns: a filter's set fields, folded into one conjunction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.text import METADATA_KEY
from lethe.model import EventFilter, InvalidArgument, MemoryFilter


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _metadata(wanted: dict[str, str]) -> list[Column]:
    return [F.col("metadata")[k] == v for k, v in sorted(wanted.items())]


def needs_significance(f: MemoryFilter | EventFilter) -> bool:
    """Whether the registry of levels has to be joined at all."""
    return bool(f.extremum or f.significance_min or f.significance_max)


def check_memory_filter(f: MemoryFilter) -> None:
    for low, high in ((f.timestamp_min, f.timestamp_max), (f.recall_count_min, f.recall_count_max), (f.time_recalled_min, f.time_recalled_max), (f.significance_min, f.significance_max)):
        if low < 0 or high < 0 or (high and high < low):
            raise InvalidArgument("a range's end lies before its start")
    _check_extremum(f)


def check_event_filter(f: EventFilter) -> None:
    for low, high in ((f.time_start_min, f.time_start_max), (f.time_end_min, f.time_end_max), (f.significance_min, f.significance_max)):
        if low < 0 or high < 0 or (high and high < low):
            raise InvalidArgument("a range's end lies before its start")
    if f.time_end_min and f.time_end_min < f.time_start_min or f.time_end_max and f.time_end_max < f.time_start_min:
        raise InvalidArgument("events end before they start")
    _check_extremum(f)


def _check_extremum(f) -> None:
    if f.extremum not in ("", "max", "min"):
        raise InvalidArgument("extremum is max or min")
    if f.extremum and (f.significance_min or f.significance_max):
        raise InvalidArgument("an extremum excludes bounds of significance")


def memory_condition(f: MemoryFilter) -> Column:
    """All of the filter but its ids and extremum, which take joins."""
    c = F.col
    parts: list[Column] = []
    if f.timestamp_min:
        parts.append(c("timestamp") >= f.timestamp_min)
    if f.timestamp_max:
        parts.append(c("timestamp") <= f.timestamp_max)
    if f.group:
        parts.append(c("group_name") == f.group)
    if f.groups:
        parts.append(c("group_name").isin(*f.groups))
    if f.event_id:
        parts.append(c("event_id") == f.event_id)
    if f.has_event is not None:
        parts.append((c("event_id") != "") if f.has_event else (c("event_id") == ""))
    parts += _metadata(f.metadata)
    if f.recalled is not None:
        parts.append((c("recall_count") > 0) if f.recalled else (c("recall_count") == 0))
    if f.recall_count_min:
        parts.append(c("recall_count") >= f.recall_count_min)
    if f.recall_count_max:
        parts.append(c("recall_count") <= f.recall_count_max)
    if f.time_recalled_min:
        parts.append(c("time_recalled") >= f.time_recalled_min)
    if f.time_recalled_max:  # leaves out what was never recalled
        parts.append((c("time_recalled") > 0) & (c("time_recalled") <= f.time_recalled_max))
    if f.is_summary is not None:
        parts.append(c("is_summary") == f.is_summary)
    if f.is_binary is not None:
        parts.append(c("is_binary") == f.is_binary)
    return _all(parts + _bounds(f))


def _bounds(f) -> list[Column]:
    parts = []
    if f.significance_min:
        parts.append(F.col("significance") >= f.significance_min)
    if f.significance_max:
        parts.append(F.col("significance") <= f.significance_max)
    return parts


def event_condition(f: EventFilter) -> Column:
    c = F.col
    parts: list[Column] = []
    if f.time_start_min:
        parts.append(c("time_start") >= f.time_start_min)
    if f.time_start_max:
        parts.append(c("time_start") <= f.time_start_max)
    if f.time_end_min:
        parts.append(c("time_end") >= f.time_end_min)
    if f.time_end_max:
        parts.append(c("time_end") <= f.time_end_max)
    if f.group:
        parts.append(c("group_name") == f.group)
    if f.groups:
        parts.append(c("group_name").isin(*f.groups))
    return _all(parts + _metadata(f.metadata) + _bounds(f))


def at_extremum(rows: DataFrame, which: str) -> DataFrame:
    """All rows of the largest or smallest significance; a one-row aggregate is joined, not a sort."""
    pick = {"max": F.max, "min": F.min}[which]
    edge = rows.agg(pick("significance").alias("significance"))
    return rows.join(F.broadcast(edge), "significance", "left_semi")


def filter_memories(memories: DataFrame, f: MemoryFilter) -> DataFrame:
    check_memory_filter(f)
    rows = memories.where(memory_condition(f))
    if f.ids:
        rows = rows.where(F.col("id").isin(*f.ids))
    return at_extremum(rows, f.extremum) if f.extremum else rows


def filter_events(events: DataFrame, f: EventFilter) -> DataFrame:
    check_event_filter(f)
    rows = events.where(event_condition(f))
    return at_extremum(rows, f.extremum) if f.extremum else rows


def parse_metadata_filters(pairs: list[str]) -> dict[str, str]:
    """key=value pairs; a value may hold further equals signs."""
    import re

    if len(pairs) > 32:
        raise InvalidArgument("too many metadata filters")
    found: dict[str, str] = {}
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign or not re.match(METADATA_KEY, key):
            raise InvalidArgument(f"not a metadata filter: {pair}")
        if found.setdefault(key, value) != value:
            raise InvalidArgument(f"two values for {key}")
    return found


def write_group(groups: tuple[str, ...], requested: str) -> str:
    """The group a caller's record goes to: its only group, or one of its groups that it names."""
    if not groups:
        return requested
    if requested:
        if requested not in groups:
            raise InvalidArgument("the group is outside the caller's scope")
        return requested
    if len(groups) > 1:
        raise InvalidArgument("a caller of several groups has to name one")
    return groups[0]
