"""The data model: table schemas, filters, settings and errors. Times are nanoseconds; 0 is unset."""

from __future__ import annotations

from dataclasses import dataclass, field

MEMORIES = (
    "id string, timestamp long, significance_level_id long, event_id string, is_binary boolean, time_recalled long, recall_count int, "
    "is_summary boolean, group_name string, link_significance long, body string, metadata map<string,string>"
)
EVENTS = (
    "id string, time_start long, time_end long, significance_level_id long, name string, description string, memories_consolidated boolean, "
    "link_significance long, group_name string, metadata map<string,string>"
)
LEVELS = "id long, level_rank int"
LINKS = "from_id string, to_id string, significance int, created long"
TOMBSTONES = (
    "seq long, id string, event_id string, group_name string, significance int, value double, threshold double, body_bytes long, rule int, "
    "timestamp long, time_recalled long, recall_count int, forgotten_at long"
)
SCHEMAS = {"memories": MEMORIES, "events": EVENTS, "levels": LEVELS, "memory_links": LINKS, "event_links": LINKS, "tombstones": TOMBSTONES}

DAY = 86_400_000_000_000
NEVER = 1.7976931348623157e308
ROW_BYTES = 256  # overhead of a stored row in the size model
LOG_ROW_BYTES = 192
RULE_CONSOLIDATION, RULE_EVICTION = 1, 2


class StoreError(ValueError):
    """A request that the store refuses."""


class NotFound(StoreError):
    pass


class AlreadyExists(StoreError):
    pass


class InvalidArgument(StoreError):
    pass


class InvalidPlacement(StoreError):
    pass


@dataclass(frozen=True)
class MemoryFilter:
    """A conjunction of all set fields; a zero value is no restriction."""

    timestamp_min: int = 0
    timestamp_max: int = 0
    group: str = ""
    groups: tuple[str, ...] = ()  # a caller's scope
    ids: tuple[str, ...] = ()
    event_id: str = ""
    has_event: bool | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    recalled: bool | None = None
    recall_count_min: int = 0
    recall_count_max: int = 0
    time_recalled_min: int = 0
    time_recalled_max: int = 0
    is_summary: bool | None = None
    is_binary: bool | None = None
    extremum: str = ""  # "", "max" or "min"
    significance_min: int = 0
    significance_max: int = 0


@dataclass(frozen=True)
class EventFilter:
    """As MemoryFilter, for events. time_end_max alone also matches open events."""

    time_start_min: int = 0
    time_start_max: int = 0
    time_end_min: int = 0
    time_end_max: int = 0
    group: str = ""
    groups: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)
    extremum: str = ""
    significance_min: int = 0
    significance_max: int = 0


@dataclass(frozen=True)
class Decay:
    """How value falls with age, and when a record is forgotten."""

    method: int = 1
    aggressiveness: float = 1.0
    unit_days: float = 1.0
    minimum_age_days: int = 0
    retention_days: int = 0
    threshold: float = 0.0
    link_weight: float = 0.0
    recall_weight: float = 0.0
    default_event_significance: int = 0
    event_percentile: float = 0.0
    capacity_memories: int = 0
    capacity_bytes: int = 0
    capacity_floor: int = 0
    pressure_exponent: float = 1.0


@dataclass(frozen=True)
class Ranking:
    """Weights of significance and recall beside relevance."""

    significance: float = 0.3
    recall: float = 0.2
    over_fetch: int = 4

    @property
    def active(self) -> bool:
        return bool(self.significance or self.recall)

    def candidates(self, limit: int) -> int:
        return limit * self.over_fetch if self.active else limit
