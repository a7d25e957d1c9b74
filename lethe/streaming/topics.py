"""A topic index over a stream: posts are related to recent posts that share rare terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_terms(posts: DataFrame, window: int = 64, cap: int = 8, idle_ms: int = 86_400_000) -> DataFrame:
    """(id, other, term) of a stream of (id, terms): earlier posts that hold a term too.

    The state of a term is its latest ``window`` posts and how many it has seen; a term that more than
    ``cap`` of those hold is common and relates nothing; a term without posts for a while is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        found = []
        for batch in batches:
            for post in sorted(batch["id"]):
                if post in recent:
                    continue
                if len(recent) <= cap:
                    found += [(post, other, key[0]) for other in recent]
                recent = [*recent, post][-window:]
        state.update((recent,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=["id", "other", "term"])

    rows = posts.select("id", F.explode(F.array_distinct("terms")).alias("term"))
    return rows.groupBy("term").applyInPandasWithState(step, "id string, other string, term string", "recent array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def related(found: DataFrame, min_shared: int = 2) -> DataFrame:
    """(id, other, shared) of a micro-batch of shared terms."""
    return found.groupBy("id", "other").agg(F.count_distinct("term").alias("shared")).where(F.col("shared") >= min_shared)
