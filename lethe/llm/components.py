"""Connected components by alternating large-star and small-star passes.

Before each pass, tasks contract the edges that they read, a bounded number at a time, to stars around the
smallest ids they know: a map without a shuffle. Once so few edges are left that they fit such a bound
together, one more contraction ends the work, so graphs of a few edges need no passes at all.

Each pass keeps at most as many edges as it got, and a component ends as a star around its smallest
id. Passes are written to the shared folder; a vertex with very many edges meets only its own minimum,
in joins between plain shuffles that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit((1 << 31) - 1)))).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(larger end, smallest id) of stars that connect what these edges connect."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while len(x):
        # Each root goes below the smallest root next to it; then all point to their roots.
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
        x, y = low[x], low[y]
        apart = x != y
        x, y = x[apart], y[apart]
    rest = low != np.arange(len(ids))
    return ids[rest], ids[low[rest]]


BOUND = 1_000_000  # edges that a task holds at a time


def _contracted(edges: DataFrame, bound: int) -> DataFrame:
    def run(batches):
        a, b, n = [], [], 0

        def flush():
            found = stars(np.concatenate(a), np.concatenate(b))
            a.clear(), b.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

        for batch in batches:
            a.append(batch.column("a").to_numpy()), b.append(batch.column("b").to_numpy())
            n += len(batch)
            if n >= bound:
                yield flush()
                n = 0
        if n:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", bound: int = BOUND) -> DataFrame:
    """(id, component) of every vertex of edges (a, b), component being its smallest reachable id."""
    flat = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where(F.col("a") != F.col("b"))
    held = scratch.write(_contracted(flat, bound), f"{name}-0")  # a is the larger end
    before, step = _state(held), 0
    while before[0] > bound:
        step += 1
        # Large star: each vertex hands its larger neighbours to its smallest neighbour or itself.
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), f"{name}-low")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = scratch.write(large, f"{name}-large-{step}")
        # Small star: each vertex hands its smaller neighbours, and itself, to the smallest of them.
        lowest = scratch.write(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-lowest")
        moved = large.join(lowest, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = moved.union(lowest.select("a", F.col("low").alias("b"))).distinct()
        new = scratch.write(_contracted(small, bound), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        scratch.drop(f"{name}-large-{step}")
        held, after = new, _state(new)
        if after == before:
            break
        before = after
    if 0 < before[0] <= bound:  # a bounded number of edges
        held = scratch.write(_contracted(held.coalesce(1), bound + 1), f"{name}-last")
    return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(held.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
