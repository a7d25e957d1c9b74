"""Connected components: few jobs for graphs of few edges, and the same components however many a task may hold."""

import random

import pytest

from lethe.llm.common import Scratch
from lethe.llm.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in list(up)}


def graph():
    r = random.Random(4)
    chain = list(range(-300, 300))
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, i) for i in range(1001, 1200)]
    edges += [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)]
    edges += [(-(1 << 63), (1 << 63) - 1), (7, 7), *edges[:50]]
    return edges


@pytest.mark.parametrize("bound", [20, 200, 1_000_000])
def test_components_for_any_bound(spark, bound):
    edges = graph()
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = [(r.id, r.component) for r in connected_components(df, Scratch(spark, "cc"), bound=bound).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == brute([e for e in edges if e[0] != e[1]])


def test_a_graph_of_few_edges_takes_few_jobs(spark):
    df = spark.createDataFrame(graph(), "a long, b long").repartition(6)
    spark.sparkContext.setJobGroup("few edges", "components")
    try:
        connected_components(df, Scratch(spark, "cc"))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 6
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).isEmpty()
