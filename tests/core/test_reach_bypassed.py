"""Components of graphs of long paths, whose walk would take a job for every few hops."""

import random

import pytest

from lodeline.operators import reach
from tests.core.test_reach_hub import walks

#: Nodes of the long ring.
LONG = 400


def components(spark, edges):
    return {r.node: r.component for r in reach.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_a_long_ring_with_tails_takes_few_tables(spark, monkeypatch):
    tables, kept = [], reach.materialise
    monkeypatch.setattr(reach, "materialise", lambda df, name: tables.append(name) or kept(df, name))
    ring = [(i, (i + 1) % LONG) for i in range(LONG)]
    tails = [(LONG + i, LONG + i + 1) for i in range(60)] + [(LONG + 60, 7), (9, 1000), *((1000 + i, 1001 + i) for i in range(60))]
    found = components(spark, ring + tails)
    assert {n for n, c in found.items() if c == 0} == set(range(LONG))
    assert all(c == n for n, c in found.items() if n >= LONG)
    assert len(tables) < LONG / 3


@pytest.mark.parametrize(("nodes", "edges", "seed"), [(40, 45, 1), (30, 90, 2), (90, 110, 3)])
def test_components_of_bypassed_nodes_equal_walks(spark, nodes, edges, seed):
    rng = random.Random(seed)
    given = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    given += [(200, 201), (201, 200), (202, 202), (201, 203), *((300 + i, 300 + (i + 1) % 9) for i in range(9)), (304, 0)] + given[:5]
    assert components(spark, given) == walks(given)[1]


def test_nothing_and_loops_only(spark):
    assert components(spark, []) == {}
    assert components(spark, [(5, 5), (6, None)]) == {5: 5}
