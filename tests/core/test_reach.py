import random

import pytest

from lodeline.operators.reach import reached


@pytest.mark.parametrize(("nodes", "edges", "seed"), [(40, 45, 1), (30, 90, 2), (60, 50, 3)])
def test_components_and_closure_equal_walks(spark, nodes, edges, seed):
    rng = random.Random(seed)
    given = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    given += [(100 + i, 101 + i) for i in range(12)] + [(112, 100), (3, 100), (3, 3), (200, 200), (None, 1)] + given[:5]
    after = {}
    for a, b in given:
        if a is not None:
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())

    def walk(start):
        seen, open_nodes = {start}, [start]
        while open_nodes:
            for n in after[open_nodes.pop()] - seen:
                seen.add(n)
                open_nodes.append(n)
        return seen

    reach = {n: walk(n) for n in after}
    component = {n: min(m for m in reach[n] if n in reach[m]) for n in after}
    components, paths = reached(spark.createDataFrame(given, "src long, dst long"))
    assert {r.node: r.component for r in components.collect()} == component
    assert {(r.src, r.dst) for r in paths.collect()} == {(component[a], component[b]) for a in after for b in reach[a] if component[a] != component[b]}
