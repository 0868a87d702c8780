import random

import pytest

from lodeline.operators import relate


@pytest.mark.parametrize(("kind", "name"), [("long", int), ("string", lambda i: f"r\t{i}")])
def test_pairs_and_hops_equal_walks_and_only_words_are_stored(spark, monkeypatch, kind, name):
    rng = random.Random(4)
    given = [(rng.randrange(200), rng.randrange(200)) for _ in range(700)] + [(5, 5), (None, 3), (7, None), (900, 901)]
    edges = [tuple(None if x is None else name(x) for x in e) for e in given]
    starts = [*range(0, 200, 2), 500, 4, 900]
    stored, kept = [], relate.materialise

    def counting(df, table):
        found = kept(df, table)
        if table == "reach":
            stored.append(found.count())
        return found

    monkeypatch.setattr(relate, "materialise", counting)
    after = {}
    for a, b in given:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    wanted = set()
    for s in set(starts):
        seen, frontier = {s}, {s}
        wanted.add((name(s), name(s), 0))
        for hop in range(1, 4):
            frontier = {n for f in frontier for n in after.get(f, ())} - seen
            seen |= frontier
            wanted |= {(name(s), name(n), hop) for n in frontier}
    found = relate.reachable(spark.createDataFrame(edges, f"src {kind}, dst {kind}"), spark.createDataFrame([(name(s),) for s in starts], f"node {kind}"), 3).collect()
    assert len(found) == len(wanted) and {(r.start, r.node, r.hop) for r in found} == wanted
    assert 0 < sum(stored) < len(wanted) / 4


def test_lines_of_parts_are_ordered_in_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    lines = spark.range(4000).selectExpr("id as l_orderkey", "id % 900 as l_partkey", "cast(1 as int) as l_linenumber", "id % 37 as l_suppkey")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(relate, "LINES", 100, raising=False)
    edges = relate.supplier_edges(spark, str(tmp_path))
    assert edges.rdd.getNumPartitions() == 40 and max(edges.rdd.glom().map(len).collect()) < 400
    assert edges.count() == 4000 - 900
