"""reachable writes the targets of a source as few arrays."""

from lodeline.operators import relate


def test_targets_are_packed(spark, monkeypatch):
    edges = [(0, n) for n in range(1, 101)] * 2 + [(100, 200), (200, 0), (7, 7)]
    written = {}
    plain = relate.materialise

    def recorded(df, name):
        table = plain(df, name)
        written.setdefault(name, table.count())
        return table

    monkeypatch.setattr(relate, "materialise", recorded)
    found = relate.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (200,)], "node long"), 2)
    assert {tuple(r) for r in found.collect()} == {(0, 0, 0), *((0, n, 1) for n in range(1, 101)), (0, 200, 2), (200, 200, 0), (200, 0, 1), *((200, n, 2) for n in range(1, 101))}
    assert written["reach-edges"] <= relate.PARTS + 2
