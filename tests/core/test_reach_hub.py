from lodeline.operators import reach

BEHIND, AHEAD = 24, 24
EDGES = [(0, 1), (1, 0), *((100 + i, 0) for i in range(BEHIND)), *((1, 200 + i) for i in range(AHEAD)), (100, 300), (300, 301), (301, 300), (301, 200), (200, 201), (400, 401)]


def walks(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    found = {}
    for n in after:
        found[n], open_nodes = {n}, [n]
        while open_nodes:
            more = after[open_nodes.pop()] - found[n]
            found[n] |= more
            open_nodes += more
    return found, {n: min(m for m in found[n] if n in found[m]) for n in after}


def test_counts_equal_walks_without_a_pair_for_all_behind_and_ahead_and_without_broadcasts(spark, monkeypatch):
    pairs, broadcast, kept = [], [], reach.materialise

    def watching(df, name):
        broadcast.append("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString())
        found = kept(df, name)
        if name == "paths":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(reach, "materialise", watching)
    monkeypatch.setattr(reach, "customer_edges", lambda *_: spark.createDataFrame(EDGES, "src long, dst long"))
    found, component = walks(EDGES)
    wanted = {(c, len(found[c]), len({component[n] for n in found[c]}) - 1) for c in component.values()}
    assert {tuple(r) for r in reach.q_reachability_unbounded(spark, "").select("component", "reaches", "components").collect()} == wanted
    assert max(pairs) < BEHIND * AHEAD / 4
    assert not any(broadcast)
