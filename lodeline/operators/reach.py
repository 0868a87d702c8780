"""Reachability without a limit of hops: strongly connected components, and the closure of what they form.

Components come from colours: each node takes the least node that reaches it; of one colour, those that reach the node it is named
after are a component. Nodes of it leave, edges between colours too, and what is left takes colours again. Within a component
every node reaches every other, so only pairs of components are closed, by doubling the length of paths in each round.

First one node of many edges, the hub, is walked from both ways. What it reaches and what reaches it is its component; every other one
lies ahead of it, behind it or aside, and all behind it reach all ahead of it, which counts need no pairs for.
Joins shuffle: a broadcast in each round would pass the driver.

Components alone are worked out on a smaller graph: nodes of few edges are bypassed, many at once, so long paths shrink in rounds that grow
with the logarithm of their length, and the walk takes few hops. Bypassed nodes find their component by their neighbours', last round first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.operators.retrieve import read
from lodeline.plans.shared import discard, materialise


#: Hops of one job of a walk.
STRIDE = 4
#: A round of bypassing must take one in WORTH nodes, or it is the last. After FREE rounds a node may leave more edges than it had, LOOSER more each round.
WORTH, FREE, LOOSER = 32, 6, 2


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _replaced(new: DataFrame, old: DataFrame, name: str) -> DataFrame:
    """``new`` as a table, without the one that it came from."""
    table = materialise(new, name)
    discard(old)
    return table


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: something leads to the source and the target leads on."""
    sources, targets = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return _join(_join(edges, sources, "src", "left_semi"), targets, "dst", "left_semi").select("src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that are left when those that cannot lie on a cycle have gone, and those that led to them only; as a table."""
    left = materialise(_both_ways(edges), "graph-left")
    n = left.count()
    while n:
        left = _replaced(_both_ways(_both_ways(left)), left, "graph-left")
        before, n = n, left.count()
        if n == before:
            break
    return left


def around(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, ahead, behind: nodes that those of ``start`` (node) reach, and nodes that reach them, the start both. A job goes STRIDE hops both ways."""
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("src").alias("node"), F.col("dst").alias("next")), F.struct(F.lit(1).alias("way"), F.col("dst").alias("node"), F.col("src").alias("next")))
    steps = materialise(edges.select(F.inline(ways)), "graph-ways")
    known = frontier = materialise(start.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "node"), "graph-around")
    while not frontier.isEmpty():
        ball = frontier
        for _ in range(STRIDE):
            ball = _join(ball, steps, ["way", "node"], "left").select("way", F.explode(F.array_compact(F.array("node", "next"))).alias("node")).distinct()
        more = materialise(_join(ball, known, ["way", "node"], "left_anti"), "graph-more")
        if frontier is not known:
            discard(frontier)
        known, frontier = _replaced(known.unionByName(more), known, "graph-around"), more
    if frontier is not known:
        discard(frontier)
    discard(steps)
    return known.groupBy("node").agg(F.bool_or(F.col("way") == 0).alias("ahead"), F.bool_or(F.col("way") == 1).alias("behind"))


def hub(edges: DataFrame) -> DataFrame:
    """node: the one of most edges in times edges out, the least of those; no row without a node that has both."""
    degree = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(f"n_{c}"))
    return _join(degree("src"), degree("dst"), "node").orderBy(F.desc(F.col("n_src") * F.col("n_dst")), "node").limit(1).select("node")


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it. Rounds shrink as a colour's own colour is taken too."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = materialise(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        ahead = _join(colours.withColumnRenamed("node", "src"), edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("ahead"))
        near = _join(colours, ahead, "node", "left").select("node", F.col("colour").alias("before"), F.least("colour", F.coalesce("ahead", "colour")).alias("colour"))
        near = materialise(near, "colours-near")
        further = near.select(F.col("node").alias("colour"), F.col("colour").alias("further"))
        after = materialise(_join(near, further, "colour").select("node", "before", F.least("colour", "further").alias("colour")), "colours")
        discard(colours, near)
        changed = not after.where("before != colour").isEmpty()
        colours = after.select("node", "colour")
        if not changed:
            return colours


def _classes(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges without repetitions and loops; every node with its side of the hub: "hub", "ahead", "behind" or "aside"; and node, component."""
    given = materialise(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "graph-edges")
    nodes = given.select(F.col("src").alias("node")).union(given.select("dst")).distinct()
    given_edges = given.where("src != dst")
    side = F.when(F.col("ahead") & F.col("behind"), "hub").when(F.col("ahead"), "ahead").when(F.col("behind"), "behind").otherwise("aside")
    sides = materialise(_join(nodes, around(given_edges, hub(given_edges)), "node", "left").select("node", side.alias("side")), "graph-sides")
    s = lambda n: sides.select(F.col("node").alias(n), F.col("side").alias(f"at_{n}"))
    aside = _join(_join(given_edges, s("src"), "src"), s("dst"), "dst").where("at_src = at_dst and at_src != 'hub'").select("src", "dst")
    found = _named(sides.where("side = 'hub'").select("node")).unionByName(_cyclic(_trimmed(aside)))
    return given_edges, sides, materialise(_join(nodes, found, "node", "left").select("node", F.coalesce("colour", "node").alias("component")), "components")


def _named(members: DataFrame) -> DataFrame:
    """node, colour: the nodes of one component, named after the least."""
    return members.crossJoin(F.broadcast(members.agg(F.min("node").alias("colour"))))


def _bypassed(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of ``edges``, a table without repetitions and loops, and the edges of each round (src, dst, at_src, at_dst), at_... true for an end that was bypassed.

    Nodes that nothing leads to or that lead nowhere go with their edges. Of the others, those go that come before all their neighbours in an order
    drawn anew for the round, so no two neighbours go at once, and whose edges in times edges out are not many more than their edges. What led to one now
    leads on to where it led, so the nodes that are left reach each other as before.
    """
    left, rounds = edges, []
    while True:
        nth = len(rounds)
        place = lambda c: F.xxhash64(c, F.lit(nth))  # noqa: B023, E731
        end = lambda c, other, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("out"), (place(c) < place(other)).alias("before"))  # noqa: B023, E731
        ends = left.select(F.inline(F.array(end("src", "dst", 1), end("dst", "src", 0))))
        known = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.count("*").alias("n"), F.bool_and("before").alias("before"))
        ins, outs = F.col("n") - F.col("outs"), F.col("outs")
        few = ins * outs <= F.col("n") + LOOSER * max(0, nth - FREE)
        states = materialise(known.select("node", F.when((ins == 0) | (outs == 0), False).when(F.col("before") & few, True).alias("at")), "graph-states")
        n, gone = states.agg(F.count("*"), F.count("at")).first()
        if gone * WORTH <= n:
            discard(states)
            return left, rounds
        at = lambda c: states.where("at is not null").select(F.col("node").alias(c), F.col("at").alias(f"at_{c}"))  # noqa: B023, E731
        met = _join(_join(left, at("src"), "src", "left"), at("dst"), "dst", "left").where("coalesce(at_src, true) and coalesce(at_dst, true)")
        marked = materialise(met.select("src", "dst", "at_src", "at_dst"), "graph-round")
        round_about = _join(marked.where("at_dst").select(F.col("dst").alias("via"), "src"), marked.where("at_src").select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").where("src != dst")
        after = materialise(marked.where("at_src is null and at_dst is null").select("src", "dst").unionByName(round_about).distinct(), "graph-left")
        discard(states, *([left] if rounds else []))
        rounds.append(marked)
        left = after


def _returned(found: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``found`` (node, colour) with the bypassed nodes that share a component with others: one of its colour led to them and they led to one."""
    for marked in reversed(rounds):
        beside = F.array(F.struct(F.col("at_dst").alias("gone"), F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("way")), F.struct(F.col("at_src").alias("gone"), F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("way")))
        met = marked.select(F.inline(beside)).where("gone").select("node", "other", "way")
        coloured = _join(met, found.withColumnRenamed("node", "other"), "other", "left").select("node", F.coalesce("colour", "other").alias("colour"), "way")
        both = coloured.groupBy("node", "colour").agg(F.min("way").alias("least"), F.max("way").alias("most")).where("least < most").select("node", "colour")
        found = _replaced(found.unionByName(both), found, "components")
        discard(marked)
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of the strongly connected component of every node of (src, dst). Nulls are dropped, repeated edges and loops are fine."""
    given = materialise(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "graph-edges")
    left, rounds = _bypassed(given.where("src != dst"))
    found = _classes(left)[2].withColumnRenamed("component", "colour")
    if rounds:
        discard(left)
    found = _returned(found, rounds)
    nodes = given.select(F.col("src").alias("node")).union(given.select("dst")).distinct()
    coloured = materialise(_join(nodes, found, "node", "left").select("node", F.coalesce("colour", "node").alias("colour")), "components-coloured")
    return _join(coloured, coloured.groupBy("colour").agg(F.min("node").alias("component")), "colour").select("node", "component")


def _cyclic(left: DataFrame) -> DataFrame:
    """node, colour: the nodes of components of two or more nodes, of a table of edges without loops; the table goes."""
    found = left.select(F.col("src").alias("node"), F.col("src").alias("colour")).limit(0)
    found = materialise(found, "graph-found")
    while not left.isEmpty():
        colours = _coloured(left)
        c = lambda n: colours.select(F.col("node").alias(n), F.col("colour").alias(f"of_{n}"))
        inside = materialise(_join(_join(left, c("src"), "src"), c("dst"), "dst").where("of_src = of_dst").select("src", "dst", F.col("of_src").alias("colour")), "graph-inside")
        mine = frontier = materialise(colours.where("node = colour").select("node", "colour"), "graph-members")
        while True:  # backwards from the node that the colour is named after
            step = _join(frontier.withColumnRenamed("node", "dst"), inside, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            more = materialise(_join(step, mine, ["node", "colour"], "left_anti"), "graph-members")
            if more.isEmpty():
                discard(more)
                break
            mine, frontier = mine.unionByName(more), more
        found = found.unionByName(mine)
        gone = mine.select("node")
        rest = _join(_join(inside, gone.withColumnRenamed("node", "src"), "src", "left_anti"), gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        trimmed = _trimmed(rest)
        discard(left, inside, colours)
        left = trimmed
    return found


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of every path of (src, dst), an acyclic graph without loops; the rounds grow with the logarithm of the longest path."""
    return _closed(edges, F.lit(True))


def _closed(edges: DataFrame, kept) -> DataFrame:
    """Paths of ``edges`` that are ``kept``: (src, dst) and what more columns about each end, as src_... and dst_..., say."""
    own = [c for c in edges.columns if c.startswith("src")]
    paths = materialise(edges.where(kept).distinct(), "paths")
    seen = paths.count()
    while True:
        first, then = (paths.select(*(F.col(c).alias(f"via{c[3:]}" if c.startswith(side) else c) for c in paths.columns)) for side in ("dst", "src"))
        longer = _join(first, then, [f"via{c[3:]}" for c in own]).select(*edges.columns).where(kept)
        paths = _replaced(paths.unionByName(longer).distinct(), paths, "paths")
        before, seen = seen, paths.count()
        if seen == before:
            return paths


def _between(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges (src, dst) between components, of nodes whose component, and what more ``of`` says, is known: src, dst, src_..., dst_..."""
    more = [c for c in of.columns if c not in ("node", "component")]
    c = lambda n: of.select(F.col("node").alias(n), F.col("component").alias(f"of_{n}"), *(F.col(m).alias(f"{n}_{m}") for m in more))
    met = _join(_join(edges, c("src"), "src"), c("dst"), "dst").where("of_src != of_dst")
    return met.select(*(x for n in ("src", "dst") for x in (F.col(f"of_{n}").alias(n), *(f"{n}_{m}" for m in more)))).distinct()


def reached(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) and (src, dst) of components: all that is reachable from each node, without a pair for every two nodes of a component."""
    given, _, components = _classes(edges)
    return components, closure(_between(given, components))


def reach_counts(edges: DataFrame) -> DataFrame:
    """component, reaches (nodes, its own among them), components (others that it reaches).

    A component behind the hub's reaches the hub and all ahead of it, which is one sum for all; pairs are closed only for what
    else there is: within a side, from behind to aside and from aside to ahead.
    """
    given, sides, components = _classes(edges)
    of = materialise(_join(components, sides, "node"), "component-sides")
    kept = F.expr("src_side != 'hub' and dst_side != 'hub' and not (src_side = 'behind' and dst_side = 'ahead')")
    paths = _closed(_between(given, of), kept)
    sizes = of.groupBy("component", "side").agg(F.count("*").alias("own"))
    further = _join(paths, sizes.select(F.col("component").alias("dst"), F.col("own").alias("m")), "dst").groupBy(F.col("src").alias("component")).agg(F.sum("m").alias("further"), F.count("*").alias("others"))
    count = lambda side, what: F.coalesce(F.sum(F.when(F.col("side") == side, what)), F.lit(0))
    sums = sizes.agg(count("hub", F.col("own")).alias("core"), count("ahead", F.col("own")).alias("ahead"), count("ahead", F.lit(1)).alias("n_ahead"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    behind, through = F.col("side") == "behind", F.col("side").isin("behind", "hub")
    found = _join(sizes, further, "component", "left").crossJoin(F.broadcast(sums))
    reaches = F.col("own") + zero("further") + F.when(through, F.col("ahead")).otherwise(0) + F.when(behind, F.col("core")).otherwise(0)
    others = zero("others") + F.when(through, F.col("n_ahead")).otherwise(0) + F.when(behind, 1).otherwise(0)
    return found.select("component", reaches.alias("reaches"), others.cast("long").alias("components"))


def _followers(orders: DataFrame) -> DataFrame:
    """src, dst: from the customer of each order to that of the next one of its priority and month."""
    w = Window.partitionBy("o_orderpriority", "day").orderBy("o_orderdate", "o_orderkey")
    months = orders.where("o_custkey is not null").withColumn("day", F.date_trunc("month", "o_orderdate"))
    return months.select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(w).alias("dst")).where("dst is not null")


def large_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between customers of orders of large value."""
    return _followers(read(spark, sf_dir, "orders").where("o_totalprice > 440000")).where("src % 3 != 0")


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the customers of all orders."""
    return _followers(read(spark, sf_dir, "orders"))


def q_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of customers that follow each other, and their sizes."""
    return strong_components(large_order_edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last"))


def q_reachability_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that each component reaches in any number of steps, its own among them."""
    return reach_counts(customer_edges(spark, sf_dir))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_EDGES = """WITH RECURSIVE e0 AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderpriority, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS dst FROM orders WHERE %so_custkey IS NOT NULL),
e AS (SELECT DISTINCT src, dst FROM e0 WHERE dst IS NOT NULL%s),"""
_REACHED = """
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r(src, dst) AS (SELECT node, node FROM n UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
c AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"""
_CLOSED = _EDGES % ("o_totalprice > 440000 AND ", " AND src % 3 <> 0") + _REACHED
#: The closure of all orders.
_CLOSED_ALL = _EDGES % ("", "") + _REACHED
ORACLE = {
    "strong_components": f"{_CLOSED} SELECT component, count(*) AS n, max(node) AS last FROM c GROUP BY 1",
    "reachability_unbounded": f"{_CLOSED_ALL} SELECT component, count(*) AS reaches, count(DISTINCT d.component) FILTER (WHERE d.component <> s.component) AS components FROM r JOIN c s ON s.node = r.src AND s.component = s.node JOIN c d ON d.node = r.dst GROUP BY s.component".replace("SELECT component, count(*) AS reaches", "SELECT s.component, count(*) AS reaches"),
}
