"""Joins, conditional groups, windows and bounded graphs over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.plans.shared import discard, join_checked, materialise
from lodeline.plans.slices import SLICE, SLICES, sliced, with_nearest, with_running_sum
from lodeline.sources.sample import spread

#: Types of a part by words of its name, first match.
KINDS = (("metal", ("steel", "brass", "copper", "tin", "nickel")), ("sized", ("large", "small", "medium", "economy")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Lines of parts that a task puts in order at once.
LINES = 1 << 20
#: Bytes of a frontier that is broadcast; there is one a hop, and all pass the driver.
FRONTIER_BYTES = 2 << 20
#: Arrays that the targets of a source are dealt over, so none holds all of a hub's.
PARTS = 8


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hop): nodes within so many hops of each start, the start included, with the fewest hops.

    A breadth-first search for all starts at once. Starts are numbered; a row of the frontier is a node and, in the bits
    of a word, which of a block of 64 starts first came there at this hop, so a hop joins a row, not a pair, with the edges
    (src, dst) and merges what meets by bit_or. Edges are written once, the targets of a source as sorted arrays: they pass one
    shuffle, and what a hop shuffles of them is a fraction of a row for each. Known bits are taken off, so cycles end. Words become pairs only in the result.
    """
    part = F.pmod(F.xxhash64("dst"), F.lit(PARTS))
    edges = materialise(edges.where("src != dst").groupBy("src", part.alias("part")).agg(F.array_sort(F.collect_set("dst")).alias("nodes")).select("src", "nodes"), "reach-edges")
    numbered = starts.select("node").distinct().repartitionByRange("node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("id"))
    seeds = materialise(numbered.select("node", F.expr("shiftright(id, 6)").alias("block"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bits")), "reach-starts")
    known = seeds.select("node", "block", "bits", F.lit(0).alias("hop"))
    frontier = seeds
    for hop in range(1, hops + 1):
        step = join_checked(edges, frontier.withColumnRenamed("node", "src"), "src", limit=FRONTIER_BYTES).select(F.explode("nodes").alias("node"), "block", "bits", F.lit(0).cast("long").alias("old"))
        both = step.unionByName(known.select("node", "block", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old")))
        merged = both.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        frontier = materialise(merged.select("node", "block", F.expr("bits & ~old").alias("bits"), F.lit(hop).alias("hop")).where("bits != 0"), "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        frontier = frontier.drop("hop")
    discard(edges)
    blocks = materialise(seeds.groupBy("block").agg(F.collect_list(F.struct("node", "bits")).alias("starts")), "reach-blocks")
    found = join_checked(known, blocks, "block", limit=FRONTIER_BYTES).select("node", "hop", F.explode(F.filter("starts", lambda s: s["bits"].bitwiseAND(F.col("bits")) != 0)).alias("s"))
    return found.select(F.col("s.node").alias("start"), "node", "hop")


def first_then_later(rows: DataFrame, keys: list[str], order: str, first, later) -> DataFrame:
    """The first row of each group that is ``first``, and the first after it that is ``later``."""
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("first_at", F.min(F.when(first, F.col(order))).over(w))
    return marked.groupBy(*keys).agg(F.min("first_at").alias("first_at"), F.min(F.when(later & (F.col(order) > F.col("first_at")), F.col(order))).alias("later_at")).where("later_at is not null")


def sessions(events: DataFrame, minutes: int = 30, slices: int = SLICES) -> DataFrame:
    """Events of a user with the number of their session; a longer gap begins one. A user may hold any share of the events."""
    order = ["_at", "event_id"]
    rows = sliced(events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), F.unix_micros(F.col("ts").cast("timestamp")), slices)
    rows = with_nearest(rows, ["user_id"], order, F.col("_at"), "_before")
    rows = rows.withColumn("fresh", F.when(F.col("_before").isNull() | (F.col("_at") - F.col("_before") > minutes * 60_000_000), 1).otherwise(0))
    return with_running_sum(rows, ["user_id"], order, F.col("fresh"), "session").drop("_at", "_before", SLICE)


def supplier_edges(spark, sf_dir):
    """supplier -> supplier: they follow each other in the lines of a part."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    lines = spread(read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), LINES, "l_partkey")
    return lines.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).where("dst is not null and l_suppkey is not null".replace("l_suppkey", "src"))


def q_unguarded_writes(spark, sf_dir):
    """Orders of large value without any returned line: writes without a guard in the same group."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_totalprice > 200000").join(lines, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def q_guarded_semi(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_totalprice > 200000").join(lines, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def q_checked_not_written(spark, sf_dir):
    """Parts ordered but never returned, and returned parts that were never shipped early: anti joins both ways."""
    lines = read(spark, sf_dir, "lineitem")
    returned, kept = lines.where("l_returnflag = 'R'").select("l_partkey").distinct(), lines.where("l_returnflag != 'R'").select("l_partkey").distinct()
    a = kept.join(returned, "l_partkey", "left_anti").select(F.lit("never_returned").alias("kind"), "l_partkey")
    b = returned.join(kept, "l_partkey", "left_anti").select(F.lit("only_returned").alias("kind"), "l_partkey")
    return a.unionByName(b)


def q_left_lookup(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    joined = read(spark, sf_dir, "orders").join(customers, "o_custkey", "left")
    return joined.groupBy(F.coalesce("c_mktsegment", F.lit("info")).alias("segment")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


def q_flow_write_groups(spark, sf_dir):
    """Orders whose lines use a part by more than one supplier: groups of two facts in one place."""
    lines = read(spark, sf_dir, "lineitem")
    grouped = lines.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"), F.count("*").alias("n"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(grouped, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus", "flags").agg(F.count("*").alias("orders"), F.sum("suppliers").alias("suppliers"), F.max("n").alias("most_lines"))


def q_token_kind_lookup(spark, sf_dir):
    name = F.lower("p_name")
    kind = F.lit("unknown")
    for label, words in reversed(KINDS):
        kind = F.when(name.rlike("|".join(words)), label).otherwise(kind)
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), kind.alias("kind"))
    return read(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left").groupBy("kind", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


def q_related_pairs(spark, sf_dir):
    """Pairs of parts of one brand and size whose names share the first four letters: a theta join within equal keys."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.substring(F.lower("p_name"), 1, 4).alias("prefix"), "p_type")
    a, b = parts.alias("a"), parts.alias("b")
    on = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return a.join(b, on).where("a.p_type <> b.p_type").select(F.col("a.p_partkey").alias("left_key"), F.col("b.p_partkey").alias("right_key"))


def q_race_edges(spark, sf_dir):
    """Pairs of roles in a conversation where one speaks before another that shares a word with it."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1)).alias("words"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("next_words", F.lead("words").over(w)).where("next_role is not null and role <> next_role")
    return pairs.groupBy("role", "next_role").agg(F.count("*").alias("n"), F.sum(F.arrays_overlap("words", "next_words").cast("int")).alias("sharing"))


def q_first_then_later(spark, sf_dir):
    return first_then_later(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant", F.col("role") == "user")


def q_conditional_having(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int")) == 1
    return events.groupBy("user_id").agg(has("signup").alias("signup"), has("purchase").alias("purchase"), has("error").alias("error"), F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n")).where("signup and purchase and not error or kinds >= 5").select("user_id", "kinds", "n")


def q_edge_existence(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.agg(*(F.max((F.col("event_type") == k).cast("int")).alias(f"has_{k}") for k in ("view", "error", "refund")), F.max(((F.col("event_type") == "purchase") & (F.col("value") > 0)).cast("int")).alias("paid"), F.count_if(F.col("value").isNull()).alias("no_value"))


def q_next_start(spark, sf_dir):
    """Each signup's number among the user's events, and the event after it."""
    order = ["ts", "event_id"]
    rows = sliced(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), F.unix_micros(F.col("ts").cast("timestamp")))
    ranked = with_nearest(with_running_sum(rows, ["user_id"], order, F.lit(1), "ordinal"), ["user_id"], order, F.col("event_id"), "next_id", after=True)
    return ranked.where("event_type = 'signup'").select("user_id", "event_id", "ordinal", "next_id")


def q_session_gaps(spark, sf_dir):
    return sessions(read(spark, sf_dir, "events")).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n"))


def q_inheritance_argmax(spark, sf_dir):
    """The most ordered part of each brand: greatest count, then least key."""
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    joined = read(spark, sf_dir, "part").join(counts, "p_partkey")
    return joined.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("n", -F.col("p_partkey"))).alias("best"), F.max("n").alias("n"))


def q_reachability_5hop(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("node"))
    found = reachable(supplier_edges(spark, sf_dir), suppliers, 5)
    return found.groupBy("start").agg(F.count("*").alias("n"), F.max("hop").alias("deepest"))


def q_slice_aggregate(spark, sf_dir):
    """Facts of everything within two hops of a start."""
    starts = read(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("node"))
    facts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey", F.col("s_acctbal").cast("decimal(18,2)").alias("balance"))
    return reachable(supplier_edges(spark, sf_dir), starts, 2).join(facts, "node").groupBy("start").agg(F.count("*").alias("n"), F.countDistinct("s_nationkey").alias("nations"), F.sum("balance").alias("balance"))


def q_attack_paths(spark, sf_dir):
    """Two-hop slices as ordered families, the first twenty."""
    slices = q_slice_aggregate(spark, sf_dir)
    family = F.when(F.col("balance") < 0, "insolvent").when(F.col("nations") > 20, "wide").otherwise("narrow")
    rank = F.when(F.col("balance") < 0, 0).when(F.col("nations") > 20, 1).otherwise(2)
    return slices.select("start", family.alias("family"), rank.alias("family_rank")).orderBy("family_rank", "start").limit(20)


def q_actor_model(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.array_join(F.slice(F.array_sort(F.collect_set("conv_id")), 1, 4).cast("array<string>"), ",").alias("evidence"))


def q_grounding_lookup(spark, sf_dir):
    """Each customer's nation by exact name, else in any case, of proposals spelled differently; the unmatched go."""
    nations = read(spark, sf_dir, "nation")
    customers = read(spark, sf_dir, "customer").join(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    proposed = customers.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).when(F.col("c_custkey") % 3 == 1, F.col("n_name")).otherwise(F.concat("n_name", F.lit("?"))).alias("name"))
    joined = proposed.join(nations.select(F.lower("n_name").alias("key"), F.col("n_name").alias("found"), "n_nationkey"), F.lower("name") == F.col("key"))
    best = F.row_number().over(Window.partitionBy("c_custkey").orderBy((F.col("name") != F.col("found")).cast("int"), "n_nationkey"))
    return joined.withColumn("nth", best).where("nth = 1").groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum((F.col("name") == F.col("found")).cast("int")).alias("exact"))


def q_differential_control(spark, sf_dir):
    """Users whose purchases exceed in the treatment half (even ids) but not in the control half of their events."""
    events = read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    halves = events.groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("treatment"), F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("control"))
    return halves.where("treatment > 500 and coalesce(control, 0) <= 500").select("user_id", "treatment", "control")


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_EDGES = """e0 AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS dst FROM lineitem),
edges AS (SELECT DISTINCT src, dst FROM e0 WHERE dst IS NOT NULL AND src <> dst)"""


def _reach(hops: int) -> str:
    return f"""WITH RECURSIVE {_EDGES},
reach(start, node, hop) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_nationkey = 0
  UNION SELECT r.start, e.dst, r.hop + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.hop < {hops}),
best AS (SELECT start, node, min(hop) AS hop FROM reach GROUP BY ALL)"""


_SLICES = _reach(2) + """, slices AS (SELECT start, count(*) AS n, count(DISTINCT s_nationkey) AS nations, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS balance FROM best JOIN supplier ON s_suppkey = node GROUP BY start)"""
_RETURNED = "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'"
ORACLE = {
    "unguarded_writes": f"SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_order FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN ({_RETURNED}) GROUP BY 1",
    "guarded_semi": f"SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_order FROM orders WHERE o_totalprice > 200000 AND o_orderkey IN ({_RETURNED}) GROUP BY 1",
    "checked_not_written": """WITH p AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag <> 'R') AS k FROM lineitem GROUP BY 1)
SELECT CASE WHEN k THEN 'never_returned' ELSE 'only_returned' END AS kind, l_partkey FROM p WHERE r <> k""",
    "left_lookup": "SELECT coalesce(c_mktsegment, 'info') AS segment, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1",
    "flow_write_groups": """WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS s, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderstatus, flags, count(*) AS orders, sum(s) AS suppliers, max(n) AS most_lines FROM orders JOIN g ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "token_kind_lookup": """SELECT kind, l_returnflag, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity FROM lineitem LEFT JOIN
(SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'steel|brass|copper|tin|nickel') THEN 'metal' WHEN regexp_matches(lower(p_name), 'large|small|medium|economy') THEN 'sized' ELSE 'unknown' END AS kind FROM part) ON p_partkey = l_partkey GROUP BY 1, 2""",
    "related_pairs": """SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
AND substring(lower(a.p_name), 1, 4) = substring(lower(b.p_name), 1, 4) WHERE a.p_type <> b.p_type""",
    "race_edges": """WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS words FROM conversations),
n AS (SELECT *, lead(role) OVER w AS next_role, lead(words) OVER w AS next_words FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT role, next_role, count(*) AS n, sum(CAST(list_has_any(words, next_words) AS INT)) AS sharing FROM n WHERE role <> next_role GROUP BY 1, 2""",
    "first_then_later": """WITH f AS (SELECT conv_id, min(turn) AS first_at FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, f.first_at, min(c.turn) AS later_at FROM conversations c JOIN f ON f.conv_id = c.conv_id AND c.turn > f.first_at WHERE c.role = 'user' GROUP BY 1, 2""",
    "conditional_having": """SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY user_id
HAVING (bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error')) OR count(DISTINCT event_type) >= 5""",
    "edge_existence": """SELECT max(CAST(event_type = 'view' AS INT)) AS has_view, max(CAST(event_type = 'error' AS INT)) AS has_error, max(CAST(event_type = 'refund' AS INT)) AS has_refund,
max(CAST(event_type = 'purchase' AND value > 0 AS INT)) AS paid, count(*) FILTER (WHERE value IS NULL) AS no_value FROM events""",
    "next_start": """SELECT user_id, event_id, ordinal, next_id FROM (SELECT *, row_number() OVER w AS ordinal, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'signup'""",
    "session_gaps": """WITH g AS (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, sum(fresh) AS sessions, count(*) AS n FROM g GROUP BY 1""",
    "inheritance_argmax": """WITH c AS (SELECT p_brand, p_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT p_brand, arg_max(p_partkey, (n, -p_partkey)) AS best, max(n) AS n FROM c GROUP BY 1""",
    "reachability_5hop": _reach(5) + " SELECT start, count(*) AS n, max(hop) AS deepest FROM best GROUP BY start",
    "slice_aggregate": _SLICES + " SELECT * FROM slices",
    "attack_paths": _SLICES + """ SELECT start, CASE WHEN balance < 0 THEN 'insolvent' WHEN nations > 20 THEN 'wide' ELSE 'narrow' END AS family, CASE WHEN balance < 0 THEN 0 WHEN nations > 20 THEN 1 ELSE 2 END AS family_rank
FROM slices ORDER BY family_rank, start LIMIT 20""",
    "actor_model": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, array_to_string(list_slice(list_sort(list(DISTINCT conv_id)), 1, 4), ',') AS evidence FROM conversations GROUP BY role",
    "grounding_lookup": """WITH p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name ELSE n_name || '?' END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT n_nationkey, count(*) AS n, sum(CAST(name = n_name AS INT)) AS exact FROM p JOIN nation ON lower(name) = lower(n_name) GROUP BY 1""",
    "differential_control": """SELECT * FROM (SELECT user_id, sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_id % 2 = 0) AS treatment, sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_id % 2 = 1) AS control FROM events GROUP BY 1)
WHERE treatment > 500 AND coalesce(control, 0) <= 500""",
}
