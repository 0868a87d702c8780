"""The call graph of contracts: reachable slices, their proof, attack paths, races of transactions and gaps.

Facts come from ``codefacts``. A slice is what an entry point reaches in a few calls; all slices are searched at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import has_any
from lodeline.operators import codefacts as C
from lodeline.operators.relate import reachable
from lodeline.plans.shared import join_shuffled, materialise

HOPS = 5
#: Entries of a kind among a slice's evidence, in order, and the most entries.
QUOTAS = (("entry", 1), ("flow", 2), ("write", 2), ("edge", 2), ("boundary", 1), ("auth", 1))
MOST_EVIDENCE, MOST_PATHS, MOST_TEXT = 8, 20, 1600
#: Families of attack paths: family, type, what has to be proved.
FAMILIES = (
    ("custody/accounting consistency", "custody_accounting_consistency", "Prove asset owner/custodian and accounting beneficiary cannot diverge along the graph path."),
    ("lifecycle monotonicity and transition gating", "lifecycle_transition_gating", "Prove lifecycle transitions are authorized, monotonic, and cannot be repeated out of order."),
    ("external-call/accounting ordering", "external_call_before_accounting", "Prove external control flow cannot observe or exploit stale accounting."),
)
#: Terms of order state, market context and roles.
ORDER_STATE = ("order", "price", "amount", "deadline", "active", "cancel", "amend", "buy", "fill")
MARKET = ("order", "market", "seller", "buyer", "price", "fill", "bid", "ask", "auction", "trade")
BUYING, SELLING, CHANGING = ("buy", "fill", "match"), ("sell", "amend", "cancel", "order"), ("amend", "update", "edit", "cancel")
DEPOSITING, REPORTING = ("deposit", "redeem", "withdraw", "claim"), ("report", "oracle", "price")
PRICE_BOUNDS, AMOUNT_BOUNDS = ("maxprice", "max_price", "limitprice", "limit_price"), ("minreceive", "min_receive", "minamount", "min_amount")
LESSONS = (
    (("market", "order", "price", "seller", "buyer", "mempool", "deadline"), "Mutable order terms require slippage or min/max bound reasoning."),
    (("token", "safeerc20", "callback", "reentrancy", "external", "cei"), "CEI-safe SafeERC20 reentrancy candidates need a concrete secondary target before promotion."),
    (("deadline", "expiry", "expired", "active", "cleanup", "lifecycle"), "Expired-but-active lifecycle state requires liveness and cleanup checks."),
)
NODE = ["repo", "node"]


def _node(contract: str = "contract_name", function: str = "function_name") -> Column:
    return F.concat_ws(".", contract, function)


def functions_of(own: C.Facts) -> DataFrame:
    """Functions with their node."""
    return own.functions.withColumn("node", _node())


def successors(fns: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, src, dst: member calls to known functions, and calls within a contract."""
    nodes = fns.select("repo", F.col("node").alias("dst")).distinct()
    member = edges.where("function_name is not null").select("repo", _node().alias("src"), _node("to_contract", "to_function").alias("dst"))
    inner = fns.select("repo", F.col("node").alias("src"), "contract_name", F.explode("calls").alias("callee")).select("repo", "src", F.concat_ws(".", "contract_name", "callee").alias("dst")).where("src != dst")
    return join_shuffled(member.unionByName(inner), nodes, ["repo", "dst"], "left_semi").select("repo", "src", "dst").distinct()


def slices(own: C.Facts, fns: DataFrame, hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """(repo, entry, node): what each public or external function reaches, itself included; and the successors."""
    steps = materialise(successors(fns, own.edges), "successors")
    name = lambda c: F.concat(F.col("repo"), F.lit("\t"), F.col(c))
    found = reachable(steps.select(name("src").alias("src"), name("dst").alias("dst")), fns.where(F.col("visibility").isin("public", "external")).select(name("node").alias("node")), hops)
    part = lambda c, i: F.split_part(c, F.lit("\t"), F.lit(i))
    return materialise(found.select(part(F.col("start"), 1).alias("repo"), part(F.col("start"), 2).alias("entry"), part(F.col("node"), 2).alias("node")), "slices"), steps


def slice_facts(own: C.Facts, fns: DataFrame, reach: DataFrame, steps: DataFrame) -> DataFrame:
    """repo, entry, kind, detail, file_path, line_no, text: every fact of every function of a slice."""
    def of(df: DataFrame, kind, detail: str) -> DataFrame:
        return df.where("function_name is not null").select("repo", _node().alias("node"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), F.col(detail).cast("string").alias("detail"), "file_path", "line_no", F.col("code").alias("text"))

    places = fns.select("repo", "node", "file_path", "start_line")
    inner = join_shuffled(steps, places.withColumnRenamed("node", "src"), ["repo", "src"]).where(F.split_part("src", F.lit("."), F.lit(1)) == F.split_part("dst", F.lit("."), F.lit(1)))
    facts = (
        of(own.storage, F.col("access"), "variable_name")
        .unionByName(of(own.flows, F.when(F.lower("expression").contains("safe"), "safe flow").otherwise("flow"), "asset"))
        .unionByName(of(own.edges, "edge", "to_function"))
        .unionByName(of(own.auth, "auth", "role"))
        .unionByName(of(own.lifecycle.withColumn("v", F.array_join("variables", ",")), "lifecycle", "v"))
        .unionByName(of(own.boundaries, "boundary", "boundary_kind"))
        .unionByName(inner.select("repo", F.col("src").alias("node"), F.lit("edge").alias("kind"), F.split_part("dst", F.lit("."), F.lit(2)).alias("detail"), "file_path", F.col("start_line").alias("line_no"), F.concat("src", F.lit(" -> "), "dst").alias("text")))
    )
    return join_shuffled(reach, facts, NODE).select("repo", "entry", "kind", "detail", "file_path", "line_no", "text")


def graph_slices(own: C.Facts, fns: DataFrame, reach: DataFrame, facts: DataFrame) -> DataFrame:
    """A row a slice: counts of its facts, written variables, proof status, what is missing and what speaks against."""
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    counted = facts.groupBy("repo", "entry").agg(
        n("write").alias("writes"), n("read").alias("reads"), n("flow", "safe flow").alias("flows"), n("safe flow").alias("safe_flows"), n("edge").alias("edges"), n("auth").alias("auth"),
        n("lifecycle").alias("lifecycle"), n("boundary").alias("boundaries"), F.count(F.when((F.col("kind") == "boundary") & (F.col("detail") != "oracle_read"), 1)).alias("control"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "write", F.col("detail")))).alias("written"),
    )
    sized = reach.groupBy("repo", "entry").agg(F.count("*").alias("functions"))
    entries = fns.select("repo", F.col("node").alias("entry"), "file_path", "start_line", "modifiers")
    found = join_shuffled(join_shuffled(sized, entries, ["repo", "entry"]), counted, ["repo", "entry"], "left")
    found = found.select("repo", "entry", "file_path", "start_line", "modifiers", "functions", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("writes", "reads", "flows", "safe_flows", "edges", "auth", "lifecycle", "boundaries", "control")), F.coalesce("written", F.array().cast("array<string>")).alias("written"))
    both, guarded = (F.col("flows") > 0) & (F.col("writes") > 0), (F.col("auth") > 0) | (F.size("modifiers") > 0)
    against = F.array_compact(F.array(F.when(guarded, F.lit("auth constraint or modifier")), F.when(F.col("safe_flows") > 0, F.lit("safe token transfer helper"))))
    meagre = ~both & (F.col("writes") + F.col("flows") + F.col("control") == 0)
    status = F.when(both & (F.size("against") == 0), "strong_local_path").when(both, "missing_counterevidence").when(meagre, "rejected_by_counterevidence").otherwise("setup_required")
    missing = F.when(meagre, F.array(F.lit("no meaningful facts"))).otherwise(
        F.array_compact(F.array(F.when(~both, F.lit("asset flow and accounting write")), F.when((F.col("control") > 0) & (F.col("writes") > 0), F.lit("ordering proof")), F.when((F.col("lifecycle") > 0) & ~guarded, F.lit("transition authorization"))))
    )
    return found.withColumn("against", against).withColumn("proof_status", status).withColumn("missing", missing)


def attack_paths(found: DataFrame) -> DataFrame:
    """path (by order of entry points), repo, entry, family, confidence: the first MOST_PATHS slices of a family in each repository."""
    family = F.when((F.col("flows") > 0) & (F.col("writes") > 0), 0).when((F.col("lifecycle") > 0) & (F.col("auth") == 0), 1).when((F.col("boundaries") > 0) & (F.col("writes") > 0), 2)
    path = F.row_number().over(Window.partitionBy("repo").orderBy("file_path", "start_line", "entry"))
    of = found.withColumn("nth", family).where("nth is not null").withColumn("path", path).where(F.col("path") <= MOST_PATHS)
    confidence = F.when(F.col("nth") == 0, F.when(F.col("proof_status") == "strong_local_path", 0.74).otherwise(0.60)).when(F.col("nth") == 1, 0.62).otherwise(0.64)
    names = F.array(*(F.lit(f[0]) for f in FAMILIES))
    return of.select("path", "repo", "entry", F.get(names, "nth").alias("family"), "nth", "proof_status", confidence.alias("confidence"), "written")


def slice_evidence(fns: DataFrame, facts: DataFrame) -> DataFrame:
    """repo, entry, nth, kind, file_path, line_no: the entry point, then facts by QUOTAS; a line and text once, MOST_EVIDENCE in all."""
    rank = F.create_map(*(F.lit(x) for i, (k, _) in enumerate(QUOTAS) for x in (k, i)))
    quota = F.create_map(*(F.lit(x) for k, q in QUOTAS for x in (k, q)))
    entries = fns.where(F.col("visibility").isin("public", "external")).select("repo", F.col("node").alias("entry"), F.lit("entry").alias("kind"), F.lit("").alias("detail"), "file_path", F.col("start_line").alias("line_no"), F.col("signature").alias("text"))
    rows = facts.withColumn("kind", F.when(F.col("kind") == "safe flow", "flow").otherwise(F.col("kind"))).where(F.col("kind").isin(*(k for k, _ in QUOTAS))).unionByName(entries)
    within = F.row_number().over(Window.partitionBy("repo", "entry", "kind").orderBy("file_path", "line_no", "detail", "text"))
    chosen = rows.withColumn("within", within).where(F.col("within") <= quota[F.col("kind")]).withColumn("place", rank[F.col("kind")] * 10 + F.col("within"))
    once = chosen.groupBy("repo", "entry", "file_path", "line_no", "text").agg(F.min(F.struct("place", "kind")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("repo", "entry").orderBy("first.place"))
    return once.select("repo", "entry", nth.alias("nth"), F.col("first.kind").alias("kind"), "file_path", "line_no").where(F.col("nth") <= MOST_EVIDENCE)


def actions(fns: DataFrame, flows: DataFrame) -> DataFrame:
    """Public and external functions as a user's actions: role, state read and changed, bounds that are missing, and a sentence."""
    body, name = F.substring("signature", 1, MOST_TEXT), F.lower("function_name")
    about = F.lower(F.concat_ws(" ", "function_name", "signature"))
    role = F.when(has_any(about, BUYING), "buyer").when(has_any(about, SELLING), "seller").when(has_any(about, ("owner", "admin")), "owner").otherwise("unknown")
    state = F.lower(F.concat_ws(" ", "function_name", F.array_join("reads", " "), F.array_join("writes", " ")))
    text = F.lower(body)
    bounds = F.array_compact(F.array(F.when(state.contains("price") & ~has_any(text, PRICE_BOUNDS), F.lit("max price bound")), F.when(state.contains("amount") & ~has_any(text, AMOUNT_BOUNDS), F.lit("minimum received amount"))))
    moving = flows.where("function_name is not null").groupBy("repo", _node().alias("node")).agg(F.count("*").alias("effects"))
    found = join_shuffled(fns.where(F.col("visibility").isin("public", "external")), moving, NODE, "left")
    said = F.array_compact(
        F.array(
            F.when(F.size("reads") > 0, F.concat(F.lit("reads "), F.array_join(F.slice("reads", 1, 4), ", "))),
            F.when(F.size("writes") > 0, F.concat(F.lit("updates "), F.array_join(F.slice("writes", 1, 4), ", "))),
            F.when(F.col("effects") > 0, F.lit("moves assets")),
        )
    )
    found = found.select("repo", "node", "contract_name", "function_name", "file_path", "start_line", role.alias("role"), "reads", "writes", F.coalesce("effects", F.lit(0)).alias("effects"), body.alias("body"), F.when(has_any(name, BUYING), bounds).otherwise(F.array().cast("array<string>")).alias("missing_bounds"), said.alias("said"))
    tail = F.when(F.size("said") > 0, F.array_join("said", "; ")).otherwise(F.lit("has no tracked state or asset effect"))
    return found.withColumn("sentence", F.concat(F.lit("`"), "function_name", F.lit("` is callable by a likely "), "role", F.lit(" and "), tail, F.lit("."))).drop("said")


def races(acts: DataFrame) -> DataFrame:
    """repo, victim, mutator, edge_type, shared, confidence: buying actions and those that change order state before them."""
    order_state = lambda xs: F.filter(xs, lambda x: has_any(F.lower(x), ORDER_STATE))
    name = F.lower("function_name")
    buys = acts.where(has_any(name, BUYING)).select("repo", F.col("node").alias("victim"), F.array_distinct(order_state(F.col("reads"))).alias("state"), "missing_bounds")
    changes = acts.where(has_any(name, CHANGING)).withColumn("touched", F.concat("writes", "reads")).where(F.exists("touched", lambda x: has_any(F.lower(x), ORDER_STATE)))
    changes = changes.select("repo", F.col("node").alias("mutator"), "touched", name.contains("cancel").alias("cancels"))
    both = F.array_intersect("state", "touched")
    pairs = join_shuffled(buys, changes, "repo").withColumn("shared", F.array_sort(F.when(F.size(both) > 0, both).otherwise(F.col("state")))).where(F.size("shared") > 0)
    return pairs.select("repo", "victim", "mutator", F.when(F.col("cancels"), "can_cancel_before").otherwise("can_mutate_before").alias("edge_type"), "shared", F.when(F.size("missing_bounds") > 0, 0.86).otherwise(0.68).alias("confidence"))


def assumptions(acts: DataFrame) -> DataFrame:
    """repo, node, state, missing: mutable state that a buyer trusts unbound, and orders that only their seller recovers."""
    state = F.array_distinct(F.filter("reads", lambda x: has_any(F.lower(x), ORDER_STATE)))
    buys = acts.withColumn("state", state).where((F.size("missing_bounds") > 0) & (F.size("state") > 0)).select("repo", "node", F.array_join("state", ",").alias("state"), F.array_join("missing_bounds", ",").alias("missing"))
    first = F.row_number().over(Window.partitionBy("repo").orderBy((F.lower("function_name") != "cancelsellorder").cast("int"), "file_path", "start_line"))
    low = F.lower("body")
    cancels = acts.where(F.lower("function_name").contains("cancel")).withColumn("nth", first).where("nth = 1").where(F.exists("reads", lambda x: F.lower(x).contains("deadline")) & low.contains("seller") & low.contains("msg.sender"))
    return buys.unionByName(cancels.select("repo", "node", F.lit("deadlineTimestamp,isActive,seller").alias("state"), F.lit("expired order recovery by non-seller").alias("missing")))


def gaps(acts: DataFrame, raced: DataFrame, assumed: DataFrame) -> DataFrame:
    """repo, agent, gap_type, subject, confidence, status of five hunters: market, numerical, lifecycle, flow and trust."""
    low = F.lower("body")
    state = F.lower(F.concat_ws(" ", "function_name", F.array_join("reads", " "), F.array_join("writes", " "), "body"))
    of_repo = Window.partitionBy("repo")
    deadline = F.max(F.exists(F.concat("reads", "writes"), lambda x: F.lower(x).contains("deadline"))).over(of_repo)
    cleanup = F.max(has_any(F.lower("function_name"), ("expire", "cleanup", "sweep"))).over(of_repo)
    seen = acts.withColumn("deadline", deadline).withColumn("cleanup", cleanup).withColumn("state", state)

    def row(condition: Column, agent: str, kind: str, confidence: float, status: str) -> Column:
        return F.when(condition, F.struct(F.lit(agent).alias("agent"), F.lit(kind).alias("gap_type"), F.lit(confidence).alias("confidence"), F.lit(status).alias("status")))

    name = F.lower("function_name")
    found = F.array_compact(
        F.array(
            row(F.col("body").rlike(r"(?i)\bfee\b|\bprice\b|precision|bps|percent") & F.col("body").contains("*") & F.col("body").contains("/"), "numerical", "integer_rounding", 0.78, "likely"),
            row((F.col("state").contains("deadline") | F.col("deadline")) & F.col("state").contains("seller") & name.contains("cancel") & ~F.col("cleanup"), "lifecycle", "expired_assets_seller_only_recovery", 0.78, "likely"),
            row(F.col("state").contains("deadline") & F.col("state").contains("active") & has_any(name, ("buy", "fill")), "lifecycle", "expired_state_remains_active", 0.74, "likely"),
            row(low.contains("safetransfer") & F.replace(low, F.lit(" "), F.lit("")).contains("isactive=false"), "flow", "cei_safe_external_transfer", 0.2, "rejected"),
        )
    )
    single = seen.select("repo", F.col("node").alias("subject"), F.explode(found).alias("g")).select("repo", "g.agent", "g.gap_type", "subject", "g.confidence", "g.status")
    market = raced.select("repo", F.lit("market").alias("agent"), F.col("edge_type").alias("gap_type"), F.concat("mutator", F.lit(">"), "victim").alias("subject"), "confidence", F.when(F.col("confidence") >= 0.8, "likely").otherwise("needs_manual_review").alias("status"))
    trust = assumed.where(~F.lower("missing").rlike("min|max")).select("repo", F.lit("trust").alias("agent"), F.lit("mutable_state_assumption").alias("gap_type"), F.col("node").alias("subject"), F.lit(0.7).alias("confidence"), F.lit("needs_manual_review").alias("status"))
    return single.unionByName(market).unionByName(trust)


def actors(fns: DataFrame) -> DataFrame:
    """repo, role, n: functions that speak for a role; owner and external_token always stand."""
    about = F.lower(F.concat_ws(" ", "contract_name", "function_name", "signature"))
    market = (sum((about.contains(t).cast("int") for t in MARKET), F.lit(0)) >= 2) | (about.contains("sell") & about.contains("price"))
    roles = F.array_compact(
        F.array(
            F.when(market & has_any(about, ("seller", "sell", "amend", "cancel")), F.lit("seller")),
            F.when(market & has_any(about, ("buyer", *BUYING)), F.lit("buyer")),
            F.when(about.contains("owner"), F.lit("owner")),
            F.when(has_any(about, DEPOSITING), F.lit("unknown")),
            F.when(has_any(about, REPORTING), F.lit("keeper")),
        )
    )
    named = fns.select("repo", F.explode(roles).alias("role"), "node")
    vaults = named.where("role = 'unknown'").select("repo").distinct().withColumn("vault", F.lit(True))
    kept = named.join(vaults, "repo", "left").where("role != 'keeper' or vault").groupBy("repo", "role").agg(F.count("*").alias("n"))
    standing = fns.select("repo").distinct().select("repo", F.explode(F.array(F.lit("owner"), F.lit("external_token"))).alias("role"))
    return kept.join(standing, ["repo", "role"], "full").select("repo", "role", F.coalesce("n", F.lit(0)).alias("n"))


def packets(acts: DataFrame, assumed: DataFrame, raced: DataFrame) -> DataFrame:
    """repo, pass_type, subject, text: an action told plainly, questions to an assumption, a race told from the adversary's side."""
    told = acts.select("repo", F.lit("feynman").alias("pass_type"), F.col("node").alias("subject"), F.col("sentence").alias("text"))
    asked = assumed.select("repo", F.lit("socratic").alias("pass_type"), F.col("node").alias("subject"), F.concat(F.lit("Can "), "state", F.lit(" change before this executes?")).alias("text"))
    turned = raced.select("repo", F.lit("inversion").alias("pass_type"), F.concat("mutator", F.lit(">"), "victim").alias("subject"), F.concat(F.lit("Change "), F.array_join(F.slice("shared", 1, 4), ", "), F.lit(" first")).alias("text"))
    return told.unionByName(asked).unionByName(turned)


def lessons(fns: DataFrame) -> DataFrame:
    """repo, lesson, n_terms: lessons of which the repository's words name two terms or more."""
    words = fns.select("repo", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "contract_name", "function_name", "signature")), F.lit(r"[a-z_][a-z0-9_]{2,}"), F.lit(0))).alias("term"))
    wanted = fns.sparkSession.createDataFrame([(t, text) for terms, text in LESSONS for t in terms], "term string, lesson string")
    return words.join(F.broadcast(wanted), "term").groupBy("repo", "lesson").agg(F.countDistinct("term").alias("n_terms")).where("n_terms >= 2")


def _graph(spark: SparkSession, sf_dir: str, own: C.Facts | None = None):
    own = own or C.facts(spark, sf_dir)
    fns = functions_of(own)
    reach, steps = slices(own, fns)
    return own, fns, reach, steps, materialise(slice_facts(own, fns, reach, steps), "slice-facts")


def _acts(spark: SparkSession, sf_dir: str, own: C.Facts | None = None):
    own = own or C.facts(spark, sf_dir)
    fns = functions_of(own)
    acts = materialise(actions(fns, own.flows), "actions")
    return fns, acts, races(acts), assumptions(acts)


def q_call_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.facts(spark, sf_dir)
    return successors(functions_of(own), own.edges)


def q_entry_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.facts(spark, sf_dir)
    return slices(own, functions_of(own))[0]


def q_graph_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, fns, reach, _, facts = _graph(spark, sf_dir)
    found = graph_slices(own, fns, reach, facts)
    return found.select("repo", "entry", "functions", "writes", "reads", "flows", "edges", "auth", "lifecycle", "boundaries", *(F.array_join(c, "|").alias(c) for c in ("written", "against", "missing")), "proof_status")


def q_slice_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fns, _, _, facts = _graph(spark, sf_dir)
    return slice_evidence(fns, facts)


def q_slice_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, fns, reach, _, facts = _graph(spark, sf_dir)
    return attack_paths(graph_slices(own, fns, reach, facts)).select("path", "repo", "entry", "family", "proof_status", "confidence")


def q_path_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attack path as an invariant to prove; a path without evidence in its slice is dropped."""
    own, fns, reach, _, facts = _graph(spark, sf_dir)
    paths = attack_paths(graph_slices(own, fns, reach, facts)).join(slice_evidence(fns, facts).select("repo", "entry").distinct(), ["repo", "entry"], "left_semi")
    kinds, proofs = (F.array(*(F.lit(f[i]) for f in FAMILIES)) for i in (1, 2))
    return paths.select("path", "repo", "entry", F.get(kinds, "nth").alias("invariant_type"), F.get(proofs, "nth").alias("required_proof"), "confidence", F.array_join("written", ",").alias("state"))


def q_user_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acts(spark, sf_dir)[1].select("repo", "node", "role", "effects", F.array_join("missing_bounds", ",").alias("missing_bounds"), "sentence")


def q_order_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acts(spark, sf_dir)[2].select("repo", "victim", "mutator", "edge_type", F.array_join("shared", ",").alias("shared"), "confidence")


def q_code_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, acts, raced, assumed = _acts(spark, sf_dir)
    return gaps(acts, raced, assumed)


def q_code_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actors(functions_of(C.facts(spark, sf_dir)))


def q_reasoning_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, acts, raced, assumed = _acts(spark, sf_dir)
    return packets(acts, assumed, raced)


def q_memory_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons(functions_of(C.facts(spark, sf_dir)))


def q_fact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fact table by repository."""
    own = C.facts(spark, sf_dir)
    tables = {"functions": own.functions, "state_variables": own.variables, "call_edges": own.edges, "storage_accesses": own.storage, "asset_flows": own.flows, "auth_constraints": own.auth, "lifecycle_transitions": own.lifecycle, "trust_boundaries": own.boundaries}
    counts = None
    for name, table in tables.items():
        one = table.groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.lit(name).alias("fact"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


QUERIES = {
    "call_successors": q_call_successors,
    "entry_reach": q_entry_reach,
    "graph_slices": q_graph_slices,
    "slice_evidence": q_slice_evidence,
    "slice_paths": q_slice_paths,
    "path_invariants": q_path_invariants,
    "user_actions": q_user_actions,
    "order_races": q_order_races,
    "code_gaps": q_code_gaps,
    "code_actors": q_code_actors,
    "reasoning_packets": q_reasoning_packets,
    "memory_lessons": q_memory_lessons,
    "fact_summary": q_fact_summary,
}

_any, _list = C._any, C._list
_STEPS = f"""{C.FUNCTIONS_SQL},
nodes AS (SELECT *, contract_name || '.' || function_name AS node FROM fn),
steps AS (
  SELECT repo, src, dst FROM (
    SELECT repo, contract_name || '.' || function_name AS src, to_contract || '.' || to_function AS dst FROM edges WHERE function_name IS NOT NULL
    UNION SELECT repo, node, contract_name || '.' || unnest(calls) FROM nodes)
  WHERE (repo, dst) IN (SELECT repo, node FROM nodes) AND (src <> dst OR (src, dst) IN (SELECT contract_name || '.' || function_name, to_contract || '.' || to_function FROM edges)))"""
_SLICES = _STEPS.replace("WITH ", "", 1) + f""",
walk(repo, entry, node, hop) AS (
  SELECT repo, node, node, 0 FROM nodes WHERE visibility IN ('public', 'external')
  UNION SELECT w.repo, w.entry, s.dst, w.hop + 1 FROM walk w JOIN steps s ON s.repo = w.repo AND s.src = w.node WHERE w.hop < {HOPS}),
reach AS (SELECT DISTINCT repo, entry, node FROM walk)"""
_FACTS = _SLICES + """,
allfacts AS (
  SELECT f.repo, f.node, f.kind, f.detail, f.file_path, f.line_no, s.code AS text FROM (
    SELECT repo, file_path, line_no, contract_name || '.' || function_name AS node, access AS kind, variable_name AS detail FROM storage
    UNION ALL SELECT repo, file_path, line_no, contract_name || '.' || function_name, CASE WHEN contains(lower(expression), 'safe') THEN 'safe flow' ELSE 'flow' END, asset FROM flows
    UNION ALL SELECT repo, file_path, line_no, contract_name || '.' || function_name, 'edge', to_function FROM edges
    UNION ALL SELECT repo, file_path, line_no, contract_name || '.' || function_name, 'auth', role FROM auth
    UNION ALL SELECT repo, file_path, line_no, contract_name || '.' || function_name, 'lifecycle', variables FROM lifecycle
    UNION ALL SELECT repo, file_path, line_no, contract_name || '.' || function_name, 'boundary', boundary_kind FROM boundaries) f
  JOIN stmt s ON s.repo = f.repo AND s.file_path = f.file_path AND s.line_no = f.line_no WHERE f.node IS NOT NULL
  UNION ALL
  SELECT s.repo, s.src, 'edge', split_part(s.dst, '.', 2), n.file_path, n.start_line, s.src || ' -> ' || s.dst FROM steps s JOIN nodes n ON n.repo = s.repo AND n.node = s.src WHERE split_part(s.src, '.', 1) = split_part(s.dst, '.', 1)),
sfacts AS (SELECT r.repo, r.entry, f.kind, f.detail, f.file_path, f.line_no, f.text FROM reach r JOIN allfacts f ON f.repo = r.repo AND f.node = r.node),
counted AS (
  SELECT repo, entry, count(*) FILTER (WHERE kind = 'write') AS writes, count(*) FILTER (WHERE kind = 'read') AS reads, count(*) FILTER (WHERE kind IN ('flow', 'safe flow')) AS flows,
         count(*) FILTER (WHERE kind = 'safe flow') AS safe_flows, count(*) FILTER (WHERE kind = 'edge') AS edges, count(*) FILTER (WHERE kind = 'auth') AS auth, count(*) FILTER (WHERE kind = 'lifecycle') AS lifecycle,
         count(*) FILTER (WHERE kind = 'boundary') AS boundaries, count(*) FILTER (WHERE kind = 'boundary' AND detail <> 'oracle_read') AS control,
         array_to_string(list_sort(list(DISTINCT detail) FILTER (WHERE kind = 'write')), '|') AS written FROM sfacts GROUP BY ALL),
base AS (
  SELECT n.repo, n.node AS entry, n.file_path, n.start_line, len(n.modifiers) AS mods, (SELECT count(*) FROM reach r WHERE r.repo = n.repo AND r.entry = n.node) AS functions,
         coalesce(c.writes, 0) AS writes, coalesce(c.reads, 0) AS reads, coalesce(flows, 0) AS flows, coalesce(safe_flows, 0) AS safe_flows, coalesce(edges, 0) AS edges, coalesce(auth, 0) AS auth, coalesce(lifecycle, 0) AS lifecycle,
         coalesce(boundaries, 0) AS boundaries, coalesce(control, 0) AS control, coalesce(written, '') AS written
  FROM nodes n LEFT JOIN counted c ON c.repo = n.repo AND c.entry = n.node WHERE n.visibility IN ('public', 'external')),
sl AS (
  SELECT *, flows > 0 AND writes > 0 AS paired, auth > 0 OR mods > 0 AS guarded, concat_ws('|', CASE WHEN auth > 0 OR mods > 0 THEN 'auth constraint or modifier' END, CASE WHEN safe_flows > 0 THEN 'safe token transfer helper' END) AS against,
         CASE WHEN flows > 0 AND writes > 0 THEN CASE WHEN auth = 0 AND mods = 0 AND safe_flows = 0 THEN 'strong_local_path' ELSE 'missing_counterevidence' END
              WHEN writes + flows + control > 0 THEN 'setup_required' ELSE 'rejected_by_counterevidence' END AS proof_status FROM base),
paths AS (
  SELECT * FROM (SELECT row_number() OVER (PARTITION BY repo ORDER BY file_path, start_line, entry) AS path, * FROM (
    SELECT *, CASE WHEN paired THEN 0 WHEN lifecycle > 0 AND auth = 0 THEN 1 WHEN boundaries > 0 AND writes > 0 THEN 2 END AS nth FROM sl) WHERE nth IS NOT NULL) WHERE path <= """ + str(MOST_PATHS) + """),
scored AS (SELECT *, CASE nth WHEN 0 THEN CASE WHEN proof_status = 'strong_local_path' THEN 0.74 ELSE 0.60 END WHEN 1 THEN 0.62 ELSE 0.64 END AS confidence FROM paths)"""
_ACTS = C.FUNCTIONS_SQL + f""",
nodes AS (SELECT *, contract_name || '.' || function_name AS node, left(full_sig, {MOST_TEXT}) AS body FROM fn),
acts0 AS (
  SELECT n.*, lower(function_name || ' ' || full_sig) AS about, lower(function_name || ' ' || array_to_string(reads, ' ') || ' ' || array_to_string(writes, ' ')) AS state, lower(body) AS low, lower(function_name) AS name,
         (SELECT count(*) FROM flows f WHERE f.repo = n.repo AND f.contract_name || '.' || f.function_name = n.node) AS effects FROM nodes n WHERE visibility IN ('public', 'external')),
acts AS (
  SELECT *, CASE WHEN {_any("about", BUYING)} THEN 'buyer' WHEN {_any("about", SELLING)} THEN 'seller' WHEN contains(about, 'owner') OR contains(about, 'admin') THEN 'owner' ELSE 'unknown' END AS role,
         CASE WHEN {_any("name", BUYING)} THEN concat_ws(',', CASE WHEN contains(state, 'price') AND NOT {_any("low", PRICE_BOUNDS)} THEN 'max price bound' END, CASE WHEN contains(state, 'amount') AND NOT {_any("low", AMOUNT_BOUNDS)} THEN 'minimum received amount' END) ELSE '' END AS missing_bounds,
         list_filter(reads, lambda x: {_any("lower(x)", ORDER_STATE)}) AS order_state, list_filter(list_concat(writes, reads), lambda x: {_any("lower(x)", ORDER_STATE)}) AS order_touched,
         concat_ws('; ', CASE WHEN len(reads) > 0 THEN 'reads ' || array_to_string(reads[1:4], ', ') END, CASE WHEN len(writes) > 0 THEN 'updates ' || array_to_string(writes[1:4], ', ') END, CASE WHEN effects > 0 THEN 'moves assets' END) AS said FROM acts0),
told AS (SELECT *, '`' || function_name || '` is callable by a likely ' || role || ' and ' || CASE WHEN said = '' THEN 'has no tracked state or asset effect' ELSE said END || '.' AS sentence FROM acts),
races AS (
  SELECT repo, victim, mutator, edge_type, list_sort(CASE WHEN len(shared) > 0 THEN shared ELSE state END) AS shared, confidence FROM (
    SELECT b.repo, b.node AS victim, m.node AS mutator, CASE WHEN contains(m.name, 'cancel') THEN 'can_cancel_before' ELSE 'can_mutate_before' END AS edge_type, list_intersect(b.order_state, list_concat(m.writes, m.reads)) AS shared, b.order_state AS state,
           CASE WHEN b.missing_bounds <> '' THEN 0.86 ELSE 0.68 END AS confidence
    FROM acts b JOIN acts m ON b.repo = m.repo WHERE {_any("b.name", BUYING)} AND {_any("m.name", CHANGING)} AND len(m.order_touched) > 0) WHERE len(state) > 0),
assumed AS (
  SELECT repo, node, array_to_string(order_state, ',') AS state, missing_bounds AS missing FROM acts WHERE missing_bounds <> '' AND len(order_state) > 0
  UNION ALL
  SELECT repo, node, 'deadlineTimestamp,isActive,seller', 'expired order recovery by non-seller' FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY name <> 'cancelsellorder', file_path, start_line) AS nth FROM acts WHERE contains(name, 'cancel'))
  WHERE nth = 1 AND len(list_filter(reads, lambda x: contains(lower(x), 'deadline'))) > 0 AND contains(low, 'seller') AND contains(low, 'msg.sender'))"""
_R = "WITH RECURSIVE "
ORACLE = {
    "call_successors": f"WITH {_STEPS} SELECT * FROM steps",
    "entry_reach": f"{_R}{_SLICES} SELECT * FROM reach",
    "graph_slices": f"""{_R}{_FACTS} SELECT repo, entry, functions, writes, reads, flows, edges, auth, lifecycle, boundaries, written, against, proof_status,
CASE WHEN proof_status = 'rejected_by_counterevidence' THEN 'no meaningful facts' ELSE concat_ws('|', CASE WHEN NOT paired THEN 'asset flow and accounting write' END, CASE WHEN control > 0 AND writes > 0 THEN 'ordering proof' END, CASE WHEN lifecycle > 0 AND NOT guarded THEN 'transition authorization' END) END AS missing FROM sl""",
    "slice_evidence": f"""{_R}{_FACTS},
q(kind, quota, rank) AS (VALUES {", ".join(f"('{k}', {n}, {i})" for i, (k, n) in enumerate(QUOTAS))}),
rows_ AS (SELECT repo, entry, CASE WHEN kind = 'safe flow' THEN 'flow' ELSE kind END AS kind, detail, file_path, line_no, text FROM sfacts
      UNION ALL SELECT repo, node, 'entry', '', file_path, start_line, full_sig FROM nodes WHERE visibility IN ('public', 'external')),
k AS (SELECT rows_.*, rank, row_number() OVER (PARTITION BY repo, entry, kind ORDER BY file_path, line_no, detail NULLS FIRST, text) AS within, quota FROM rows_ JOIN q USING (kind)),
o AS (SELECT repo, entry, file_path, line_no, text, min(rank * 10 + within) AS place, arg_min(kind, rank * 10 + within) AS kind FROM k WHERE within <= quota GROUP BY ALL)
SELECT repo, entry, nth, kind, file_path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY repo, entry ORDER BY place) AS nth FROM o) WHERE nth <= {MOST_EVIDENCE}""",
    "slice_paths": f"""{_R}{_FACTS} SELECT path, repo, entry, CASE nth {" ".join(f"WHEN {i} THEN {C.sample.quoted(f[0])}" for i, f in enumerate(FAMILIES))} END AS family, proof_status, confidence FROM scored""",
    "path_invariants": f"""{_R}{_FACTS} SELECT path, repo, entry, CASE nth {" ".join(f"WHEN {i} THEN {C.sample.quoted(f[1])}" for i, f in enumerate(FAMILIES))} END AS invariant_type,
CASE nth {" ".join(f"WHEN {i} THEN {C.sample.quoted(f[2])}" for i, f in enumerate(FAMILIES))} END AS required_proof, confidence, replace(written, '|', ',') AS state FROM scored""",
    "user_actions": f"WITH {_ACTS} SELECT repo, node, role, effects, missing_bounds, sentence FROM told",
    "order_races": f"WITH {_ACTS} SELECT repo, victim, mutator, edge_type, array_to_string(shared, ',') AS shared, confidence FROM races",
    "code_gaps": f"""WITH {_ACTS},
s AS (SELECT *, state || ' ' || low AS seen, bool_or(len(list_filter(list_concat(reads, writes), lambda x: contains(lower(x), 'deadline'))) > 0) OVER (PARTITION BY repo) AS deadline, bool_or({_any("name", ("expire", "cleanup", "sweep"))}) OVER (PARTITION BY repo) AS cleanup FROM acts)
SELECT repo, 'numerical' AS agent, 'integer_rounding' AS gap_type, node AS subject, 0.78 AS confidence, 'likely' AS status FROM s WHERE regexp_matches(low, '\\bfee\\b|\\bprice\\b|precision|bps|percent') AND contains(body, '*') AND contains(body, '/')
UNION ALL SELECT repo, 'lifecycle', 'expired_assets_seller_only_recovery', node, 0.78, 'likely' FROM s WHERE (contains(seen, 'deadline') OR deadline) AND contains(seen, 'seller') AND contains(name, 'cancel') AND NOT cleanup
UNION ALL SELECT repo, 'lifecycle', 'expired_state_remains_active', node, 0.74, 'likely' FROM s WHERE contains(seen, 'deadline') AND contains(seen, 'active') AND (contains(name, 'buy') OR contains(name, 'fill'))
UNION ALL SELECT repo, 'flow', 'cei_safe_external_transfer', node, 0.2, 'rejected' FROM s WHERE contains(low, 'safetransfer') AND contains(replace(low, ' ', ''), 'isactive=false')
UNION ALL SELECT repo, 'market', edge_type, mutator || '>' || victim, confidence, CASE WHEN confidence >= 0.8 THEN 'likely' ELSE 'needs_manual_review' END FROM races
UNION ALL SELECT repo, 'trust', 'mutable_state_assumption', node, 0.7, 'needs_manual_review' FROM assumed WHERE NOT regexp_matches(lower(missing), 'min|max')""",
    "code_actors": f"""WITH {C.FUNCTIONS_SQL},
a AS (SELECT repo, lower(contract_name || ' ' || function_name || ' ' || full_sig) AS about FROM fn),
m AS (SELECT *, ({" + ".join(f"CAST(contains(about, '{t}') AS INT)" for t in MARKET)}) >= 2 OR (contains(about, 'sell') AND contains(about, 'price')) AS market FROM a),
roled AS (SELECT repo, unnest(list_filter([CASE WHEN market AND {_any("about", ("seller", "sell", "amend", "cancel"))} THEN 'seller' END, CASE WHEN market AND {_any("about", ("buyer", *BUYING))} THEN 'buyer' END,
        CASE WHEN contains(about, 'owner') THEN 'owner' END, CASE WHEN {_any("about", DEPOSITING)} THEN 'unknown' END, CASE WHEN {_any("about", REPORTING)} THEN 'keeper' END], lambda x: x IS NOT NULL)) AS role FROM m),
k AS (SELECT repo, role, count(*) AS n FROM roled WHERE role <> 'keeper' OR repo IN (SELECT repo FROM roled WHERE role = 'unknown') GROUP BY ALL),
s AS (SELECT DISTINCT repo, role FROM fn CROSS JOIN (VALUES ('owner'), ('external_token')) t(role))
SELECT coalesce(k.repo, s.repo) AS repo, coalesce(k.role, s.role) AS role, coalesce(n, 0) AS n FROM k FULL JOIN s ON k.repo = s.repo AND k.role = s.role""",
    "reasoning_packets": f"""WITH {_ACTS} SELECT repo, 'feynman' AS pass_type, node AS subject, sentence AS text FROM told
UNION ALL SELECT repo, 'socratic', node, 'Can ' || state || ' change before this executes?' FROM assumed
UNION ALL SELECT repo, 'inversion', mutator || '>' || victim, 'Change ' || array_to_string(shared[1:4], ', ') || ' first' FROM races""",
    "memory_lessons": f"""WITH {C.FUNCTIONS_SQL},
terms AS (SELECT DISTINCT repo, unnest(regexp_extract_all(lower(contract_name || ' ' || function_name || ' ' || full_sig), '[a-z_][a-z0-9_]{{2,}}')) AS term FROM fn)
SELECT repo, lesson, count(*) AS n_terms FROM terms JOIN {C.sample.values_sql([(t, text) for terms, text in LESSONS for t in terms], "term, lesson")} USING (term) GROUP BY ALL HAVING count(*) >= 2""",
    "fact_summary": f"""WITH {C.FUNCTIONS_SQL}
{" UNION ALL ".join(f"SELECT repo, '{name}' AS fact, count(*) AS n FROM {cte} GROUP BY repo" for name, cte in (("functions", "fn"), ("state_variables", "vars"), ("call_edges", "edges"), ("storage_accesses", "storage"), ("asset_flows", "flows"), ("auth_constraints", "auth"), ("lifecycle_transitions", "lifecycle"), ("trust_boundaries", "boundaries")))}""",
}
ORACLE |= {name: C.sample.doubles(ORACLE[name], *columns) for name, columns in {"slice_paths": ("confidence",), "path_invariants": ("confidence",), "order_races": ("confidence",), "code_gaps": ("confidence",)}.items()}
