"""Hypotheses: construction from detections, invariants and gaps, rank and merge, gates on evidence and proof.

A hypothesis has id, title, vulnerability_class, functions, files, evidence (file_path, line, message), sources,
proof_status, confidence, status and counterevidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import has_any, source_type
from lodeline.operators import codefacts as C
from lodeline.operators import detect as D
from lodeline.operators import slices as G
from lodeline.plans.shared import join_shuffled
from lodeline.sources import lines as L
from lodeline.sources import sample
from lodeline.sources.sample import quoted, values_sql

MOST_HYPOTHESES = 40
#: Score of a proof status.
PROOF = {"static_proof_complete": 1.0, "strong_local_path": 0.85, "missing_counterevidence": 0.55, "setup_required": 0.35, "rejected_by_counterevidence": 0.0}
#: Messages that are no evidence, and phrases that block a finding.
WEAK = ("Source term overlaps repo-profile intent", "suspicious protocol invariant pattern: ///", "suspicious protocol invariant pattern: //")
BLOCKING = ("low to none", "no concrete secondary target", "cei-safe", "safeerc20-only", "missing concrete", "blocking counterevidence", "no unprivileged impact")
UNPROVEN_CONFIDENCE, LEAD_CONFIDENCE = 0.85, 0.45
#: Severity of a class; info without.
SEVERITY = {
    "transaction_ordering": "high", "missing_access_control": "high", "tx_origin_authorization": "high", "dangerous_delegatecall": "high", "reentrancy": "high", "external_call_before_accounting": "high",
    "strategy_accounting_trust": "medium", "unchecked_transfer": "medium", "unchecked_erc20_return": "medium", "weak_randomness": "medium", "vault_accounting_spoof": "medium",
    "oracle_staleness_logic": "medium", "unsafe_or_guard": "medium", "unguarded_initializer": "medium", "accounting_invariant": "medium", "business_logic": "medium",
}
#: Class of a type of invariant; business_logic without.
INVARIANT_CLASS = {
    "custody_accounting_consistency": "accounting_invariant", "authorization_to_state_write_consistency": "missing_access_control", "randomness_unpredictability": "weak_randomness",
    "signature_threshold_uniqueness": "access_control", "checkpoint_boundary_mismatch": "accounting_invariant", "multi_report_fee_accrual": "accounting_invariant",
    "fee_formula_dimension_mismatch": "accounting_invariant", "pending_redeem_fee_base_exclusion": "accounting_invariant", "native_asset_receive_mismatch": "asset_flow",
    "indexed_structure_key_mismatch": "accounting_invariant", "percentage_distribution_math": "accounting_invariant", "upgrade_authorization_without_upgrade": "upgradeability",
    "storage_layout_mismatch": "storage_layout", "unbounded_loop_dos": "denial_of_service", "external_state_accounting_trust": "accounting_invariant",
}
CHECKLIST_CLASS = {"access_control": "missing_access_control", "accounting": "accounting_invariant", "weak_randomness": "weak_randomness", "oracle_staleness_logic": "oracle_staleness_logic"}
#: Class of a kind of gap.
GAP_CLASS = {"integer_rounding": "accounting_invariant", "can_cancel_before": "transaction_ordering", "can_mutate_before": "transaction_ordering"}
#: Modifiers and terms of an access guard, and names of functions that need one.
GUARD_MODIFIERS = ("onlyowner", "onlyrole", "onlygovernance", "onlyadmin", "onlykeeper", "onlyguardian", "onlyauthorized", "requiresauth", "authorized", "restricted")
GUARD_TERMS = ("require(msg.sender", "_checkowner", "_checkrole", "hasrole(", "msg.sender == owner", "msg.sender==owner", "onlyowner", "accesscontrol")
SENSITIVE_NAMES, VALUE_CALLS = ("emergency", "sweep", "drain"), (".transfer(", ".call(", ".call{", ".send(")
#: Class of an outside tool's check, by its name or a beginning of it, in this order.
TOOL_CLASS = (
    ("reentrancy", "reentrancy"), ("reentrancy-benign", "reentrancy"), ("reentrancy-eth", "reentrancy"), ("reentrancy-no-eth", "reentrancy"), ("reentrancy-unlimited-gas", "reentrancy"),
    ("unchecked-lowlevel", "unchecked_transfer"), ("unchecked-send", "unchecked_transfer"), ("unchecked-transfer", "unchecked_transfer"),
    ("arbitrary-send", "missing_access_control"), ("arbitrary-send-erc20", "missing_access_control"), ("arbitrary-send-erc20-permit", "missing_access_control"), ("suicidal", "missing_access_control"),
)

COLUMNS = "id string, title string, vulnerability_class string, functions array<string>, files array<string>, evidence array<struct<file_path:string,line:int,message:string>>, sources array<string>, proof_status string, confidence double, status string, counterevidence array<string>"
#: Rows for the registered queries: id, title, class, functions, files, evidence, sources, proof status, confidence, status, counterevidence; lists with |.
ROWS = (
    (1, "Stale price", "oracle_staleness_logic", "read", "src/A.sol", "src/A.sol;12;no check of updatedAt", "static.oracle", "static_proof_complete", 0.92, "confirmed", ""),
    (2, "Stale  PRICE", "oracle_staleness_logic", "peek|read", "src/B.sol", "src/B.sol;3;same", "static.oracle", "setup_required", 0.6, "likely", ""),
    (3, "Drain", "missing_access_control", "sweep", "src/A.sol", "src/A.sol;40;open sweep|src/A.sol;41;sends", "semantic.guard", "strong_local_path", 0.9, "confirmed", ""),
    (4, "Order race", "transaction_ordering", "buy|amend|cancel|fill", "src/M.sol", "test/M.t.sol;4;test only", "gap-market-1|market_gap_agent", "strong_local_path", 0.86, "likely", ""),
    (5, "CEI", "business_logic", "buy", "src/M.sol", "src/M.sol;9;safe transfer", "gap-flow-1", "rejected_by_counterevidence", 0.2, "likely", "CEI-safe: marked inactive first"),
    (6, "Config", "business_logic", "", "src/C.sol", "src/C.sol;2;set, never read", "configured_but_not_enforced-1", "setup_required", 0.7, "likely", ""),
    (7, "Proved", "reentrancy", "withdraw", "src/V.sol", "src/V.sol;7;call first", "llm_proposer:1", "executed_poc_confirmed", 0.97, "needs_manual_review", ""),
    (8, "Lead", "business_logic", "deposit", "src/V.sol", "src/V.sol;1;Source term overlaps repo-profile intent: i1", "repo-profile:i1", "setup_required", 0.48, "needs_manual_review", ""),
    (9, "Comment", "accounting_invariant", "fee", "src/F.sol", "src/F.sol;5;suspicious protocol invariant pattern: /// fee", "inv-fee-1", "missing_counterevidence", 0.8, "likely", ""),
    (10, "No place", "business_logic", "x", "src/X.sol", "", "static.x", "setup_required", 0.5, "likely", ""),
    (11, "Drain", "missing_access_control", "sweepAll", "src/D.sol", "src/D.sol;8;open", "static.guard", "setup_required", 0.72, "likely", ""),
    (12, "Proved but safe", "reentrancy", "exit", "src/V.sol", "src/V.sol;19;call", "invariant_reasoner:2", "executed_poc_confirmed", 0.99, "likely", "no unprivileged impact"),
)
_ROW_COLUMNS = "n, title, vulnerability_class, functions, files, evidence, sources, proof_status, confidence, status, counterevidence"


def rows(spark: SparkSession) -> DataFrame:
    """ROWS as hypotheses."""
    table = spark.createDataFrame([(f"hyp-{r[0]}", *r[1:]) for r in ROWS], "id string, title string, vulnerability_class string, functions string, files string, evidence string, sources string, proof_status string, confidence double, status string, counterevidence string")
    listed = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    at = lambda x, i: F.split_part(x, F.lit(";"), F.lit(i))
    evidence = F.transform(listed("evidence"), lambda x: F.struct(at(x, 1).alias("file_path"), at(x, 2).cast("int").alias("line"), at(x, 3).alias("message")))
    return table.select("id", "title", "vulnerability_class", listed("functions").alias("functions"), listed("files").alias("files"), evidence.alias("evidence"), listed("sources").alias("sources"), "proof_status", "confidence", "status", listed("counterevidence").alias("counterevidence"))


def _lookup(column: Column, values: dict, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[column], F.lit(default))


def rank_key() -> Column:
    """The order of hypotheses, greatest first: meaning of the source, proof, evidence, functions, confidence."""
    text = F.lower(F.array_join("sources", " "))
    semantic = F.when(text.contains("semantic.") | F.exists("sources", lambda x: x.startswith("semantic-")), 1.0).otherwise(0.0)
    penalty = F.when(text.contains("configured_but_not_enforced") & (F.size("functions") == 0), -1.0).otherwise(0.0)
    return F.struct(
        (semantic + penalty).alias("meaning"), _lookup(F.col("proof_status"), PROOF, 0.35).alias("proof"), (F.least(F.size("evidence"), F.lit(6)) / 6).alias("shown"),
        (F.least(F.size(F.array_distinct("functions")), F.lit(3)) / 3).alias("across"), F.col("confidence").alias("confidence"),
    )


def merged(hypotheses: DataFrame, most: int = MOST_HYPOTHESES) -> DataFrame:
    """Hypotheses in rank order, one for each class and title, with the functions and files of all; the first ``most``.

    Ties are broken by id. Only groups of one class and title are gathered.
    """
    titled = hypotheses.withColumn("key", rank_key()).withColumn("subject", F.array_join(F.filter(F.split(F.lower("title"), r"\s+"), lambda x: x != ""), " "))
    order = Window.partitionBy("vulnerability_class", "subject").orderBy(F.desc("key"), "id")
    ranked = titled.withColumn("nth", F.row_number().over(order))
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(c).alias("x")))), lambda s: s["x"]))).alias(c)
    groups = ranked.groupBy("vulnerability_class", "subject").agg(in_order("functions"), in_order("files"), F.count("*").alias("n_merged"))
    first = ranked.where("nth = 1").drop("functions", "files", "nth").join(groups, ["vulnerability_class", "subject"])
    top = first.orderBy(F.desc("key"), "id").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("key"), "id"))).drop("key", "subject")  # of at most ``most`` rows


def _is_primary(e: Column) -> Column:
    return (source_type(e["file_path"]) == "production") & (e["line"] > 0)


def gated(hypotheses: DataFrame) -> DataFrame:
    """Findings: id, title, severity, confidence, status and the gates that changed it.

    In order: hypotheses known only from a profile are leads; those without a place are dropped; confirmed and likely
    need executable production evidence; an executed proof confirms; confirmed needs a proof; counterevidence that
    blocks rejects. Confidence without an executed proof is capped.
    """
    profile = (F.size("sources") > 0) & F.forall("sources", lambda x: F.lower(x).startswith("repo-profile:"))
    message = lambda e: F.trim(e["message"])
    strong = F.exists("evidence", lambda e: _is_primary(e) & ~has_any(message(e), WEAK) & ~message(e).rlike(r"(:|: ///|: //)$"))
    placed = F.exists("evidence", lambda e: e["file_path"].isNotNull() & (e["line"] > 0))
    executed, proved = F.col("proof_status") == "executed_poc_confirmed", F.col("proof_status").isin("static_proof_complete", "executed_poc_confirmed")
    open_ = lambda c: F.col(c).isin("confirmed", "likely")
    blocked = has_any(F.lower(F.array_join("counterevidence", " ")), BLOCKING)
    found = hypotheses.where(profile | placed).withColumn("lead", profile)
    found = found.withColumn("s1", F.when(open_("status") & ~strong, "needs_manual_review").otherwise(F.col("status")))
    found = found.withColumn("s2", F.when(executed, "confirmed").otherwise(F.col("s1")))
    found = found.withColumn("s3", F.when((F.col("s2") == "confirmed") & ~proved, "likely").otherwise(F.col("s2")))
    found = found.withColumn("s4", F.when(open_("s3") & blocked, "rejected").otherwise(F.col("s3")))
    changed = F.array_compact(F.array(F.when(F.col("s1") != F.col("status"), "evidence"), F.when(F.col("s2") != F.col("s1"), "executed"), F.when(F.col("s3") != F.col("s2"), "proof"), F.when(F.col("s4") != F.col("s3"), "counterevidence")))
    confidence = F.when(F.col("lead"), F.least("confidence", F.lit(LEAD_CONFIDENCE))).when(executed, F.col("confidence")).otherwise(F.least("confidence", F.lit(UNPROVEN_CONFIDENCE)))
    limit = F.when(F.col("lead"), "profile lead").when(F.col("proof_status") == "static_proof_complete", "complete static proof").when(F.col("proof_status").isin("setup_required", "missing_counterevidence"), F.concat("proof_status", F.lit("; cannot be confirmed"))).otherwise(F.col("proof_status"))
    return found.select(
        F.regexp_replace("id", "hyp", F.when(F.col("lead"), "lead").otherwise("finding")).alias("id"), "title", "vulnerability_class",
        F.when(F.col("lead"), "info").otherwise(_lookup(F.col("vulnerability_class"), SEVERITY, "info")).alias("severity"), confidence.alias("confidence"),
        F.when(F.col("lead"), "lead").otherwise(F.col("s4")).alias("status"), F.when(F.col("lead"), F.array().cast("array<string>")).otherwise(changed).alias("gates"), limit.alias("limitation"),
    )


def origin(sources: Column) -> Column:
    """Who found it: an invariant reasoner, a proposer, a detector, or nobody known."""
    text = F.lower(F.array_join(sources, " "))
    return F.when(has_any(text, ("invariant_reasoner", "invariant_inferencer")), "invariant_reasoner").when(text.contains("llm_proposer"), "llm_proposer").when(F.size(sources) > 0, "detector").otherwise("other")


def invariant_class(kind: Column) -> Column:
    suffix = F.regexp_extract(kind, "^rag_checklist_(.*)$", 1)
    return F.when(kind.startswith("rag_checklist_"), _lookup(suffix, CHECKLIST_CLASS, "business_logic")).otherwise(_lookup(kind, INVARIANT_CLASS, "business_logic"))


def from_detections(found: DataFrame) -> DataFrame:
    """repo, source, vulnerability_class, subject, confidence, proof_status, status of detections."""
    return found.select("repo", F.concat(F.lit("static."), "detector").alias("source"), "vulnerability_class", F.split_part("functions", F.lit(","), F.lit(1)).alias("subject"), "confidence", F.when(F.col("confidence") >= 0.75, "static_proof_complete").otherwise("strong_local_path").alias("proof_status"), F.lit("suspicious").alias("status"))


def from_invariants(paths: DataFrame) -> DataFrame:
    """The same of invariants of attack paths."""
    status = F.when(F.col("proof_status") == "strong_local_path", "likely").otherwise("needs_manual_review")
    return paths.select("repo", F.concat(F.lit("inv-"), "invariant_type").alias("source"), invariant_class(F.col("invariant_type")).alias("vulnerability_class"), F.split_part("entry", F.lit("."), F.lit(2)).alias("subject"), "confidence", "proof_status", status.alias("status"))


def from_gaps(found: DataFrame) -> DataFrame:
    """The same of gaps."""
    proof = F.when(F.col("status") == "rejected", "rejected_by_counterevidence").when(F.col("status") == "likely", "strong_local_path").otherwise("setup_required")
    return found.select("repo", F.concat(F.lit("gap-"), "agent").alias("source"), _lookup(F.col("gap_type"), GAP_CLASS, "business_logic").alias("vulnerability_class"), F.col("subject").alias("subject"), "confidence", proof.alias("proof_status"), "status")


def or_manual_review(found: DataFrame, repos: DataFrame) -> DataFrame:
    """``found`` and, for each repository without any, one row that asks for a manual review."""
    missing = join_shuffled(repos, found.select("repo").distinct(), "repo", "left_anti")
    return found.unionByName(missing.select("repo", F.lit("default").alias("source"), F.lit("manual_review").alias("vulnerability_class"), F.lit("").alias("subject"), F.lit(0.2).alias("confidence"), F.lit("setup_required").alias("proof_status"), F.lit("needs_manual_review").alias("status")))


def missing_access_control(sources: DataFrame) -> DataFrame:
    """repo, file_path, function_name, line_no: functions of a sensitive name without a guard up to the next function.

    Only in repositories that send native value somewhere.
    """
    lines = L.to_lines(sources)
    ranges = L.function_ranges(sources).select(*C.FILE, "function_name", "start_line")
    upto = F.lead("start_line").over(Window.partitionBy(*C.FILE).orderBy("start_line"))
    names = ranges.withColumn("next_start", F.coalesce(upto, F.lit(1 << 30))).where(has_any(F.lower("function_name"), SENSITIVE_NAMES))
    sending = lines.where(has_any(F.col("raw"), VALUE_CALLS)).select("repo").distinct()
    low = F.lower("raw")
    guards = lines.where(has_any(low, GUARD_TERMS) | has_any(low, GUARD_MODIFIERS)).select(*C.FILE, "line_no", low.alias("low"))
    within = (F.col("g.line_no") >= F.col("n.start_line")) & (F.col("g.line_no") < F.col("n.next_start")) & (has_any(F.col("low"), GUARD_TERMS) | (F.col("g.line_no") == F.col("n.start_line")))
    open_ = names.alias("n").join(guards.alias("g"), (F.col("n.repo") == F.col("g.repo")) & (F.col("n.file_path") == F.col("g.file_path")) & within, "left_anti")
    return open_.join(sending, "repo", "left_semi").select("repo", "file_path", "function_name", F.col("start_line").alias("line_no"))


def tool_class(check: Column) -> Column:
    low = F.lower(check)
    exact = F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in TOOL_CLASS))
    return F.coalesce(exact, *(F.when(low.startswith(k), F.lit(v)) for k, v in TOOL_CLASS))


def tool_confidence(impact: Column, confidence: Column) -> Column:
    """0.6 and what impact and confidence of a tool add, 0.9 at most."""
    of = lambda c, high, medium: F.when(F.lower(c) == "high", high).when(F.lower(c) == "medium", medium).otherwise(0.0)
    return F.least(F.lit(0.6) + of(impact, 0.15, 0.08) + of(confidence, 0.1, 0.05), F.lit(0.9))


def semantic_validation(claims: DataFrame) -> DataFrame:
    """claim, validated, proof_status, counterevidence: (claim, kind, text) whose evidence text proves one of three kinds."""
    low = F.lower(F.coalesce("text", F.lit("")))
    unique = has_any(low, ("usedsigner", "seensigner", "duplicate", "unique"))
    signatures = low.contains("threshold") & low.contains(".length") & ~unique
    mixed = has_any(low, ("upper", "lower", "latest")) & has_any(low, ("<", ">"))
    units = sum((low.contains(t).cast("int") for t in ("d6", "1e6", "d18", "1e18", "share", "price")), F.lit(0))
    fees = low.contains("fee") & (units >= 3) & has_any(low, ("1e24", "1e18", "1e6"))
    known = claims.where(F.col("kind").isin("signature_threshold_uniqueness", "checkpoint_boundary_mismatch", "fee_formula_dimension_mismatch"))
    valid = F.when(F.col("kind") == "signature_threshold_uniqueness", signatures).when(F.col("kind") == "checkpoint_boundary_mismatch", mixed).otherwise(fees)
    return known.select("claim", "kind", valid.alias("validated"), F.when(valid, "static_proof_complete").otherwise("setup_required").alias("proof_status"), ((F.col("kind") == "signature_threshold_uniqueness") & unique).alias("counterevidence"))


#: claim, kind, text.
CLAIMS = (
    (1, "signature_threshold_uniqueness", "require(sigs.length >= threshold)"), (2, "signature_threshold_uniqueness", "require(sigs.length >= threshold); seenSigner[s] = true"),
    (3, "checkpoint_boundary_mismatch", "if (upper.timestamp > latest) return lower"), (4, "checkpoint_boundary_mismatch", "checkpoint = 1"),
    (5, "fee_formula_dimension_mismatch", "fee = priceD6 * shares / 1e18"), (6, "fee_formula_dimension_mismatch", "fee = a / b"), (7, "something_else", "threshold .length"), (8, "checkpoint_boundary_mismatch", None),
)
#: tool, check, impact, confidence.
CHECKS = ((1, "reentrancy-eth", "High", "Medium"), (2, "arbitrary-send-eth", "Medium", "High"), (3, "naming-convention", "Informational", "High"), (4, "Suicidal", "High", "High"), (5, "unchecked-send", None, None))
#: repo, file_path, text of functions that need guards.
ACCESS_SOURCES = (
    ("a", "src/A.sol", "contract A {\n  function sweep(address t) external {\n    t.call(\"\");\n  }\n  function drainAll() external onlyOwner {\n    x = 1;\n  }\n  function emergencyExit() external {\n    require(msg.sender == owner);\n  }\n}"),
    ("b", "src/B.sol", "contract B {\n  function sweep() external {\n    x = 1;\n  }\n}"),
)


def q_hypothesis_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark).select("id", *(F.round(rank_key()[c], 6).alias(c) for c in ("meaning", "proof", "shown", "across")), "confidence")


def q_hypothesis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(rows(spark)).select("place", "id", "vulnerability_class", F.array_join("functions", "|").alias("functions"), F.array_join("files", "|").alias("files"), "n_merged")


def q_finding_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(rows(spark)).withColumn("gates", F.array_join("gates", ","))


def q_report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the report's bucket and severity."""
    bucket = F.when(F.col("status").isin("confirmed", "likely"), "findings").when(F.col("status") == "lead", "leads").when(F.col("status") == "rejected", "rejected_hypotheses").when(F.col("status") == "suspicious", "suspicious_hypotheses").otherwise("needs_manual_review")
    return gated(rows(spark)).groupBy(bucket.alias("bucket"), "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def q_hypothesis_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("status") == "rejected", "candidate").when(F.col("status").isin("confirmed", "likely"), "delivered").otherwise("reviewed")
    found = rows(spark).withColumn("origin", origin(F.col("sources"))).withColumn("stage", stage)
    return found.select("id", "origin", "stage", F.col("origin").isin("llm_proposer", "invariant_reasoner").alias("novel"))


def q_code_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses of the linked sources from attack paths and gaps, and a manual review where there is none."""
    own, fns, reach, _, facts = G._graph(spark, sf_dir)
    kinds = F.array(*(F.lit(f[1]) for f in G.FAMILIES))
    paths = G.attack_paths(G.graph_slices(own, fns, reach, facts)).withColumn("invariant_type", F.get(kinds, "nth"))
    _, acts, raced, assumed = G._acts(spark, sf_dir, own)
    found = from_invariants(paths).unionByName(from_gaps(G.gaps(acts, raced, assumed)))
    return or_manual_review(found, own.sources.select("repo").distinct())


def q_detection_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_detections(D.detections(sample.repositories(spark, sf_dir, sample.LINKED_SOURCES)))


def q_missing_access_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_access_control(sample.repositories(spark, sf_dir, ACCESS_SOURCES + sample.LINKED_SOURCES))


def q_tool_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(CHECKS, "tool int, check string, impact string, confidence string")
    return table.select("tool", tool_class(F.col("check")).alias("vulnerability_class"), F.round(tool_confidence(F.col("impact"), F.col("confidence")), 6).alias("score")).where("vulnerability_class is not null")


def q_semantic_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_validation(spark.createDataFrame(CLAIMS, "claim int, kind string, text string"))


QUERIES = {
    "hypothesis_rank": q_hypothesis_rank,
    "hypothesis_merge": q_hypothesis_merge,
    "finding_gates": q_finding_gates,
    "report_buckets": q_report_buckets,
    "hypothesis_origin": q_hypothesis_origin,
    "code_hypotheses": q_code_hypotheses,
    "detection_hypotheses": q_detection_hypotheses,
    "missing_access_control": q_missing_access_control,
    "tool_findings": q_tool_findings,
    "semantic_validation": q_semantic_validation,
}


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {default} END"


_any = C._any
_ROWS_SQL = f"""h AS (
  SELECT 'hyp-' || n AS id, title, vulnerability_class, CASE WHEN functions = '' THEN [] ELSE string_split(functions, '|') END AS functions, string_split(files, '|') AS files,
         CASE WHEN evidence = '' THEN [] ELSE string_split(evidence, '|') END AS evidence, string_split(sources, '|') AS sources, proof_status, confidence, status, counterevidence
  FROM {values_sql(ROWS, _ROW_COLUMNS)}),
ranked AS (
  SELECT *, CASE WHEN contains(lower(array_to_string(sources, ' ')), 'semantic.') OR len(list_filter(sources, lambda x: starts_with(x, 'semantic-'))) > 0 THEN 1.0 ELSE 0.0 END
            - CASE WHEN contains(lower(array_to_string(sources, ' ')), 'configured_but_not_enforced') AND len(functions) = 0 THEN 1.0 ELSE 0.0 END AS meaning,
         {_case("proof_status", PROOF, "0.35")} AS proof, least(len(evidence), 6) / 6 AS shown, least(len(list_distinct(functions)), 3) / 3 AS across FROM h)"""
_GATED_SQL = f"""{_ROWS_SQL},
e AS (
  SELECT id, bool_or(NOT regexp_matches(path, '^(test|lib|script|docs)/') AND line > 0 AND NOT {_any("message", WEAK)} AND NOT regexp_matches(message, '(:|: ///|: //)$')) AS strong, bool_or(line > 0) AS placed
  FROM (SELECT id, split_part(x, ';', 1) AS path, CAST(split_part(x, ';', 2) AS INT) AS line, trim(split_part(x, ';', 3)) AS message FROM (SELECT id, unnest(evidence) AS x FROM h)) GROUP BY id),
g0 AS (SELECT h.*, coalesce(strong, false) AS strong, coalesce(placed, false) AS placed, len(list_filter(sources, lambda x: NOT starts_with(lower(x), 'repo-profile:'))) = 0 AS lead, {_any("lower(counterevidence)", BLOCKING)} AS blocked FROM h LEFT JOIN e USING (id)),
g1 AS (SELECT *, CASE WHEN status IN ('confirmed', 'likely') AND NOT strong THEN 'needs_manual_review' ELSE status END AS s1 FROM g0 WHERE lead OR placed),
g2 AS (SELECT *, CASE WHEN proof_status = 'executed_poc_confirmed' THEN 'confirmed' ELSE s1 END AS s2 FROM g1),
g3 AS (SELECT *, CASE WHEN s2 = 'confirmed' AND proof_status NOT IN ('static_proof_complete', 'executed_poc_confirmed') THEN 'likely' ELSE s2 END AS s3 FROM g2),
g4 AS (SELECT *, CASE WHEN s3 IN ('confirmed', 'likely') AND blocked THEN 'rejected' ELSE s3 END AS s4 FROM g3),
gated AS (
  SELECT replace(id, 'hyp', CASE WHEN lead THEN 'lead' ELSE 'finding' END) AS id, title, vulnerability_class, CASE WHEN lead THEN 'info' ELSE {_case("vulnerability_class", SEVERITY, "'info'")} END AS severity,
         CASE WHEN lead THEN least(confidence, {LEAD_CONFIDENCE}) WHEN proof_status = 'executed_poc_confirmed' THEN confidence ELSE least(confidence, {UNPROVEN_CONFIDENCE}) END AS confidence, CASE WHEN lead THEN 'lead' ELSE s4 END AS status,
         CASE WHEN lead THEN '' ELSE concat_ws(',', CASE WHEN s1 <> status THEN 'evidence' END, CASE WHEN s2 <> s1 THEN 'executed' END, CASE WHEN s3 <> s2 THEN 'proof' END, CASE WHEN s4 <> s3 THEN 'counterevidence' END) END AS gates,
         CASE WHEN lead THEN 'profile lead' WHEN proof_status = 'static_proof_complete' THEN 'complete static proof' WHEN proof_status IN ('setup_required', 'missing_counterevidence') THEN proof_status || '; cannot be confirmed' ELSE proof_status END AS limitation FROM g4)"""
_GAPS = G.ORACLE["code_gaps"]
ORACLE = {
    "hypothesis_rank": f"WITH {_ROWS_SQL} SELECT id, meaning, proof, shown, across, confidence FROM ranked",
    "hypothesis_merge": f"""WITH {_ROWS_SQL},
o AS (SELECT *, array_to_string(list_filter(string_split(lower(title), ' '), lambda x: x <> ''), ' ') AS subject FROM ranked),
r AS (SELECT *, row_number() OVER (PARTITION BY vulnerability_class, subject ORDER BY meaning DESC, proof DESC, shown DESC, across DESC, confidence DESC, id) AS nth FROM o),
f AS (SELECT vulnerability_class, subject, string_agg(x, '|' ORDER BY first) AS functions FROM (SELECT vulnerability_class, subject, x, min((nth, i)) AS first FROM (SELECT *, unnest(functions) AS x, unnest(range(len(functions))) AS i FROM r) GROUP BY ALL) GROUP BY ALL),
p AS (SELECT vulnerability_class, subject, string_agg(x, '|' ORDER BY first) AS files FROM (SELECT vulnerability_class, subject, x, min((nth, i)) AS first FROM (SELECT *, unnest(files) AS x, unnest(range(len(files))) AS i FROM r) GROUP BY ALL) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY meaning DESC, proof DESC, shown DESC, across DESC, confidence DESC, id) AS place, id, vulnerability_class, coalesce(f.functions, '') AS functions, coalesce(p.files, '') AS files, (SELECT count(*) FROM r x WHERE x.vulnerability_class = r.vulnerability_class AND x.subject = r.subject) AS n_merged
FROM r LEFT JOIN f USING (vulnerability_class, subject) LEFT JOIN p USING (vulnerability_class, subject) WHERE nth = 1 ORDER BY place LIMIT {MOST_HYPOTHESES}""",
    "finding_gates": f"WITH {_GATED_SQL} SELECT * FROM gated",
    "report_buckets": f"""WITH {_GATED_SQL} SELECT CASE WHEN status IN ('confirmed', 'likely') THEN 'findings' WHEN status = 'lead' THEN 'leads' WHEN status = 'rejected' THEN 'rejected_hypotheses' WHEN status = 'suspicious' THEN 'suspicious_hypotheses' ELSE 'needs_manual_review' END AS bucket,
severity, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM gated GROUP BY ALL""",
    "hypothesis_origin": f"""WITH {_ROWS_SQL},
o AS (SELECT id, CASE WHEN contains(lower(array_to_string(sources, ' ')), 'invariant_reasoner') THEN 'invariant_reasoner' WHEN contains(lower(array_to_string(sources, ' ')), 'llm_proposer') THEN 'llm_proposer' ELSE 'detector' END AS origin,
      CASE WHEN status = 'rejected' THEN 'candidate' WHEN status IN ('confirmed', 'likely') THEN 'delivered' ELSE 'reviewed' END AS stage FROM h)
SELECT *, origin <> 'detector' AS novel FROM o""",
    "code_hypotheses": f"""{G._R}{G._FACTS},
inv AS (SELECT repo, CASE nth {" ".join(f"WHEN {i} THEN {quoted(f[1])}" for i, f in enumerate(G.FAMILIES))} END AS kind, split_part(entry, '.', 2) AS subject, confidence, proof_status FROM scored),
found AS (
  SELECT repo, 'inv-' || kind AS source, {_case("kind", INVARIANT_CLASS, "'business_logic'")} AS vulnerability_class, subject, confidence, proof_status, CASE WHEN proof_status = 'strong_local_path' THEN 'likely' ELSE 'needs_manual_review' END AS status FROM inv
  UNION ALL
  SELECT repo, 'gap-' || agent, {_case("gap_type", GAP_CLASS, "'business_logic'")}, subject, confidence, CASE status WHEN 'rejected' THEN 'rejected_by_counterevidence' WHEN 'likely' THEN 'strong_local_path' ELSE 'setup_required' END, status
  FROM ({_GAPS}))
SELECT * FROM found UNION ALL SELECT DISTINCT repo, 'default', 'manual_review', '', 0.2, 'setup_required', 'needs_manual_review' FROM target WHERE repo NOT IN (SELECT repo FROM found)""",
    "detection_hypotheses": f"""WITH {D._FLAGS} SELECT repo, 'static.' || detector AS source, vulnerability_class, split_part(functions, ',', 1) AS subject, confidence, CASE WHEN confidence >= 0.75 THEN 'static_proof_complete' ELSE 'strong_local_path' END AS proof_status, 'suspicious' AS status FROM detected""",
    "missing_access_control": f"""WITH {sample.lines_sql(ACCESS_SOURCES + sample.LINKED_SOURCES)},
n AS (SELECT *, coalesce(lead(start_line) OVER (PARTITION BY repo, file_path ORDER BY start_line), 1000000000) AS next_start FROM ranges),
s AS (SELECT DISTINCT repo FROM lines WHERE {_any("raw", VALUE_CALLS)})
SELECT repo, file_path, function_name, start_line AS line_no FROM n WHERE {_any("lower(function_name)", SENSITIVE_NAMES)} AND repo IN (SELECT repo FROM s)
AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.repo = n.repo AND l.file_path = n.file_path AND l.line_no >= n.start_line AND l.line_no < n.next_start AND ({_any("lower(l.raw)", GUARD_TERMS)} OR (l.line_no = n.start_line AND {_any("lower(l.raw)", GUARD_MODIFIERS)})))""",
    "tool_findings": f"""SELECT tool, vulnerability_class, least(0.9, 0.6 + CASE lower(impact) WHEN 'high' THEN 0.15 WHEN 'medium' THEN 0.08 ELSE 0 END + CASE lower(confidence) WHEN 'high' THEN 0.1 WHEN 'medium' THEN 0.05 ELSE 0 END) AS score
FROM (SELECT *, CASE {" ".join(f"WHEN lower(t.check) = {quoted(k)} THEN {quoted(v)}" for k, v in TOOL_CLASS)} {" ".join(f"WHEN starts_with(lower(t.check), {quoted(k)}) THEN {quoted(v)}" for k, v in TOOL_CLASS)} END AS vulnerability_class FROM {values_sql(CHECKS, 'tool, "check", impact, confidence')}) WHERE vulnerability_class IS NOT NULL""",
    "semantic_validation": f"""SELECT claim, kind, v AS validated, CASE WHEN v THEN 'static_proof_complete' ELSE 'setup_required' END AS proof_status, kind = 'signature_threshold_uniqueness' AND u AS counterevidence FROM (
  SELECT *, CASE kind WHEN 'signature_threshold_uniqueness' THEN contains(low, 'threshold') AND contains(low, '.length') AND NOT u WHEN 'checkpoint_boundary_mismatch' THEN {_any("low", ("upper", "lower", "latest"))} AND {_any("low", ("<", ">"))}
            ELSE contains(low, 'fee') AND ({" + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in ("d6", "1e6", "d18", "1e18", "share", "price"))}) >= 3 AND {_any("low", ("1e24", "1e18", "1e6"))} END AS v
  FROM (SELECT *, lower(coalesce(text, '')) AS low, {_any("lower(coalesce(text, ''))", ("usedsigner", "seensigner", "duplicate", "unique"))} AS u FROM {values_sql(CLAIMS, "claim, kind, text")}
        WHERE kind IN ('signature_threshold_uniqueness', 'checkpoint_boundary_mismatch', 'fee_formula_dimension_mismatch')))""",
}
ORACLE |= {name: sample.doubles(ORACLE[name], *columns) for name, columns in {"hypothesis_rank": ("meaning", "proof", "shown", "across", "confidence",), "finding_gates": ("confidence",), "code_hypotheses": ("confidence",), "detection_hypotheses": ("confidence",), "tool_findings": ("score",)}.items()}
