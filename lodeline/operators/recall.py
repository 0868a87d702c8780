"""Recall of known findings by the candidates of a run: containment of names, keywords, mechanism, stage and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.operators.hypotheses import origin
from lodeline.sources.sample import quoted, values_sql

#: Buckets of a report in the order they are read, and the stage of each.
BUCKETS = ("findings", "leads", "needs_manual_review", "suspicious_hypotheses", "rejected_hypotheses")
STAGE = {"hypothesis": 0, "rejected_hypotheses": 0, "suspicious_hypotheses": 1, "needs_manual_review": 1, "leads": 1, "findings": 2}
STAGES = ("candidate", "reviewed", "delivered")
#: Groups of words of one mechanism, and words that name none.
MECHANISMS = (
    ("reentrancy", ("reentrancy", "reentrant", "callback", "hook")),
    ("access_control", ("access", "control", "authorization", "auth", "permission", "onlyowner", "privilege", "unauthorized", "role")),
    ("accounting", ("accounting", "fee", "share", "rounding", "inflation", "donation", "solvency", "debt", "interest", "yield", "redemption")),
    ("oracle", ("oracle", "price", "chainlink", "twap", "stale", "feed")),
    ("initialization", ("initialization", "initialize", "frontrun", "frontrunning", "uninitialized", "proxy")),
    ("dos", ("denial", "unbounded", "griefing")),
    ("slippage", ("slippage", "sandwich", "minamount", "deadline")),
    ("signature", ("signature", "replay", "permit", "ecrecover", "nonce")),
)
STOPWORDS = ("the", "and", "via", "with", "missing", "incorrect", "wrong", "bad", "issue", "bug", "invariant", "unknown", "error")

_ITEM = "struct<title:string,affected_functions:array<string>,affected_function:string,affected_files:array<string>,evidence_lines:array<struct<file_path:string>>,evidence:array<struct<file_path:string>>,evidence_summary:string,root_cause_terms:array<string>,exploit_precondition_terms:array<string>,vulnerability_class:string,proof_status:string,source_detection_ids:array<string>>"
TRACE_SCHEMA = f"hypotheses array<{_ITEM}>"
REPORT_SCHEMA = ", ".join(f"{b} array<{_ITEM}>" for b in BUCKETS)
TRUTH_SCHEMA = "contest string, findings array<struct<id:string,severity:string,title:string,file_contains:string,function:string,vulnerability_class:string,match_any:array<string>,mechanism_concepts:array<string>>>, low_findings array<struct<id:string,severity:string,title:string,file_contains:string,function:string,vulnerability_class:string,match_any:array<string>,mechanism_concepts:array<string>>>"


def ground_truth(table: DataFrame, include_low: bool = False) -> DataFrame:
    """A row a known finding of (value: JSON document), with or without the low ones."""
    d = table.select(F.from_json("value", TRUTH_SCHEMA).alias("d")).select("d.*")
    none = F.array().cast(d.schema["findings"].dataType)
    items = F.coalesce("findings", none)
    if include_low:
        items = F.concat(items, F.coalesce("low_findings", none))
    return d.select("contest", F.explode(items).alias("x")).select("contest", "x.*")


def candidates(traces: DataFrame, reports: DataFrame) -> DataFrame:
    """run, source, stage, functions, files, text, vulnerability_class, executed, origin: what a run put forward.

    ``traces`` and ``reports`` are (run, value: JSON): ranked hypotheses, and the buckets of the report.
    """
    trace = traces.select("run", F.lit("hypothesis").alias("source"), F.explode(F.from_json("value", TRACE_SCHEMA)["hypotheses"]).alias("x"))
    report = reports.select("run", F.from_json("value", REPORT_SCHEMA).alias("r"))
    buckets = F.map_from_arrays(F.array(*map(F.lit, BUCKETS)), F.array(*(F.col(f"r.{b}") for b in BUCKETS)))
    listed = report.select("run", F.explode(buckets).alias("source", "items")).select("run", "source", F.explode("items").alias("x"))
    rows = trace.unionByName(listed)
    none = F.array().cast("array<string>")
    strings = lambda c: F.coalesce(c, none)
    some = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    evidence = F.when(F.size(F.coalesce("x.evidence_lines", F.array().cast("array<struct<file_path:string>>"))) > 0, F.col("x.evidence_lines")).otherwise(F.col("x.evidence"))
    files = some(F.concat(strings(F.col("x.affected_files")), strings(F.transform(evidence, lambda e: e["file_path"]))))
    text = F.concat_ws(" ", F.coalesce("x.title", F.lit("")), F.coalesce("x.evidence_summary", F.lit("")), F.array_join(strings(F.col("x.root_cause_terms")), " "), F.array_join(strings(F.col("x.exploit_precondition_terms")), " "))
    stage = F.create_map(*(F.lit(v) for pair in STAGE.items() for v in pair))[F.col("source")]
    return rows.select(
        "run", "source", stage.alias("stage"), some(F.concat(strings(F.col("x.affected_functions")), F.array("x.affected_function"))).alias("functions"), files.alias("files"), text.alias("text"),
        F.coalesce("x.vulnerability_class", F.lit("")).alias("vulnerability_class"), (F.lower(F.coalesce("x.proof_status", F.lit(""))) == "executed_poc_confirmed").alias("executed"), origin(strings(F.col("x.source_detection_ids"))).alias("origin"),
    )


def tokens(name: Column) -> Column:
    """Words of four letters and more of a name that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(name)), "[^a-z0-9]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS)))


def mechanisms(words: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, members))), F.lit(group)) for group, members in MECHANISMS)))


def aligned(a: Column, b: Column) -> Column:
    """Whether two classes mean one mechanism: equal, a word in common, or a group in common."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    known = (x != "") & (y != "") & (x != "unknown") & (y != "unknown")
    return known & ((x == y) | F.arrays_overlap(tokens(a), tokens(b)) | F.arrays_overlap(mechanisms(tokens(a)), mechanisms(tokens(b))))


def matches(truth: DataFrame, found: DataFrame) -> DataFrame:
    """A row a known finding and run: touched, recalled, stage, keyword, executed, mechanism, novel.

    A candidate touches a finding if a function's name contains the other's and a file agrees, if it has any. Known
    findings are a curated list; they are the small side, and every candidate is compared with each.
    """
    low = lambda c: F.lower(F.trim(c))
    t = truth.select("id", "severity", low("function").alias("fn"), low(F.coalesce("file_contains", F.lit(""))).alias("file"), F.col("vulnerability_class").alias("truth_class"), "match_any", "mechanism_concepts")
    c = found.withColumn("body", low("text"))
    fn_ok = F.exists("functions", lambda f: F.contains(low(f), F.col("fn")) | F.contains(F.col("fn"), low(f)))
    file_ok = (F.col("file") == "") | (F.size("files") == 0) | F.exists("files", lambda f: F.contains(low(f), F.col("file")))
    pairs = c.join(F.broadcast(t), fn_ok & file_ok)
    keyword = F.get(F.filter("match_any", lambda k: (low(k) != "") & F.contains(F.col("body"), low(k))), F.lit(0))
    recalled = (F.coalesce(F.size("match_any"), F.lit(0)) <= 0) | keyword.isNotNull()
    concepts = F.filter(F.coalesce("mechanism_concepts", F.array().cast("array<string>")), lambda k: low(k) != "")
    mechanism = F.when(F.size(concepts) > 0, F.forall(concepts, lambda k: F.contains(F.col("body"), low(k)))).otherwise(aligned(F.col("vulnerability_class"), F.col("truth_class")))
    pairs = pairs.withColumn("keyword", keyword).withColumn("hit", recalled).withColumn("mechanism", mechanism)
    of = lambda x: F.max(F.when(F.col("hit"), x))
    grouped = pairs.groupBy("run", "id").agg(F.lit(True).alias("touched"), of(F.col("stage")).alias("stage"), of(F.col("executed")).alias("executed"), of(F.col("mechanism")).alias("mechanism"), F.collect_set(F.when(F.col("hit"), F.col("origin"))).alias("origins"), F.min(F.when(F.col("hit"), F.col("keyword"))).alias("keyword"))
    every = truth.select("id", "severity").join(found.select("run").distinct(), F.lit(True))  # a curated list times a run
    joined = every.join(grouped, ["run", "id"], "left")
    false = F.lit(False)
    recalled = F.col("stage").isNotNull()
    novel = recalled & F.coalesce(F.arrays_overlap("origins", F.array(F.lit("llm_proposer"), F.lit("invariant_reasoner"))), false) & ~F.coalesce(F.array_contains("origins", "detector"), false)
    names = F.array(*map(F.lit, STAGES))
    return joined.select("run", "id", "severity", F.coalesce("touched", false).alias("touched"), recalled.alias("recalled"), F.col("stage").alias("rank"), F.get(names, "stage").alias("stage"), "keyword", F.coalesce("executed", false).alias("executed"), F.coalesce("mechanism", false).alias("mechanism"), novel.alias("novel"))


def report(found: DataFrame) -> DataFrame:
    """run, severity (null: all) and the cumulative funnel: total, touched, recalled by stage, executed, mechanism, novel."""
    n = lambda c: F.count_if(c)
    rolled = found.rollup("run", "severity").agg(F.count("*").alias("total"), n(F.col("touched")).alias("touched"), *(n(F.col("rank") >= i).alias(s) for i, s in enumerate(STAGES)), n(F.col("executed")).alias("executed"), n(F.col("mechanism")).alias("mechanism"), n(F.col("novel")).alias("novel"))
    return rolled.where("run is not null").withColumn("recall", F.col("candidate") / F.col("total"))


def artifact_arities(artifacts: DataFrame, wanted: list[str]) -> DataFrame:
    """contract, function, arities: numbers of inputs of the functions in compiled artifacts (path, value: JSON)."""
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    a = artifacts.where(stem.isin(*wanted) & ~F.col("path").rlike(r"(^|/)build-info/")).select(stem.alias("contract"), F.explode(F.from_json("value", "abi array<struct<type:string,name:string,inputs:array<struct<type:string>>>>")["abi"]).alias("x"))
    kept = a.where("x.type = 'function' and x.name != ''").select("contract", F.col("x.name").alias("function"), F.coalesce(F.size("x.inputs"), F.lit(0)).alias("arity"))
    return kept.groupBy("contract", "function").agg(F.array_sort(F.collect_set(F.greatest("arity", F.lit(0)))).alias("arities"))


TRUTH = '{"contest": "demo", "findings": [{"id": "H1", "severity": "high", "title": "Reentrant withdraw", "file_contains": "Vault", "function": "withdraw", "vulnerability_class": "reentrancy", "match_any": ["external call", "callback"]}, {"id": "H2", "severity": "high", "title": "Stale price", "file_contains": "", "function": "getPrice", "vulnerability_class": "oracle", "match_any": [], "mechanism_concepts": ["stale", "timestamp"]}, {"id": "M1", "severity": "medium", "title": "Fee rounding", "file_contains": "Fees.sol", "function": "accrue", "vulnerability_class": "accounting", "match_any": ["round.*zero"]}, {"id": "M2", "severity": "medium", "title": "Replay", "file_contains": "Permit", "function": "permitAll", "vulnerability_class": "signature", "match_any": ["nonce"]}], "low_findings": [{"id": "L1", "severity": "low", "title": "Event", "file_contains": "", "function": "emitAll", "vulnerability_class": "unknown", "match_any": []}]}'
TRACE = '{"hypotheses": [{"title": "External call first", "affected_functions": ["withdrawAll"], "affected_files": ["src/Vault.sol"], "vulnerability_class": "callback_reentrancy", "source_detection_ids": ["llm_proposer:1"]}, {"title": "Rounds", "affected_functions": ["accrueFees"], "affected_files": ["src/Fees.sol"], "evidence_summary": "rounding to zero", "vulnerability_class": "accounting_invariant", "source_detection_ids": ["static.fees"]}, {"title": "No nonce", "affected_function": "permit", "evidence_lines": [{"file_path": "src/Other.sol"}], "vulnerability_class": "signature"}]}'
REPORT = '{"findings": [{"title": "Price may be stale: timestamp unchecked", "affected_functions": ["getprice"], "vulnerability_class": "other", "proof_status": "executed_poc_confirmed", "source_detection_ids": ["static.oracle"]}], "leads": [], "needs_manual_review": [{"title": "Reentrancy by callback", "affected_functions": ["withdraw"], "evidence": [{"file_path": "src/vault/Vault.sol"}], "vulnerability_class": "reentrancy", "source_detection_ids": ["invariant_reasoner"]}], "rejected_hypotheses": [{"title": "Event", "affected_functions": ["emit"], "vulnerability_class": "info"}]}'
ARTIFACTS = (
    ("out/Vault.sol/Vault.json", '{"abi": [{"type": "function", "name": "deposit", "inputs": [{"type": "uint256"}]}, {"type": "function", "name": "deposit", "inputs": [{"type": "uint256"}, {"type": "address"}]}, {"type": "event", "name": "Paid", "inputs": []}, {"type": "function", "name": "total"}]}'),
    ("out/build-info/Vault.json", '{"abi": [{"type": "function", "name": "hidden", "inputs": []}]}'),
    ("out/Other.sol/Other.json", '{"abi": [{"type": "function", "name": "other", "inputs": []}]}'),
)


def _values(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(1, v) for v in values], "run int, value string")


def _truth(spark: SparkSession) -> DataFrame:
    return ground_truth(_values(spark, TRUTH), include_low=True)


def q_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark).select("contest", "id", "severity", F.col("function").alias("fn"), F.array_join(F.coalesce("match_any", F.array().cast("array<string>")), "|").alias("match_any"))


def q_run_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(_values(spark, TRACE), _values(spark, REPORT))
    return found.select("source", "stage", F.array_join("functions", "|").alias("functions"), F.array_join("files", "|").alias("files"), "text", "vulnerability_class", "executed", "origin")


def q_recall_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(_truth(spark), candidates(_values(spark, TRACE), _values(spark, REPORT))).drop("rank")


def q_recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(matches(_truth(spark), candidates(_values(spark, TRACE), _values(spark, REPORT)))).withColumn("severity", F.coalesce("severity", F.lit("all")))


def q_artifact_arities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = artifact_arities(spark.createDataFrame(ARTIFACTS, "path string, value string"), ["Vault"])
    return found.select("contract", F.col("function").alias("fn"), F.array_join(F.transform("arities", lambda x: x.cast("string")), ",").alias("arities"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}


def _array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def _tokens(column: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(trim({column})), '[^a-z0-9]+'), lambda t: length(t) >= 4 AND t NOT IN ({', '.join(map(quoted, STOPWORDS))})))"


def _groups(words: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any({words}, {_array(m)}) THEN {quoted(g)} END" for g, m in MECHANISMS) + "], lambda x: x IS NOT NULL)"


_TRUTH_SQL = f"""truth AS (
  SELECT j->>'contest' AS contest, x->>'id' AS id, x->>'severity' AS severity, lower(x->>'function') AS fn, x->>'function' AS fn_raw, lower(x->>'file_contains') AS file, x->>'vulnerability_class' AS truth_class,
         coalesce(x->>'$.match_any[*]', []) AS match_any, coalesce(x->>'$.mechanism_concepts[*]', []) AS concepts
  FROM (SELECT j, unnest(list_concat(j->'$.findings[*]', j->'$.low_findings[*]')) AS x FROM (SELECT CAST({quoted(TRUTH)} AS JSON) AS j)))"""
_CANDIDATES_SQL = f"""items AS (
  SELECT 'hypothesis' AS source, unnest(j->'$.hypotheses[*]') AS x FROM (SELECT CAST({quoted(TRACE)} AS JSON) AS j)
  {" ".join(f"UNION ALL SELECT '{b}', unnest(j->'$.{b}[*]') FROM (SELECT CAST({quoted(REPORT)} AS JSON) AS j)" for b in BUCKETS)}),
cand AS (
  SELECT source, CASE source {" ".join(f"WHEN '{k}' THEN {v}" for k, v in STAGE.items())} END AS stage,
         list_filter(list_concat(coalesce(x->>'$.affected_functions[*]', []), [x->>'affected_function']), lambda f: f IS NOT NULL AND f <> '') AS functions,
         list_filter(list_concat(coalesce(x->>'$.affected_files[*]', []), coalesce(CASE WHEN len(x->>'$.evidence_lines[*].file_path') > 0 THEN x->>'$.evidence_lines[*].file_path' ELSE x->>'$.evidence[*].file_path' END, [])), lambda f: f IS NOT NULL AND f <> '') AS files,
         coalesce(x->>'title', '') || ' ' || coalesce(x->>'evidence_summary', '') || '  ' AS text, coalesce(x->>'vulnerability_class', '') AS vulnerability_class, coalesce(x->>'proof_status', '') = 'executed_poc_confirmed' AS executed,
         CASE WHEN contains(s, 'invariant_reasoner') THEN 'invariant_reasoner' WHEN contains(s, 'llm_proposer') THEN 'llm_proposer' WHEN s <> '' THEN 'detector' ELSE 'other' END AS origin
  FROM (SELECT *, lower(array_to_string(coalesce(x->>'$.source_detection_ids[*]', []), ' ')) AS s FROM items))"""
_MATCHES_SQL = f"""{_TRUTH_SQL}, {_CANDIDATES_SQL},
pairs AS (
  SELECT t.id, c.*, lower(trim(c.text)) AS body, t.match_any, t.concepts, t.truth_class, list_filter(t.match_any, lambda k: contains(lower(trim(c.text)), lower(k)))[1] AS keyword
  FROM truth t JOIN cand c ON len(list_filter(c.functions, lambda f: contains(lower(f), t.fn) OR contains(t.fn, lower(f)))) > 0 AND (t.file = '' OR len(c.files) = 0 OR len(list_filter(c.files, lambda f: contains(lower(f), t.file))) > 0)),
hits AS (
  SELECT *, len(match_any) = 0 OR keyword IS NOT NULL AS hit,
         CASE WHEN len(concepts) > 0 THEN len(list_filter(concepts, lambda k: NOT contains(body, lower(k)))) = 0
              ELSE vulnerability_class NOT IN ('', 'unknown') AND truth_class NOT IN ('', 'unknown') AND (lower(vulnerability_class) = lower(truth_class) OR list_has_any({_tokens("vulnerability_class")}, {_tokens("truth_class")})
                   OR list_has_any({_groups(_tokens("vulnerability_class"))}, {_groups(_tokens("truth_class"))})) END AS mechanism FROM pairs),
agg AS (SELECT id, max(stage) FILTER (WHERE hit) AS rank, bool_or(executed) FILTER (WHERE hit) AS executed, bool_or(mechanism) FILTER (WHERE hit) AS mechanism, min(keyword) FILTER (WHERE hit) AS keyword, list(DISTINCT origin) FILTER (WHERE hit) AS origins FROM hits GROUP BY id),
m AS (
  SELECT 1 AS run, t.id, t.severity, a.id IS NOT NULL AS touched, rank IS NOT NULL AS recalled, rank, {_array(STAGES)}[rank + 1] AS stage, keyword, coalesce(executed, false) AS executed, coalesce(mechanism, false) AS mechanism,
         rank IS NOT NULL AND list_has_any(origins, ['llm_proposer', 'invariant_reasoner']) AND NOT list_contains(origins, 'detector') AS novel FROM truth t LEFT JOIN agg a USING (id))"""
ORACLE = {
    "ground_truth": f"WITH {_TRUTH_SQL} SELECT contest, id, severity, fn_raw AS fn, array_to_string(match_any, '|') AS match_any FROM truth",
    "run_candidates": f"WITH {_CANDIDATES_SQL} SELECT source, stage, array_to_string(functions, '|') AS functions, array_to_string(files, '|') AS files, text, vulnerability_class, executed, origin FROM cand",
    "recall_matches": f"WITH {_MATCHES_SQL} SELECT run, id, severity, touched, recalled, stage, keyword, executed, mechanism, novel FROM m",
    "recall_report": f"""WITH {_MATCHES_SQL} SELECT run, coalesce(severity, 'all') AS severity, count(*) AS total, count(*) FILTER (WHERE touched) AS touched, {", ".join(f"count(*) FILTER (WHERE rank >= {i}) AS {s}" for i, s in enumerate(STAGES))},
count(*) FILTER (WHERE executed) AS executed, count(*) FILTER (WHERE mechanism) AS mechanism, count(*) FILTER (WHERE novel) AS novel, count(*) FILTER (WHERE rank >= 0) / CAST(count(*) AS DOUBLE) AS recall FROM m GROUP BY GROUPING SETS ((run), (run, severity))""",
    "artifact_arities": f"""WITH a AS (SELECT regexp_extract(path, '([^/]+)\\.json$', 1) AS contract, unnest(CAST(value AS JSON)->'$.abi[*]') AS x FROM {values_sql(ARTIFACTS, "path, value")} WHERE NOT contains(path, 'build-info/'))
SELECT contract, x->>'name' AS fn, array_to_string(list_sort(list(DISTINCT coalesce(json_array_length(x->'inputs'), 0))), ',') AS arities FROM a WHERE contract = 'Vault' AND x->>'type' = 'function' GROUP BY ALL""",
}
