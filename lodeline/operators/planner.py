"""Plans of calls: state effects, milestones, filters of decisions, validation of exploit plans, report edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.operators import codefacts as C
from lodeline.operators.slices import functions_of
from lodeline.functions.text import string_list, tolerant_object
from lodeline.plans.shared import materialise
from lodeline.sources.sample import quoted, values_sql

#: Classes whose hypotheses are anchored at the entry points that reach them, and how many are added.
ENRICHED, ADDED = ("accounting", "accounting_invariant", "business_logic", "fee", "share_accounting", "rounding"), 2
#: Words that are arguments without being declared, and an arity that is not known.
ARGUMENT_WORDS, ANY_ARITY = ("true", "false", "this", "msg", "block", "tx", "type", "address"), -1
MOST_RECORDS = 8
#: Milestones of a run in order.
CHAIN = ("snapshot", "static_facts", "protocol_ir", "graph", "hypotheses", "research", "report")

_IDENTIFIER = r"^[A-Za-z_]\w*$"


def effects(outputs: DataFrame, declared: DataFrame) -> DataFrame:
    """run, state_path, value (JSON): what the calls of a run leave at each path of its state, in order of the calls.

    ``outputs`` (run, call, tool, output: JSON), ``declared`` (tool, output_path, state_path, merge). A missing or null value has
    no effect. set puts the value; extend adds it, or its items, to the list there, and begins one where there is none; update
    merges an object into the object there, later keys winning, and else puts the value. Types are kept (VARIANT). A path's
    history counts from the last effect that put something new there. Paths are looked at one by one, also where one leads into another.
    """
    path = F.when(F.col("output_path") == "", F.lit("$")).otherwise(F.concat(F.lit("$."), "output_path"))
    rows = outputs.withColumn("output", F.try_parse_json("output")).join(F.broadcast(declared), "tool")  # what a registry declares
    rows = rows.withColumn("value", F.try_variant_get("output", path, "variant")).where("run is not null and state_path is not null and value is not null and not is_variant_null(value)")
    kind = F.schema_of_variant("value")
    rows = rows.select("run", "state_path", "call", "merge", "value", F.when(F.col("merge") == "extend", "list").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("other").alias("kind"), kind.startswith("ARRAY").alias("many"))
    of = ["run", "state_path"]
    back = Window.partitionBy(*of).orderBy(F.desc("call"))
    goes_on = ((F.col("merge") == "extend") & (F.col("before") == "list")) | ((F.col("merge") == "update") & (F.col("before") == "object") & (F.col("kind") == "object"))
    rows = rows.withColumn("before", F.lead("kind").over(back)).withColumn("anew", ~F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumn("since", F.max(F.when(F.col("anew"), F.col("call"))).over(back)).where("call >= coalesce(since, call)")
    rows = materialise(rows.select(*of, "call", "value", "kind", "many"), "effects")  # three readers, and values are parsed once
    lists = rows.where("kind = 'list'").withColumn("items", F.when(F.col("many"), F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value")))
    items = lists.select(*of, "call", F.posexplode_outer("items").alias("i", "item"))
    extended = items.groupBy(*of).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("call", "i", F.to_json("item").alias("item"))))).alias("x")).select(*of, F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["item"]), ","), F.lit("]")).alias("value"))
    keys = rows.where("kind = 'object'").select(*of, "call", F.explode_outer(F.try_variant_get("value", "$", "map<string,variant>")).alias("k", "v"))
    latest = keys.groupBy(*of, "k").agg(F.max_by(F.to_json("v"), "call").alias("v"))
    updated = latest.groupBy(*of).agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("x"))
    quoted_key = lambda k: F.substring(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)
    updated = updated.select(*of, F.concat(F.lit("{"), F.array_join(F.transform("x", lambda x: F.concat(quoted_key(x["k"]), F.lit(":"), x["v"])), ","), F.lit("}")).alias("value"))
    other = rows.where("kind = 'other'").groupBy(*of).agg(F.max_by(F.to_json("value"), "call").alias("value"))
    return extended.unionByName(updated).unionByName(other)


def run_through(done: DataFrame, chain: tuple[str, ...], target: str) -> DataFrame:
    """run, milestone, place: what each run still has to do, in order, up to ``target``. ``done`` is (run, milestone)."""
    steps = done.sparkSession.createDataFrame(list(enumerate(chain)), "place long, milestone string").where(F.col("place") <= chain.index(target))
    wanted = done.select("run").distinct().join(F.broadcast(steps), F.lit(True))  # a run has a handful of milestones
    return wanted.join(done, ["run", "milestone"], "left_anti").select("run", "milestone", "place")


def update_plan(plan: DataFrame, updates: DataFrame) -> DataFrame:
    """``plan`` (step, status) with the last status that ``updates`` (seq, step, status) gives a step."""
    last = updates.groupBy("step").agg(F.max_by("status", "seq").alias("new"))
    return plan.join(last, "step", "left").select("step", F.coalesce("new", "status").alias("status"), F.col("new").isNotNull().alias("updated"))


def decided(decisions: DataFrame, tools: DataFrame) -> DataFrame:
    """seq, tool, verdict of (seq, tool, input: JSON): the first reason that applies, or run.

    ``tools`` is (tool, side_effects, required). In order: unknown_tool, blocked_<effect>, missing_required_input, and
    duplicate_call for an input that an earlier decision that runs has.
    """
    known = decisions.join(tools, "tool", "left")
    given = F.map_keys(F.from_json("input", "map<string,string>"))
    blocked = F.get(F.array_intersect(F.array(F.lit("network"), F.lit("subprocess"), F.lit("write_repo")), "side_effects"), F.lit(0))
    reason = (
        F.when(F.col("required").isNull(), F.lit("unknown_tool"))
        .when(blocked.isNotNull(), F.concat(F.lit("blocked_"), blocked))
        .when(F.size(F.array_except("required", given)) > 0, F.lit("missing_required_input"))
    )
    same = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json("input", "map<string,string>"))))), 256)
    judged = known.withColumn("reason", reason).withColumn("same", same)
    nth = F.row_number().over(Window.partitionBy("tool", "same", F.col("reason").isNull()).orderBy("seq"))
    return judged.withColumn("nth", nth).select("seq", "tool", F.coalesce("reason", F.when(F.col("nth") > 1, F.lit("duplicate_call")), F.lit("run")).alias("verdict"))


def enriched(hypotheses: DataFrame, fns: DataFrame, most: int = ADDED) -> DataFrame:
    """repo, id, functions: hypotheses of accounting kinds, with the first callers of their functions added.

    A caller mentions the function as a word of its calls and is not among the functions already.
    """
    wanted = hypotheses.where(F.col("vulnerability_class").isin(*ENRICHED)).select("repo", "id", F.explode("functions").alias("callee"))
    calls = fns.select("repo", "function_name", "file_path", "start_line", F.explode("calls").alias("called")).select("repo", "function_name", "file_path", "start_line", F.element_at(F.split("called", r"\."), -1).alias("callee"))
    found = wanted.join(calls, ["repo", "callee"]).join(hypotheses.select("repo", "id", "functions"), ["repo", "id"]).where(~F.array_contains("functions", F.col("function_name")))
    first = found.groupBy("repo", "id", "function_name").agg(F.min(F.struct("file_path", "start_line")).alias("at"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("repo", "id").orderBy("at", "function_name"))).where(F.col("nth") <= most)
    added = ranked.groupBy("repo", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "function_name"))), lambda x: x["function_name"]).alias("callers"))
    return hypotheses.join(added, ["repo", "id"], "left").select("repo", "id", F.concat("functions", F.coalesce("callers", F.array().cast("array<string>"))).alias("functions"))


SNIPPET = "file_path string, source_files array<string>, line int, function string, functions array<string>, description string, text string, check string, kind string"


def evidence_records(snippets: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """run, nth, file_path, line, function, message of (run, seq, value: JSON): distinct records in order, the first ``most``.

    The message is the first of description, text, function and check.
    """
    s = snippets.select("run", "seq", F.from_json("value", SNIPPET).alias("s")).select("run", "seq", "s.*")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    message = F.coalesce(some("description"), some("text"), F.concat(F.lit("Function declaration: "), some("function")), F.concat(F.lit("Slither detector: "), some("check")), F.lit("Selected evidence snippet."))
    rows = s.select("run", "seq", F.coalesce(some("file_path"), F.get("source_files", F.lit(0))).alias("file_path"), "line", F.coalesce("function", F.get("functions", F.lit(0))).alias("function"), message.alias("message"))
    once = rows.groupBy("run", "file_path", "line", "function", "message").agg(F.min("seq").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("run", "nth", "file_path", "line", "function", "message")


def add_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """``findings`` (run, nth, id, evidence) with the messages of (run, seq, message) added to a run's first finding."""
    more = evidence.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("more"))
    first = F.min("nth").over(Window.partitionBy("run"))
    rows = findings.withColumn("first", first).join(more, "run", "left")
    return rows.select("run", "nth", "id", F.when(F.col("nth") == F.col("first"), F.concat("evidence", F.coalesce("more", F.array().cast("array<string>")))).otherwise(F.col("evidence")).alias("evidence"))


PLAN = "actors array<struct<name:string>>, setup_calls array<struct<actor:string,target:string,function:string,args:array<string>>>, attack_calls array<struct<actor:string,target:string,function:string,args:array<string>>>, before array<struct<name:string,expr:string>>, after array<struct<name:string,expr:string>>, invariant struct<assertion:string>"


def plan_errors(plans: DataFrame, signatures: DataFrame, targets: list[str]) -> DataFrame:
    """plan, errors: what is wrong with each exploit plan (plan, value: JSON), sorted; none for a sound one.

    ``signatures`` (type: null for any receiver, function, arity), a receiver's type being its root name with a capital
    initial where it has signatures of its own. Unknown actors, targets, arguments, functions and arities, reads that are not
    compared, and names that are no identifiers are errors.
    """
    p = plans.select("plan", F.from_json("value", PLAN).alias("p")).select("plan", "p.*")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = dict(zip(p.columns, (f.dataType for f in p.schema), strict=True))
    for c in ("actors", "setup_calls", "attack_calls", "before", "after"):
        p = p.withColumn(c, none(F.col(c), kinds[c]))
    known = F.array(*map(F.lit, targets))
    names = F.transform("actors", lambda a: a["name"])
    p = p.withColumn("names", names).withColumn("reads", F.concat("before", "after")).withColumn("allowed", F.array_union(known, "names"))
    bad = lambda c: ~c.rlike(_IDENTIFIER)
    assertion = F.trim(F.coalesce("invariant.assertion", F.lit("")))
    compared = F.exists("after", lambda s: F.array_contains(F.regexp_extract_all(F.col("invariant.assertion"), F.lit(r"\bafter_(\w+)\b"), F.lit(1)), s["name"]))
    roots = lambda s: F.regexp_extract_all(s["expr"], F.lit(r"(?<![.\w])([A-Za-z_]\w*)\s*\."), F.lit(1))
    own = F.array_compact(
        F.concat(
            F.array(F.when(F.size("attack_calls") == 0, F.lit("no attack call")), F.when((F.size("before") == 0) | (F.size("after") == 0), F.lit("no state compared"))),
            F.transform(F.filter("names", bad), lambda n: F.concat(F.lit("actor name: "), n)),
            F.transform(F.filter("reads", lambda s: bad(s["name"])), lambda s: F.concat(F.lit("read name: "), s["name"])),
            F.transform(F.flatten(F.transform("reads", lambda s: F.filter(roots(s), lambda r: ~F.array_contains("allowed", r)))), lambda r: F.concat(F.lit("read of unknown: "), r)),
            F.array(F.when(assertion == "", F.lit("no assertion")).when(~compared, F.lit("assertion ignores the state after"))),
        )
    )
    calls = p.select("plan", "allowed", F.posexplode(F.concat("setup_calls", "attack_calls")).alias("i", "c")).select("plan", "allowed", "i", F.coalesce("c.actor", F.lit("")).alias("actor"), F.trim(F.coalesce("c.target", F.lit(""))).alias("target"), F.col("c.function").alias("function"), none(F.col("c.args"), "array<string>").alias("args"))
    root = F.regexp_extract("target", r"^([^.(\[]*)", 1)
    typed = F.concat(F.upper(F.substring("target", 1, 1)), F.substring("target", 2, 1000))
    by_type = signatures.groupBy(F.coalesce("type", F.lit("")).alias("type"), "function").agg(F.collect_set("arity").alias("arities"))
    types = by_type.select("type").distinct()
    calls = calls.withColumn("type", typed).join(types.where("type != ''").withColumn("has_type", F.lit(True)), "type", "left").withColumn("type", F.when(F.col("has_type"), F.col("type")).otherwise(F.lit("")))
    calls = calls.join(by_type, ["type", "function"], "left")
    argument = lambda a: (
        F.when(a.rlike("<[^>]+>"), F.concat(F.lit("placeholder: "), a))
        .when(F.trim(a).contains(" ") & ~F.trim(a).rlike("^[\"']") & ~a.contains("("), F.concat(F.lit("unquoted string: "), a))
        .when(F.trim(a).rlike(_IDENTIFIER) & ~F.array_contains("allowed", F.trim(a)) & ~F.trim(a).isin(*ARGUMENT_WORDS), F.concat(F.lit("unknown argument: "), a))
    )
    of_call = F.array_compact(
        F.concat(
            F.array(
                F.when((F.col("actor") != "") & ~F.array_contains("allowed", F.col("actor")), F.concat(F.lit("unknown actor: "), "actor")),
                F.when((root != "") & ~F.array_contains("allowed", root), F.concat(F.lit("unknown target: "), "target")),
                F.when(bad(F.col("function")), F.concat(F.lit("function name: "), "function"))
                .when(F.col("arities").isNull(), F.concat(F.lit("unknown function: "), "function"))
                .when(~F.array_contains("arities", F.size("args")) & ~F.array_contains("arities", ANY_ARITY), F.concat(F.lit("arity: "), "function", F.lit("/"), F.size("args").cast("string"))),
            ),
            F.transform("args", argument),
        )
    )
    errors = p.select("plan", F.explode(own).alias("error")).unionByName(calls.select("plan", F.explode(of_call).alias("error"))).groupBy("plan").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    return plans.select("plan").join(errors, "plan", "left").select("plan", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


#: tool, output_path, state_path, merge: what calls of each type leave in a user's state.
EFFECTS = (
    ("signup", "about", "facts", "set"), ("click", "facts", "facts", "update"), ("error", "facts.k", "facts", "update"), ("view", "id", "seen", "extend"), ("purchase", "ids", "seen", "set"),
    ("click", "ids", "clicks.all", "extend"), ("purchase", "amount", "last.amount", "set"), ("signup", "missing", "facts", "set"),
)
#: run, milestone.
DONE = ((1, "snapshot"), (1, "static_facts"), (2, "snapshot"), (2, "protocol_ir"), (3, "graph"))
STEPS, UPDATES = ((1, "open"), (2, "open"), (3, "open")), ((1, 2, "started"), (2, 2, "done"), (3, 3, "started"), (4, 9, "done"))
#: seq, tool, input; and tool, side effects, required inputs.
DECISIONS = ((1, "repo.scan", '{"repo_path": "r"}'), (2, "repo.scan", '{"repo_path": "r"}'), (3, "repo.scan", "{}"), (4, "web.get", '{"url": "u"}'), (5, "nothing", "{}"), (6, "repo.scan", '{"repo_path": "s"}'), (7, "repo.find", '{"q": "a", "n": "1"}'), (8, "repo.find", '{"n": "1", "q": "a"}'))
TOOLS = (("repo.scan", "", "repo_path"), ("web.get", "network", "url"), ("repo.find", "read", "q"))
#: repo, id, class, functions.
ANCHORED = (("market", "h1", "accounting_invariant", "sendOut"), ("market", "h2", "reentrancy", "sendOut"), ("market", "h3", "fee", "logged|sendOut"), ("book", "h4", "fee", "feeOf"))
#: run, seq, snippet.
SNIPPETS = (
    (1, 1, '{"file_path": "a", "line": 3, "description": " d ", "text": "t"}'), (1, 2, '{"file_path": "a", "line": 3, "description": "d"}'), (1, 3, '{"source_files": ["b", "c"], "functions": ["f"], "check": "tx"}'),
    (1, 4, '{"function": "g", "file_path": "a"}'), (2, 1, "{}"), *((3, i, f'{{"text": "t{i}"}}') for i in range(1, 12)),
)
FOUND, MORE = ((1, 1, "f1", "a|b"), (1, 2, "f2", "c"), (2, 5, "f3", "")), ((1, 1, "x"), (1, 2, "y"), (3, 1, "z"))
SIGNATURES = (("Vault", "deposit", 1), ("Vault", "withdraw", 2), (None, "transfer", 2), (None, "approve", ANY_ARITY))
TARGETS = ["vault", "token", "owner"]
PLANS = (
    (1, '{"actors": [{"name": "attacker"}], "attack_calls": [{"actor": "attacker", "target": "vault", "function": "deposit", "args": ["1e18"]}, {"target": "token", "function": "transfer", "args": ["attacker", "1"]}], "before": [{"name": "bal", "expr": "token.balanceOf(attacker)"}], "after": [{"name": "bal", "expr": "token.balanceOf(attacker)"}], "invariant": {"assertion": "after_bal <= before_bal"}}'),
    (2, '{"actors": [{"name": "1bad"}], "setup_calls": [{"actor": "ghost", "target": "pool.x()", "function": "deposit", "args": ["<amount>", "Bad Pool", "TestPool"]}], "attack_calls": [], "before": [], "after": [{"name": "x y", "expr": "pool.total()"}], "invariant": {"assertion": "true"}}'),
    (3, '{"attack_calls": [{"target": "vault", "function": "withdraw", "args": ["1"]}, {"target": "vault", "function": "steal", "args": []}, {"target": "token", "function": "approve", "args": ["owner", "1", "2"]}], "before": [{"name": "a", "expr": "1"}], "after": [{"name": "a", "expr": "1"}], "invariant": {}}'),
)


def reply() -> Column:
    """A reply about an event, by its number: text around an object, half an object, or none."""
    return (
        F.when(F.col("event_id") % 5 == 0, F.format_string('Event %d: {"in": %s, "tags": ["%s", "b"]} {"in": {"k": -1}}', "event_id", "props", "event_type"))
        .when(F.col("event_id") % 5 == 1, F.format_string('Here:\n```json\n{"in": %s, "tags": "%s"}\n```\n{"in": 1}', "props", "event_type"))
        .when(F.col("event_id") % 5 == 2, F.format_string('{"note": "a } and \\"{", "in": %s}, then', "props"))
        .when(F.col("event_id") % 5 == 3, F.format_string('nothing { "in": %s', "props"))
        .otherwise(F.col("event_type"))
    )


def _split(c: str) -> Column:
    return F.filter(F.split(c, r"\|"), lambda x: x != "")


def q_state_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each user's events leave, an event being a call whose output holds its input and value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    about = F.format_string('{"facts": %s, "id": %d, "ids": [%d, "e%d"], "amount": %s, "about": {"by": "signup", "k": %d}}', "props", "event_id", "event_id", "event_id", F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_id") % 7)
    return effects(events.select(F.col("user_id").alias("run"), F.col("event_id").alias("call"), F.col("event_type").alias("tool"), about.alias("output")), spark.createDataFrame(EFFECTS, "tool string, output_path string, state_path string, merge string"))


def q_tolerant_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found in replies that are made of each event: bare, fenced, nested, with braces in strings, and broken ones."""
    replies = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", tolerant_object(reply()).alias("found"))
    v = replies.withColumn("v", F.try_parse_json("found"))
    return v.select("event_id", F.try_variant_get("v", "$.in.k", "bigint").alias("k"), F.array_join(string_list(F.col("v"), "$.tags"), ",").alias("tags"), F.try_variant_get("v", "$.note", "string").alias("note"), F.schema_of_variant("v").alias("kind"))


def q_tolerant_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema for the objects of all replies of a type of event, and how many there are."""
    replies = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.try_parse_json(tolerant_object(reply())).alias("v"))
    return replies.groupBy("event_type").agg(F.count("v").alias("n"), F.schema_of_variant_agg("v").alias("kind"))


def q_run_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_through(spark.createDataFrame(DONE, "run int, milestone string"), CHAIN, "hypotheses")


def q_plan_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_plan(spark.createDataFrame(STEPS, "step int, status string"), spark.createDataFrame(UPDATES, "seq int, step int, status string"))


def q_decision_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "tool string, side_effects string, required string").select("tool", _split("side_effects").alias("side_effects"), _split("required").alias("required"))
    return decided(spark.createDataFrame(DECISIONS, "seq int, tool string, input string"), tools)


def q_entry_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses on functions of each repository that follows one of two patterns."""
    own = C.facts(spark, sf_dir)
    patterns = spark.createDataFrame(ANCHORED, "pattern string, id string, vulnerability_class string, functions string").withColumn("functions", _split("functions"))
    repositories = own.sources.select("repo", F.regexp_extract("repo", "^[a-z]+", 0).alias("pattern")).distinct()
    rows = repositories.join(F.broadcast(patterns), "pattern").drop("pattern")
    return enriched(rows, functions_of(own)).withColumn("functions", F.array_join("functions", ","))


def q_evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_records(spark.createDataFrame(SNIPPETS, "run int, seq int, value string")).withColumnRenamed("function", "fn")


def q_report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame(FOUND, "run int, nth int, id string, evidence string").withColumn("evidence", _split("evidence"))
    return add_evidence(found, spark.createDataFrame(MORE, "run int, seq int, message string")).withColumn("evidence", F.array_join("evidence", "|"))


def q_plan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan_errors(spark.createDataFrame(PLANS, "plan int, value string"), spark.createDataFrame(SIGNATURES, "type string, function string, arity int"), TARGETS)
    return found.select("plan", F.array_join("errors", "; ").alias("errors"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_KNOWN = "[" + ", ".join(map(quoted, TARGETS)) + "]"
ORACLE = {
    "state_effects": """WITH e AS (SELECT * FROM events WHERE user_id IS NOT NULL),
o AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'click' AND json_type(CAST(props AS JSON)) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 7 AS m FROM e WHERE event_type IN ('signup', 'click', 'error')),
l AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM o),
r AS (SELECT *, max(CASE WHEN kind <> 'object' OR coalesce(before, 'other') = 'other' THEN event_id END) OVER (PARTITION BY user_id) AS since FROM l),
f AS (SELECT user_id, bool_or(kind = 'set') AS signed, bool_or(kind = 'other') AS plain, arg_max(CASE WHEN kind = 'set' THEN CAST(m AS VARCHAR) ELSE k END, event_id) AS k FROM r WHERE event_id >= since GROUP BY 1),
p AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS since FROM e GROUP BY 1),
seen AS (SELECT user_id, string_agg(CASE WHEN event_type = 'purchase' THEN event_id || ',"e' || event_id || '"' ELSE CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS items FROM e JOIN p USING (user_id) WHERE (event_type = 'view' AND event_id > coalesce(since, -1)) OR event_id = since GROUP BY 1)
SELECT user_id AS run, 'facts' AS state_path, CASE WHEN plain THEN k WHEN signed THEN '{"by":"signup","k":' || k || '}' ELSE '{"k":' || k || '}' END AS value FROM f
UNION ALL SELECT user_id, 'seen', '[' || items || ']' FROM seen
UNION ALL SELECT user_id, 'clicks.all', '[' || string_agg(event_id || ',"e' || event_id || '"', ',' ORDER BY event_id) || ']' FROM e WHERE event_type = 'click' GROUP BY 1
UNION ALL SELECT user_id, 'last.amount', arg_max(regexp_replace(regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), event_id) FROM e WHERE event_type = 'purchase' GROUP BY 1""",
    "tolerant_objects": """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 5 WHEN 0 THEN event_type || ',b' WHEN 1 THEN event_type END AS tags, CASE WHEN event_id % 5 = 2 THEN 'a } and "{' END AS note,
CASE event_id % 5 WHEN 0 THEN 'OBJECT<in: OBJECT<k: BIGINT>, tags: ARRAY<STRING>>' WHEN 1 THEN 'OBJECT<in: OBJECT<k: BIGINT>, tags: STRING>' WHEN 2 THEN 'OBJECT<in: OBJECT<k: BIGINT>, note: STRING>' END AS kind FROM events""",
    "tolerant_kinds": """SELECT event_type, count(*) FILTER (WHERE event_id % 5 < 3) AS n, 'OBJECT<in: OBJECT<k: BIGINT>, note: STRING, tags: VARIANT>' AS kind FROM events GROUP BY 1""",
    "run_through": f"""SELECT r.run, c.milestone, c.place FROM (SELECT DISTINCT run FROM {values_sql(DONE, "run, milestone")}) r CROSS JOIN {values_sql(tuple(enumerate(CHAIN)), "place, milestone").replace(" AS t(", " AS c(")} WHERE c.place <= {CHAIN.index("hypotheses")} AND (r.run, c.milestone) NOT IN (SELECT run, milestone FROM {values_sql(DONE, "run, milestone")})""",
    "plan_updates": f"""SELECT p.step, coalesce(u.status, p.status) AS status, u.status IS NOT NULL AS updated FROM {values_sql(STEPS, "step, status").replace(" AS t(", " AS p(")} LEFT JOIN (SELECT step, arg_max(status, seq) AS status FROM {values_sql(UPDATES, "seq, step, status")} GROUP BY 1) u USING (step)""",
    "decision_filter": f"""WITH j AS (SELECT d.*, t.tool IS NOT NULL AS known, t.side_effects, t.required, list_sort(json_keys(CAST(d.input AS JSON))) AS given FROM {values_sql(DECISIONS, "seq, tool, input").replace(" AS t(", " AS d(")} LEFT JOIN {values_sql(TOOLS, "tool, side_effects, required")} USING (tool)),
k AS (SELECT *, CASE WHEN NOT known THEN 'unknown_tool' WHEN side_effects IN ('network', 'subprocess', 'write_repo') THEN 'blocked_' || side_effects WHEN NOT list_contains(given, required) THEN 'missing_required_input' END AS reason,
  array_to_string(list_transform(given, lambda g: g || '=' || (CAST(input AS JSON)->>g)), ',') AS same FROM j)
SELECT seq, tool, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY tool, same, reason IS NULL ORDER BY seq) > 1 THEN 'duplicate_call' END, 'run') AS verdict FROM k""",
    "entry_enrich": f"""WITH {C.FUNCTIONS_SQL},
h AS (SELECT s.repo, id, vulnerability_class, string_split(functions, '|') AS functions FROM (SELECT DISTINCT repo FROM src) s JOIN {values_sql(ANCHORED, "pattern, id, vulnerability_class, functions")} ON regexp_extract(s.repo, '^[a-z]+') = pattern),
c AS (SELECT repo, function_name, file_path, start_line, regexp_extract(unnest(calls), '[^.]+$') AS callee FROM fn),
a AS (SELECT h.repo, h.id, c.function_name, min((c.file_path, c.start_line)) AS place FROM h JOIN c ON c.repo = h.repo AND list_contains(h.functions, c.callee) WHERE vulnerability_class IN {C._list(ENRICHED)} AND NOT list_contains(h.functions, c.function_name) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY place, function_name) AS nth FROM a)
SELECT h.repo, h.id, concat_ws(',', array_to_string(h.functions, ','), (SELECT string_agg(function_name, ',' ORDER BY nth) FROM k WHERE k.repo = h.repo AND k.id = h.id AND nth <= {ADDED})) AS functions FROM h""",
    "evidence_records": f"""WITH s AS (SELECT run, seq, CAST(value AS JSON) AS j FROM {values_sql(SNIPPETS, "run, seq, value")}),
r AS (SELECT run, seq, coalesce(j->>'file_path', j->>'$.source_files[0]') AS file_path, CAST(j->>'line' AS INT) AS line, coalesce(j->>'function', j->>'$.functions[0]') AS fn,
  coalesce(nullif(trim(j->>'description'), ''), nullif(trim(j->>'text'), ''), 'Function declaration: ' || (j->>'function'), 'Slither detector: ' || (j->>'check'), 'Selected evidence snippet.') AS message FROM s),
o AS (SELECT run, file_path, line, fn, message, min(seq) AS seq FROM r GROUP BY ALL)
SELECT run, nth, file_path, line, fn, message FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS nth FROM o) WHERE nth <= {MOST_RECORDS}""",
    "report_evidence": f"""SELECT run, nth, id, CASE WHEN nth = min(nth) OVER (PARTITION BY run) THEN concat_ws('|', nullif(evidence, ''), (SELECT string_agg(message, '|' ORDER BY seq) FROM {values_sql(MORE, "run, seq, message").replace(" AS t(", " AS m(")} WHERE m.run = f.run)) ELSE evidence END AS evidence FROM {values_sql(FOUND, "run, nth, id, evidence").replace(" AS t(", " AS f(")}""",
    "plan_validate": f"""WITH p AS (SELECT plan, CAST(value AS JSON) AS j FROM {values_sql(PLANS, "plan, value")}),
n AS (SELECT *, list_concat({_KNOWN}, coalesce(j->>'$.actors[*].name', [])) AS allowed, coalesce(j->>'$.invariant.assertion', '') AS assertion FROM p),
c AS (SELECT plan, allowed, coalesce(x->>'actor', '') AS actor, coalesce(x->>'target', '') AS target, x->>'function' AS fn, coalesce(x->>'$.args[*]', []) AS args
      FROM (SELECT *, unnest(list_concat(coalesce(j->'$.setup_calls[*]', []), coalesce(j->'$.attack_calls[*]', []))) AS x FROM n)),
t AS (SELECT c.*, CASE WHEN target = 'vault' THEN 'Vault' END AS type FROM c),
s AS (SELECT t.*, (SELECT list(arity) FROM {values_sql(SIGNATURES, "type, fn, arity").replace(" AS t(", " AS g(")} WHERE g.fn = t.fn AND g.type IS NOT DISTINCT FROM t.type) AS arities FROM t),
st AS (SELECT plan, allowed, unnest(list_concat(coalesce(j->'$.before[*]', []), coalesce(j->'$.after[*]', []))) AS x FROM n),
e AS (
  SELECT plan, 'no attack call' AS error FROM n WHERE coalesce(len(j->'$.attack_calls[*]'), 0) = 0
  UNION ALL SELECT plan, 'no state compared' FROM n WHERE coalesce(len(j->'$.before[*]'), 0) = 0 OR coalesce(len(j->'$.after[*]'), 0) = 0
  UNION ALL SELECT plan, 'actor name: ' || a FROM (SELECT plan, unnest(j->>'$.actors[*].name') AS a FROM n) WHERE NOT regexp_matches(a, '{_IDENTIFIER}')
  UNION ALL SELECT plan, 'read name: ' || (x->>'name') FROM st WHERE NOT regexp_matches(x->>'name', '{_IDENTIFIER}')
  UNION ALL SELECT plan, 'read of unknown: ' || r FROM (SELECT plan, allowed, unnest(regexp_extract_all(x->>'expr', '(?:^|[^.A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)[ ]*\\.', 1)) AS r FROM st) WHERE NOT list_contains(allowed, r)
  UNION ALL SELECT plan, CASE WHEN assertion = '' THEN 'no assertion' ELSE 'assertion ignores the state after' END FROM n WHERE assertion = '' OR NOT coalesce(list_has_any(regexp_extract_all(assertion, '\\bafter_(\\w+)\\b', 1), j->>'$.after[*].name'), false)
  UNION ALL SELECT plan, 'unknown actor: ' || actor FROM s WHERE actor <> '' AND NOT list_contains(allowed, actor)
  UNION ALL SELECT plan, 'unknown target: ' || target FROM s WHERE target <> '' AND NOT list_contains(allowed, regexp_extract(target, '^([^.(\\[]*)', 1))
  UNION ALL SELECT plan, CASE WHEN NOT regexp_matches(fn, '{_IDENTIFIER}') THEN 'function name: ' || fn WHEN arities IS NULL THEN 'unknown function: ' || fn ELSE 'arity: ' || fn || '/' || len(args) END FROM s WHERE NOT regexp_matches(fn, '{_IDENTIFIER}') OR arities IS NULL OR NOT list_has_any(arities, [len(args), {ANY_ARITY}])
  UNION ALL SELECT plan, CASE WHEN regexp_matches(a, '<[^>]+>') THEN 'placeholder: ' || a WHEN contains(a, ' ') AND NOT contains(a, '(') THEN 'unquoted string: ' || a ELSE 'unknown argument: ' || a END
    FROM (SELECT plan, allowed, unnest(args) AS a FROM s) WHERE regexp_matches(a, '<[^>]+>') OR (contains(a, ' ') AND NOT contains(a, '(')) OR (regexp_matches(a, '{_IDENTIFIER}') AND NOT list_contains(allowed, a) AND a NOT IN {C._list(ARGUMENT_WORDS)}))
SELECT p.plan, coalesce((SELECT string_agg(error, '; ' ORDER BY error) FROM e WHERE e.plan = p.plan), '') AS errors FROM p""",
}
