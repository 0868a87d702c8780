"""Ranking, selection under budgets, gates, scores and run classification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions import text as X
from lodeline.plans.shared import bound_batches
from lodeline.sources.sample import quoted, values_sql

#: Severities by class, and their rank.
SEVERITY = {"secret": "high", "contact": "medium", "licensing": "low"}
RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
#: Phrases that block a finding.
BLOCKING = ("low to none", "no concrete secondary target", "cei-safe", "safeerc20-only", "missing concrete", "blocking counterevidence", "no unprivileged impact")
#: Test runs: id, return code, output, timed out.
RUNS = (
    (1, 0, "[PASS] test_a() 3 passed; 0 failed; 0 skipped", False),
    (2, 1, "[FAIL. Reason: assertion failed] test_b() 1 passed; 2 failed", False),
    (3, 1, "Compiler error: not found", False),
    (4, None, "", True),
    (5, 1, "[FAIL. Reason: revert: not owner] test_c() 0 passed; 1 failed", False),
    (6, 0, "No tests found", False),
    (7, 1, "[FAIL. Reason: invariant violated] invariant_x() 4 passed; 1 failed; 2 skipped", False),
)
CONCEPTS = {"access": ("owner", "role", "auth"), "accounting": ("fee", "share", "debt"), "oracle": ("price", "oracle", "stale"), "prose": ("the", "and", "der", "que", "les")}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_class(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("license"), "licensing").when(low.rlike("token|password"), "secret").when(low.rlike(r"[^\s@]+@[a-z0-9]+[.]"), "contact").otherwise("prose")


def severity_of(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), kind), F.lit("info"))


def hypotheses(spark, sf_dir) -> DataFrame:
    """Documents as hypotheses: class, title (the first line), evidence, functions, confidence; the label is their proof."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    title = F.regexp_replace(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), r"\s+", " ")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic", document_class(F.col("text")).alias("class"), title.alias("title"))


def rank_and_merge(rows: DataFrame, most: int) -> DataFrame:
    """Hypotheses by rank key; those of equal class and title merge into the first, with the sources of all."""
    proof = F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    key = proof * 10 + F.least(F.floor(F.col("n_chars") / 1000), F.lit(6))
    merged = rows.withColumn("key", key.cast("int")).groupBy("class", "title").agg(F.max(F.struct("key", -F.col("doc_id"))).alias("top"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("merged"))
    return merged.select("class", "title", F.col("top.key").alias("key"), (-F.col("top.col2")).alias("doc_id"), "sources", "merged").orderBy(F.desc("key"), "doc_id").limit(most)


def round_robin(rows: DataFrame, bucket: str, order: list, cap: int) -> DataFrame:
    """The first of each bucket, then the second of each, and so on, up to ``cap`` rows."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("turn") <= cap).orderBy("turn", bucket, *order).limit(cap)


def budget_greedy(rows: DataFrame, group: str, size: str, key: str, budget: int) -> DataFrame:
    """Items of a group in order that fit a budget, skipping those that do not.

    Each choice depends on those before, so a task walks its groups in order with one number a group; the items that
    are chosen are at most ``budget``, if sizes are positive.
    """
    kind = rows.schema[group].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left, chosen = None, budget, []
        for batch in batches:
            done = []
            for of, item, need in zip(batch[group], batch[key], batch[size], strict=True):
                if current is None or of != current:
                    if current is not None:
                        done.append((current, budget - left, chosen))
                    current, left, chosen = of, budget, []
                if need <= left:
                    left -= int(need)
                    chosen.append(int(item))
            yield pd.DataFrame(done, columns=[group, "used", "chosen"])
        if current is not None:
            yield pd.DataFrame([(current, budget - left, chosen)], columns=[group, "used", "chosen"])

    bound_batches(rows.sparkSession)
    ordered = rows.where(F.col(group).isNotNull() & F.col(size).isNotNull()).select(group, key, size).repartition(group).sortWithinPartitions(group, key)
    return ordered.mapInPandas(walk, f"{group} {kind}, used long, chosen array<long>")


def gated(rows: DataFrame) -> DataFrame:
    """Status and confidence after the gates, in order: evidence, proof, counter-evidence."""
    claimed = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "likely").otherwise("needs_manual_review")
    evidence = F.when(claimed.isin("confirmed", "likely") & (F.col("n_chars") < 300), "needs_manual_review").otherwise(claimed)
    proof = F.when((evidence == "confirmed") & ~F.col("class").isin("secret", "contact"), "likely").otherwise(evidence)
    status = F.when(proof.isin("confirmed", "likely") & (F.coalesce("toxic", F.lit(0)) == 1), "rejected").otherwise(proof)
    raw = F.when(F.col("quality") == 1, 0.95).when(F.col("quality") == 0, 0.7).otherwise(0.4)
    return rows.select("doc_id", "class", status.alias("status"), F.when(F.col("class") == "secret", raw).otherwise(F.least(raw, F.lit(0.85))).alias("confidence"), severity_of(F.col("class")).alias("severity"))


def classified_runs(runs: DataFrame) -> DataFrame:
    """Outcome, counts and reason of each test run."""
    low = F.lower("output")
    number = lambda word: F.coalesce(F.try_element_at(F.regexp_extract_all("output", F.lit(f"([0-9]+) {word}"), 1), F.lit(1)).cast("int"), F.lit(0))
    kind = (
        F.when(F.col("timed_out"), "timeout")
        .when(low.contains("no tests found"), "skipped")
        .when(low.contains("invariant violated"), "invariant_violated")
        .when(low.contains("assertion failed"), "assertion_failed")
        .when(low.contains("revert"), "reverted")
        .when(F.col("code") == 0, "held")
        .otherwise("runtime_error")
    )
    return runs.withColumn("timed_out", F.col("timed_out").cast("boolean")).select("run_id", kind.alias("kind"), number("passed").alias("passed"), number("failed").alias("failed"), number("skipped").alias("skipped"), F.regexp_extract("output", r"Reason: ([^\]]+)\]", 1).alias("reason"))


def q_rank_dedup_merge(spark, sf_dir):
    return rank_and_merge(hypotheses(spark, sf_dir), 40)


def q_stratified_round_robin(spark, sf_dir):
    return round_robin(read(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), "doc_id"], 50).select("doc_id", "source", "turn")


def q_diversified_select(spark, sf_dir):
    """Strong first, then one a class, then the rest, at most 30."""
    rows = hypotheses(spark, sf_dir)
    first = rows.groupBy("class").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("of"))).alias("top")).select("class", (-F.col("top.of")).alias("first_doc"))
    tier = F.when((F.col("quality") == 1) & (F.col("n_chars") > 10_000), 0).when(F.col("doc_id") == F.col("first_doc"), 1).otherwise(2)
    return rows.join(first, "class").withColumn("tier", tier).orderBy("tier", F.desc("n_chars"), "doc_id").limit(30).select("doc_id", "class", "tier")


def q_packed_turns(spark, sf_dir):
    """Turns of each conversation that fit 1500 characters: one of each role first, then the others in order, by a table function of SQL."""
    from lodeline.functions.packing import register

    register(spark)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("item"), "role", F.length("text").alias("chars"))
    found = spark.sql("SELECT * FROM packed(TABLE({turns}) PARTITION BY conv_id ORDER BY turn, budget => 1500, item => 'item', cover => 'role', size => 'chars')", turns=turns)
    return found.select("item.conv_id", "item.turn", F.col("cover").alias("role"), "size", F.col("pass").alias("way"), "place", "used")


def q_budget_prefix(spark, sf_dir):
    """Documents of each source and language, in order, as long as they fit a budget together.

    Sums by a thousand ids tell which of them can still hold a fitting document; only those are summed up row by row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "doc_id", "n_chars").withColumn("part", F.floor(F.col("doc_id") / 1000))
    group = ["source", "lang"]
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = docs.groupBy(*group, "part").agg(F.sum("n_chars").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where("start <= 40000")
    w = Window.partitionBy(*group).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    near = docs.join(parts.select(*group, "part"), [*group, "part"], "left_semi")
    return near.withColumn("used", F.sum("n_chars").over(w)).where("used <= 40000").groupBy(*group).agg(F.count("*").alias("n"), F.max("used").alias("used"))


def q_budget_greedy(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    found = budget_greedy(rows, "conv_id", "size", "turn", 300)
    return found.select("conv_id", "used", F.size("chosen").cast("long").alias("n"))


def q_upsert_corpus(spark, sf_dir):
    """Short documents replace those stored under the same id; new ids are added."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    old, new = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    joined = old.alias("o").join(new.alias("n"), "doc_id", "full_outer")
    state = F.when(F.col("o.source").isNull(), "added").when(F.col("n.source").isNull(), "kept").otherwise("replaced")
    return joined.select("doc_id", F.coalesce("n.source", "o.source").alias("source"), F.coalesce("n.n_chars", "o.n_chars").alias("n_chars"), state.alias("state"))


def q_gate_chain(spark, sf_dir):
    return gated(hypotheses(spark, sf_dir))


def q_status_buckets(spark, sf_dir):
    return gated(hypotheses(spark, sf_dir)).groupBy("status", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), F.min("doc_id").alias("first_doc"))


def q_severity_lookup(spark, sf_dir):
    kind = severity_of(F.col("class"))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("severity"))
    return hypotheses(spark, sf_dir).withColumn("severity", kind).groupBy("source").agg(F.max_by("severity", rank).alias("worst"), F.count("*").alias("n"))


def q_fixture_score(spark, sf_dir):
    """A language as a fixture: expected documents are those of quality 1; predicted ones are long and not toxic."""
    rows = hypotheses(spark, sf_dir).where("quality is not null").withColumn("hit", (F.col("n_chars") >= 500) & (F.col("toxic") == 0)).withColumn("want", F.col("quality") == 1)
    agg = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("want").alias("expected"), F.count_if("hit").alias("predicted"), F.count_if(F.col("hit") & F.col("want")).alias("both"))
    recall, precision = F.coalesce(F.try_divide("both", "expected"), F.lit(0.0)), F.coalesce(F.try_divide("both", "predicted"), F.lit(0.0))
    return agg.select("lang", "n", "expected", "predicted", "both", F.round(recall, 4).alias("recall"), F.round(precision, 4).alias("precision"), F.round(60 * recall + 40 * precision, 2).alias("score"))


def q_run_classify(spark, sf_dir):
    return classified_runs(spark.createDataFrame(RUNS, "run_id int, code int, output string, timed_out boolean"))


def q_penalty_and_severity(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    agg = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return agg.select("user_id", "errors", F.least(F.lit(40), F.col("errors") * 8).alias("penalty_percent"), F.when(F.col("errors") >= 5, "high").when(F.col("errors") >= 2, "medium").otherwise("low").alias("severity"))


def q_research_status(spark, sf_dir):
    rows = hypotheses(spark, sf_dir)
    concrete = F.col("title").rlike("license|token")
    status = F.when(F.col("toxic") == 1, F.when(concrete, "rejected").otherwise("needs_manual_review")).when((F.col("quality") == 1) & (F.col("class") != "prose"), "confirmed").when(F.col("quality") == 1, "likely").when(F.col("quality") == 0, "suspicious").otherwise("needs_manual_review")
    return rows.groupBy("class", status.alias("status")).agg(F.count("*").alias("n"))


def q_mechanism_alignment(spark, sf_dir):
    """Pairs of item and source whose terms share a group of concepts."""
    def groups(t):
        return F.array_compact(F.array(*(F.when(F.arrays_overlap(t, F.array(*map(F.lit, w))), F.lit(n)) for n, w in CONCEPTS.items())))

    items = read(spark, sf_dir, "benchmark").select("item_id", F.explode(groups(X.terms(F.col("text")))).alias("concept"))
    docs = read(spark, sf_dir, "documents").select("source", F.explode(groups(X.terms(F.col("text")))).alias("concept")).groupBy("source", "concept").agg(F.count("*").alias("n"))
    return items.join(docs, "concept").groupBy("item_id", "source").agg(F.count("*").alias("concepts"), F.sum("n").alias("n"))


def q_keyword_recall(spark, sf_dir):
    """The first of three keywords that a document holds."""
    low = F.lower("text")
    words = ("released under", "token", "anea")
    first = F.try_element_at(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(low, k)), F.lit(1))
    return read(spark, sf_dir, "documents").groupBy(first.alias("keyword")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))


def q_class_checklist(spark, sf_dir):
    """The ten commonest terms of each class of documents."""
    docs = read(spark, sf_dir, "documents").select(document_class(F.col("text")).alias("class"), X.terms(F.col("text")).alias("terms"))  # once a document, before terms multiply the rows
    rows = docs.select("class", F.explode("terms").alias("term")).groupBy("class", "term").agg(F.count("*").alias("n"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "term"))).where("nth <= 10")


def q_dedup_variants(spark, sf_dir):
    """One document of each first line: the longest, then the least id."""
    rows = read(spark, sf_dir, "documents").withColumn("key", F.md5(F.split_part("text", F.lit("\n"), F.lit(1))))
    return rows.groupBy("key").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.count("*").alias("n"))


def q_hypothesis_union(spark, sf_dir):
    a = hypotheses(spark, sf_dir).where("class = 'secret'").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "class", F.lit(None).cast("string").alias("event_type"))
    b = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("event-"), "event_id").alias("id"), "event_type")
    return a.unionByName(b, allowMissingColumns=True).groupBy("class", "event_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}

_CLASS = "CASE WHEN contains(lower(text), 'license') THEN 'licensing' WHEN regexp_matches(lower(text), 'token|password') THEN 'secret' WHEN regexp_matches(lower(text), '[^\\s@]+@[a-z0-9]+[.]') THEN 'contact' ELSE 'prose' END"
_H = f"""h AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, {_CLASS} AS class, regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g') AS title
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))"""
_SEV = "CASE class WHEN 'secret' THEN 'high' WHEN 'contact' THEN 'medium' WHEN 'licensing' THEN 'low' ELSE 'info' END"
_G = _H + f""", g0 AS (SELECT *, CASE quality WHEN 1 THEN 'confirmed' WHEN 0 THEN 'likely' ELSE 'needs_manual_review' END AS s0 FROM h),
g1 AS (SELECT *, CASE WHEN s0 IN ('confirmed','likely') AND n_chars < 300 THEN 'needs_manual_review' ELSE s0 END AS s1 FROM g0),
g2 AS (SELECT *, CASE WHEN s1 = 'confirmed' AND class NOT IN ('secret','contact') THEN 'likely' ELSE s1 END AS s2 FROM g1),
g AS (SELECT doc_id, class, CASE WHEN s2 IN ('confirmed','likely') AND coalesce(toxic, 0) = 1 THEN 'rejected' ELSE s2 END AS status,
  CASE WHEN class = 'secret' THEN r ELSE least(r, 0.85) END AS confidence, {_SEV} AS severity FROM (SELECT *, CAST(CASE quality WHEN 1 THEN 0.95 WHEN 0 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS r FROM g2))"""
_T = "list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_-]{2,}'), lambda x: lower(x)))"
_CONCEPTS = "list_filter([" + ", ".join(f"CASE WHEN list_has_any(t, [{', '.join(map(quoted, w))}]) THEN '{n}' END" for n, w in CONCEPTS.items()) + "], lambda x: x IS NOT NULL)"
ORACLE = {
    "rank_dedup_merge": f"""WITH {_H}, k AS (SELECT *, CASE quality WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END * 10 + least(n_chars // 1000, 6) AS key FROM h)
SELECT class, title, max(key) AS key, arg_max(doc_id, (key, -doc_id)) AS doc_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS merged FROM k GROUP BY 1, 2 ORDER BY key DESC, doc_id LIMIT 40""",
    "stratified_round_robin": "SELECT doc_id, source, turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) ORDER BY turn, source, n_chars DESC, doc_id LIMIT 50",
    "diversified_select": f"""WITH {_H}, n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n_chars DESC, doc_id) AS nth FROM h)
SELECT doc_id, class, CASE WHEN quality = 1 AND n_chars > 10000 THEN 0 WHEN nth = 1 THEN 1 ELSE 2 END AS tier FROM n ORDER BY tier, n_chars DESC, doc_id LIMIT 30""",
    "budget_prefix": "SELECT source, lang, count(*) AS n, max(used) AS used FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 40000 GROUP BY 1, 2",
    "budget_greedy": """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations WHERE text IS NOT NULL),
w(conv_id, i, used, n) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
  UNION ALL SELECT w.conv_id, o.i, CASE WHEN w.used + o.size <= 300 THEN w.used + o.size ELSE w.used END, CASE WHEN w.used + o.size <= 300 THEN w.n + 1 ELSE w.n END FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1)
SELECT conv_id, max(used) AS used, max(n) AS n FROM w GROUP BY 1""",
    "packed_turns": """WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations WHERE length(text) > 0),
steps AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pass, turn) AS nth FROM (SELECT *, 0 AS pass FROM t UNION ALL SELECT *, 1 AS pass FROM t)),
f AS (
  SELECT conv_id, 0::BIGINT AS nth, 0::BIGINT AS used, []::VARCHAR[] AS covered, []::BIGINT[] AS taken, NULL::BIGINT AS turn, NULL::VARCHAR AS role, NULL::BIGINT AS size, NULL::INT AS pass, false AS took FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, nth, CASE WHEN took THEN used + size ELSE used END, CASE WHEN took AND pass = 0 THEN list_append(covered, role) ELSE covered END, CASE WHEN took THEN list_append(taken, turn) ELSE taken END, turn, role, size, pass, took
  FROM (SELECT f.conv_id, s.nth, f.used, f.covered, f.taken, s.turn, s.role, s.size, s.pass, f.used + s.size <= 1500 AND NOT list_contains(f.taken, s.turn) AND (s.pass = 1 OR NOT list_contains(f.covered, s.role)) AS took
        FROM f JOIN steps s ON s.conv_id = f.conv_id AND s.nth = f.nth + 1))
SELECT conv_id, turn, role, size, CASE pass WHEN 0 THEN 'breadth' ELSE 'depth' END AS way, CAST(len(taken) AS INT) AS place, used FROM f WHERE took""",
    "upsert_corpus": """SELECT doc_id, coalesce(n.source, o.source) AS source, coalesce(n.n_chars, o.n_chars) AS n_chars, CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'kept' ELSE 'replaced' END AS state
FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) o FULL JOIN (SELECT doc_id, source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 3 = 0) n USING (doc_id)""",
    "gate_chain": f"WITH {_G} SELECT * FROM g",
    "status_buckets": f"WITH {_G} SELECT status, severity, count(*) AS n, round(avg(confidence), 4) AS confidence, min(doc_id) AS first_doc FROM g GROUP BY 1, 2",
    "severity_lookup": f"WITH {_H} SELECT source, arg_max({_SEV}, CASE class WHEN 'secret' THEN 3 WHEN 'contact' THEN 2 WHEN 'licensing' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM h GROUP BY 1",
    "fixture_score": f"""WITH {_H}, a AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS expected, count(*) FILTER (WHERE n_chars >= 500 AND toxic = 0) AS predicted, count(*) FILTER (WHERE quality = 1 AND n_chars >= 500 AND toxic = 0) AS "both"
FROM h WHERE quality IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce("both" / CAST(nullif(expected, 0) AS DOUBLE), 0.0) AS re, coalesce("both" / CAST(nullif(predicted, 0) AS DOUBLE), 0.0) AS pr FROM a)
SELECT lang, n, expected, predicted, "both", round(re, 4) AS recall, round(pr, 4) AS precision, round(60 * re + 40 * pr, 2) AS score FROM r""",
    "run_classify": f"""SELECT run_id, CASE WHEN timed_out THEN 'timeout' WHEN contains(lower(output), 'no tests found') THEN 'skipped' WHEN contains(lower(output), 'invariant violated') THEN 'invariant_violated'
WHEN contains(lower(output), 'assertion failed') THEN 'assertion_failed' WHEN contains(lower(output), 'revert') THEN 'reverted' WHEN code = 0 THEN 'held' ELSE 'runtime_error' END AS kind,
coalesce(TRY_CAST(regexp_extract(output, '([0-9]+) passed', 1) AS INT), 0) AS passed, coalesce(TRY_CAST(regexp_extract(output, '([0-9]+) failed', 1) AS INT), 0) AS failed, coalesce(TRY_CAST(regexp_extract(output, '([0-9]+) skipped', 1) AS INT), 0) AS skipped,
regexp_extract(output, 'Reason: ([^\\]]+)\\]', 1) AS reason FROM {values_sql(RUNS, 'run_id, code, output, timed_out')}""",
    "penalty_and_severity": """SELECT user_id, errors, least(40, errors * 8) AS penalty_percent, CASE WHEN errors >= 5 THEN 'high' WHEN errors >= 2 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)""",
    "research_status": f"""WITH {_H} SELECT class, CASE WHEN toxic = 1 THEN CASE WHEN regexp_matches(title, 'license|token') THEN 'rejected' ELSE 'needs_manual_review' END WHEN quality = 1 AND class <> 'prose' THEN 'confirmed' WHEN quality = 1 THEN 'likely'
WHEN quality = 0 THEN 'suspicious' ELSE 'needs_manual_review' END AS status, count(*) AS n FROM h GROUP BY 1, 2""",
    "mechanism_alignment": f"""WITH i AS (SELECT item_id, unnest({_CONCEPTS}) AS concept FROM (SELECT item_id, {_T} AS t FROM benchmark)),
d AS (SELECT source, concept, count(*) AS n FROM (SELECT source, unnest({_CONCEPTS}) AS concept FROM (SELECT source, {_T} AS t FROM documents)) GROUP BY 1, 2)
SELECT item_id, source, count(*) AS concepts, sum(n) AS n FROM i JOIN d USING (concept) GROUP BY 1, 2""",
    "keyword_recall": "SELECT CASE WHEN contains(lower(text), 'released under') THEN 'released under' WHEN contains(lower(text), 'token') THEN 'token' WHEN contains(lower(text), 'anea') THEN 'anea' END AS keyword, count(*) AS n, max(doc_id) AS last_doc FROM documents GROUP BY 1",
    "class_checklist": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, term) AS nth FROM (SELECT class, term, count(*) AS n FROM (SELECT {_CLASS} AS class, unnest({_T}) AS term FROM documents) GROUP BY 1, 2)) WHERE nth <= 10""",
    "dedup_variants": "SELECT key, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, count(*) AS n FROM (SELECT *, md5(split_part(text, chr(10), 1)) AS key FROM documents) GROUP BY 1",
    "hypothesis_union": f"""WITH {_H}, u AS (SELECT 'doc-' || doc_id AS id, class, CAST(NULL AS VARCHAR) AS event_type FROM h WHERE class = 'secret' UNION ALL SELECT 'event-' || event_id, NULL, event_type FROM events WHERE event_type = 'error')
SELECT class, event_type, count(*) AS n, min(id) AS first_id FROM u GROUP BY 1, 2""",
}
