"""Callers, loops, gaps, evidence packets and selections made of other operators' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.operators.judge import _H, hypotheses
from lodeline.operators.retrieve import _SCORED, scored_matches
from lodeline.plans.shared import materialise
from lodeline.sources import lines as L
from lodeline.sources import sample

KEYS = ["repo", "file_path"]
#: Terms of a phase change, and of a fee.
PHASES = ("initialize", "pause", "deposit", "withdraw", "claim", "mint", "burn")


def callers(sources: DataFrame) -> DataFrame:
    """(caller, callee) pairs of a repository: functions whose body names another function.

    A name's mentions and its declaration, which has no caller, meet in one group.
    """
    named = F.flatten(F.transform("body", lambda raw: F.regexp_extract_all(L.strip_comment(raw), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))))
    mentions = F.transform(F.array_distinct(named), lambda w: F.struct(w.alias("callee"), F.col("function_name").alias("caller")))
    declared = F.struct(F.col("function_name").alias("callee"), F.lit(None).cast("string").alias("caller"))
    words = L.bodies(sources).select("repo", F.explode(F.concat(mentions, F.array(declared))).alias("x")).select("repo", "x.*")
    met = words.groupBy("repo", "callee").agg(F.collect_set("caller").alias("callers"), F.bool_or(F.col("caller").isNull()).alias("declared")).where("declared")
    return met.select("repo", F.explode("callers").alias("caller"), "callee").where("caller <> callee")


def loop_extents(sources: DataFrame) -> DataFrame:
    """Loops with their first and last line: the first later line at which the braces are back where they were."""
    depths = L.nesting_ranges(L.to_lines(sources), KEYS)
    loops = depths.where(F.col("raw").rlike(r"^\s*(for|while)\s*\(")).select(*KEYS, F.col("line_no").alias("start_line"), F.col("depth_before").alias("outer"))
    after = depths.select(*KEYS, "line_no", "depth_after")
    joined = loops.join(after, KEYS).where("line_no >= start_line and depth_after <= outer")
    return joined.groupBy(*KEYS, "start_line").agg(F.min("line_no").alias("end_line"))


def q_caller_mentions(spark, sf_dir):
    return callers(sample.repositories(spark, sf_dir))


def q_loop_extent(spark, sf_dir):
    return loop_extents(sample.repositories(spark, sf_dir))


def q_domain_facts(spark, sf_dir):
    lines = L.to_lines(sample.repositories(spark, sf_dir)).withColumn("low", F.lower(L.strip_comment(F.col("raw"))))
    phase = F.lit(False)
    for word in PHASES:
        phase |= F.contains("low", F.lit(word))
    return lines.groupBy(*KEYS).agg(F.count_if(phase).alias("phases"), F.count_if(F.col("low").rlike(r"fee\w*\s*[=*/]|[*/]\s*\w*fee")).alias("fees"), F.count_if(F.contains("low", F.lit("payable"))).alias("native"))


def q_gap_hunters(spark, sf_dir):
    """Conversations in which a user speaks last: nobody answered."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("answered"))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked"), F.count("*").alias("questions"))
    return asked.join(answers, "conv_id", "left").where("answered is null or answered < asked").select("conv_id", "asked", "questions")


def q_two_tier_telemetry(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct().withColumn("targeted", F.lit(1))
    found = scored_matches(spark, sf_dir, 10).join(labels, "doc_id", "left")
    return found.groupBy("query_id").agg(F.count("*").alias("raw"), F.count("targeted").alias("targeted"), F.max("score").alias("top_score"))


def q_select_global(spark, sf_dir):
    """The first 25 distinct documents over all items: by item, then rank."""
    best = scored_matches(spark, sf_dir, 3).groupBy("doc_id").agg(F.min(F.struct("query_id", "rank")).alias("at"))
    return best.orderBy("at.query_id", "at.rank", "doc_id").limit(25).select("doc_id", F.col("at.query_id").alias("query_id"), F.col("at.rank").alias("rank"))


def q_known_bug_compare(spark, sf_dir):
    """The best match of each item as a line of text."""
    best = scored_matches(spark, sf_dir, 1).join(hypotheses(spark, sf_dir).select("doc_id", "class", "title").withColumnRenamed("class", "kind"), "doc_id")
    return best.select("query_id", F.concat(F.lit("["), "kind", F.lit("] "), "title", F.lit(" :: "), F.col("hits").cast("string")).alias("line"))


def q_evidence_assembly(spark, sf_dir):
    """The first eight documents of each class and source as evidence, one a title."""
    rows = hypotheses(spark, sf_dir)
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("class", "source", "title").orderBy("doc_id"))).where("nth = 1")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("class", "source").orderBy("doc_id"))).where("place <= 8")
    return ranked.groupBy("class", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("evidence"), F.count("*").alias("n"))


def q_proof_packets(spark, sf_dir):
    """Obligations of each class that some document meets: long, labelled, clean."""
    rows = materialise(hypotheses(spark, sf_dir).select("class", "n_chars", "quality", "toxic"), "hypotheses")
    met = F.filter(F.array(*(F.when(F.max(c.cast("int")) == 1, F.lit(n)) for n, c in (("long", F.col("n_chars") > 5000), ("labelled", F.coalesce(F.col("quality") == 1, F.lit(False))), ("clean", F.coalesce(F.col("toxic") == 0, F.lit(False)))))), lambda x: x.isNotNull())
    return rows.groupBy("class").agg(F.array_join(met, ",").alias("met"), F.count("*").alias("n"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "caller_mentions": f"""WITH {sample.LINES_SQL}, w AS (SELECT DISTINCT r.repo, r.function_name AS caller, unnest(list_transform(regexp_extract_all(c.code, '[A-Za-z_][A-Za-z0-9_]*\\s*\\('), lambda x: regexp_extract(x, '^[A-Za-z0-9_]+', 0))) AS callee
  FROM ranges r JOIN code c ON c.repo = r.repo AND c.file_path = r.file_path AND c.line_no BETWEEN r.start_line AND r.end_line)
SELECT DISTINCT w.repo, caller, callee FROM w JOIN ranges x ON x.repo = w.repo AND x.function_name = w.callee WHERE caller <> callee""",
    "loop_extent": f"""WITH {sample.LINES_SQL} SELECT d.repo, d.file_path, d.line_no AS start_line, min(e.line_no) AS end_line FROM depths d JOIN depths e ON e.repo = d.repo AND e.file_path = d.file_path AND e.line_no >= d.line_no AND e.depth_after <= d.depth_after - d.delta
WHERE regexp_matches(d.raw, '^\\s*(for|while)\\s*\\(') GROUP BY ALL""",
    "domain_facts": f"""WITH {sample.LINES_SQL} SELECT repo, file_path, count(*) FILTER (WHERE regexp_matches(lower(code), '{"|".join(PHASES)}')) AS phases, count(*) FILTER (WHERE regexp_matches(lower(code), 'fee\\w*\\s*[=*/]|[*/]\\s*\\w*fee')) AS fees,
count(*) FILTER (WHERE contains(lower(code), 'payable')) AS native FROM code GROUP BY ALL""",
    "gap_hunters": """SELECT conv_id, asked, questions FROM (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS asked, count(*) FILTER (WHERE role = 'user') AS questions, max(turn) FILTER (WHERE role = 'assistant') AS answered FROM conversations GROUP BY 1)
WHERE asked IS NOT NULL AND (answered IS NULL OR answered < asked)""",
    "two_tier_telemetry": f"WITH {_SCORED} SELECT query_id, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS targeted, max(score) AS top_score FROM r WHERE rank <= 10 GROUP BY 1",
    "select_global": f"WITH {_SCORED} SELECT doc_id, min((query_id, rank))[1] AS query_id, min((query_id, rank))[2] AS rank FROM r WHERE rank <= 3 GROUP BY 1 ORDER BY 2, 3, 1 LIMIT 25",
    "known_bug_compare": f"WITH {_SCORED}, {_H} SELECT query_id, '[' || h.class || '] ' || title || ' :: ' || hits AS line FROM r JOIN h USING (doc_id) WHERE rank = 1",
    "evidence_assembly": f"""WITH {_H}, o AS (SELECT class, source, title, min(doc_id) AS doc_id FROM h GROUP BY 1, 2, 3), p AS (SELECT *, row_number() OVER (PARTITION BY class, source ORDER BY doc_id) AS place FROM o)
SELECT class, source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS evidence, count(*) AS n FROM p WHERE place <= 8 GROUP BY 1, 2""",
    "proof_packets": f"""WITH {_H} SELECT class, concat_ws(',', CASE WHEN bool_or(n_chars > 5000) THEN 'long' END, CASE WHEN bool_or(coalesce(quality = 1, false)) THEN 'labelled' END, CASE WHEN bool_or(coalesce(toxic = 0, false)) THEN 'clean' END) AS met, count(*) AS n FROM h GROUP BY 1""",
}
