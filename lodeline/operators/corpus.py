"""The corpus of findings: normalisation, scores, selection, freshness, and the evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import has_any, terms
from lodeline.sources import sample
from lodeline.sources.sample import quoted, values_sql

#: Terms of each class, in order.
CLASS_TERMS = (
    ("reentrancy", ("reentrancy", "external call", "cross-function")),
    ("oracle", ("oracle", "price manipulation", "stale price", "twap")),
    ("access_control", ("access control", "unauthorized", "onlyowner", "owner")),
    ("unchecked_transfer", ("unchecked", "transfer return", "safetransfer", "erc20")),
    ("upgradeability", ("upgrade", "proxy", "initializer", "storage collision")),
    ("flash_loan", ("flash loan", "flashloan")),
)
#: Groups of terms that state one intent.
INTENTS = (
    ("signature", "threshold", "signer", "duplicate", "uniqueness"), ("checkpoint", "lowerlookup", "upperlookup", "batch", "claim", "eligibility"), ("checkpoint", "boundary", "latest", "eligible", "index", "batch"),
    ("fee", "formula", "dimension", "shares", "assets", "d6", "d18"), ("report", "accrual", "handlereport", "performance", "protocol"), ("native", "receive", "fallback", "transfer"),
    ("whitelist", "cantransfer", "boolean", "inversion"), ("lockup", "transfer", "bypass", "shares"), ("index", "lookup", "tree", "off", "one", "fenwick", "cancel"),
)
#: Terms that raise a lexical candidate, what they and the class add, the least score and the most rows.
RARE_TERMS = ("checkpoint", "lowerlookup", "upperlookup", "fee", "native", "fallback", "fenwick", "lockup")
RARE, SAME_CLASS, LEAST_SCORE, MOST = 0.15, 0.10, 0.12, 20
IMPACT = (("HIGH", 0.15), ("MEDIUM", 0.08), ("LOW", 0.03))
CONTENT_CHARS, KEYWORD_CHARS, INTENT_CHARS, LABEL_CHARS = 20_000, 8000, 6000, 2000
AS_OF = "2026-01-01 00:00:00"
STALE_HOURS = 24

RAW_SCHEMA = "id string, slug string, title string, content string, summary string, impact string, quality_score double, general_score double, report_date string, protocol_name string, firm_name string, issues_issuetagscore array<struct<tags_tag:struct<title:string>>>, protocols_protocol struct<name:string,protocols_protocolcategoryscore:array<struct<protocols_protocolcategory:struct<title:string>>>>"
#: Raw findings as JSON lines.
RAW = (
    '{"id": "f1", "title": "Reentrant withdraw", "content": "An external call before the balance update allows reentrancy.", "summary": "reentrancy in withdraw", "impact": "HIGH", "quality_score": 4, "general_score": 3, "report_date": "2025-01-01T00:00:00Z", "issues_issuetagscore": [{"tags_tag": {"title": "Reentrancy"}}, {"tags_tag": {"title": "CEI"}}], "protocols_protocol": {"name": "Alpha", "protocols_protocolcategoryscore": [{"protocols_protocolcategory": {"title": "Lending"}}]}}',
    '{"id": "f2", "title": "Checkpoint batch claim", "content": "lowerLookup of the checkpoint skips the latest batch", "impact": "MEDIUM", "quality_score": 2, "general_score": 5, "report_date": "2023-06-01", "issues_issuetagscore": null, "protocols_protocol": {"name": "Beta"}}',
    '{"slug": "fee-formula", "title": "Fee formula mixes shares and assets", "content": "fee d6 d18 dimension", "impact": "LOW", "quality_score": 0, "general_score": 0, "report_date": null, "protocol_name": "Gamma", "issues_issuetagscore": [{"tags_tag": {"title": "Fee"}}, {"tags_tag": {}}]}',
    '{"title": "Owner can upgrade", "content": "", "quality_score": 1, "report_date": "soon"}',
    '{"id": "f5", "title": "Stale price of the oracle", "content": "native fallback transfer receive", "impact": "high", "quality_score": 9, "general_score": 1, "report_date": "2025-12-01"}',
)
#: query, text, class, tags, hints.
QUERIES_GIVEN = (
    (1, "reentrancy external call withdraw", "reentrancy", "reentrancy|cei", "lending"),
    (2, "checkpoint lowerLookup batch claim", "access_control", "", "beta"),
    (3, "fee formula dimension shares", "accounting", "fee", ""),
    (4, "native transfer fallback", None, "", "alpha|beta"),
)


def normalised(raw: DataFrame) -> DataFrame:
    """id, title, tags, categories, vulnerability_class, root_terms, search_text and scores of (value: JSON).

    The id is the first of id, slug and title. The class is the first of CLASS_TERMS of which the text or tags hold a
    term; without one, manual_review with the first twelve words as roots.
    """
    r = raw.select(F.from_json("value", RAW_SCHEMA).alias("r")).select("r.*")
    named = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    tags = named(F.transform("issues_issuetagscore", lambda x: x["tags_tag"]["title"]))
    categories = named(F.transform("protocols_protocol.protocols_protocolcategoryscore", lambda x: x["protocols_protocolcategory"]["title"]))
    r = r.withColumn("tags", tags).withColumn("categories", categories)
    parts = F.array(*(F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("summary"), F.substring("content", 1, CONTENT_CHARS), F.array_join("tags", " "), F.array_join("categories", " "), F.col("protocol_name"), F.col("firm_name"))))
    r = r.withColumn("search_text", F.array_join(F.filter(parts, lambda x: x != ""), "\n"))
    hay = F.lower(F.concat_ws(" ", "search_text", F.array_join("tags", " ")))
    kinds = [(k, F.filter(F.array(*map(F.lit, ts)), lambda t: hay.contains(t))) for k, ts in CLASS_TERMS]
    kind = F.coalesce(*(F.when(F.size(found) > 0, F.lit(k)) for k, found in kinds), F.lit("manual_review"))
    words = F.slice(F.regexp_extract_all(hay, F.lit(r"[a-zA-Z][a-zA-Z0-9_-]{3,}"), F.lit(0)), 1, 12)
    roots = F.array_sort(F.array_distinct(F.coalesce(*(F.when(F.size(found) > 0, found) for _, found in kinds), words)))
    return r.select(
        F.coalesce(F.nullif("id", F.lit("")), F.nullif("slug", F.lit("")), "title").alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled finding")).alias("title"), "summary", "impact", "report_date",
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("general_score", F.lit(0.0)).alias("general_score"), F.coalesce("protocol_name", "protocols_protocol.name").alias("protocol_name"),
        "tags", "categories", kind.alias("vulnerability_class"), roots.alias("root_terms"), "search_text",
    )


def quality_recency(as_of: str = AS_OF) -> Column:
    """Quality of five, impact, and 0.15 that decays by a third of e a year of age; dates without a zone are UTC."""
    days = F.datediff(F.to_timestamp(F.lit(as_of)), F.try_to_timestamp("report_date"))
    recency = F.coalesce(0.15 * F.exp(-F.greatest(F.lit(0.0), days / 365.0) / 3), F.lit(0.0))
    impact = F.coalesce(*(F.when(F.upper("impact") == k, F.lit(v)) for k, v in IMPACT), F.lit(0.0))
    return F.least(F.lit(1.0), F.least(F.lit(1.0), F.greatest("quality_score", "general_score") / 5.0) + impact + recency)


def finding_scores(findings: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id and the partial scores of each finding for each of a few given queries (query, text, class, tags, hints)."""
    text = lambda *cs: terms(F.concat_ws(" ", *cs))
    roots = F.array_join("root_terms", " ")
    f = findings.withColumn("held", text("title", F.array_join("tags", " "), roots, F.substring("search_text", 1, KEYWORD_CHARS))).withColumn("intent_terms", text("title", F.coalesce("summary", F.lit("")), roots, F.substring("search_text", 1, INTENT_CHARS)))
    f = f.withColumn("protocol", F.lower(F.concat_ws(" ", F.coalesce("protocol_name", F.lit("")), F.array_join("categories", " ")))).withColumn("quality", quality_recency())
    q = queries.withColumn("wanted", terms(F.col("text")))
    both = f.join(F.broadcast(q), F.lit(True))  # the given queries are a handful of rows
    keyword = F.least(F.lit(1.0), F.size(F.array_intersect("wanted", "held")) / F.greatest(F.lit(4), F.size("wanted")))
    tags = F.size(F.array_intersect(F.array_distinct(F.transform("query_tags", F.lower)), F.array_distinct(F.transform("tags", F.lower))))
    hinted = F.exists("hints", lambda h: F.col("protocol").contains(F.lower(h)))
    same = F.when(F.col("query_class") == F.col("vulnerability_class"), 0.55).otherwise(0.0) + F.least(F.lit(0.25), 0.08 * tags) + F.when(hinted, 0.20).otherwise(0.0)
    intent = F.lit(0.0)
    for group in INTENTS:
        words = F.array(*map(F.lit, group))
        intent = F.greatest(intent, F.when(F.arrays_overlap("wanted", words), F.size(F.array_intersect("intent_terms", words)) / F.lit(float(len(group)))).otherwise(0.0))
    return both.select("query", "id", keyword.alias("keyword"), F.least(F.lit(1.0), same).alias("class_score"), intent.alias("pattern"), F.col("quality").alias("quality"))


def lexical_candidates(findings: DataFrame, queries: DataFrame, most: int = MOST) -> DataFrame:
    """query, id, score, rank: findings that share terms with a query, raised by rare terms and by its class."""
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), F.array_join("tags", " "), F.array_join("root_terms", " "), F.array_join("categories", " "), F.substring("search_text", 1, INTENT_CHARS))
    held = findings.select("id", "vulnerability_class", F.explode(terms(text)).alias("term"))
    q = queries.withColumn("wanted", terms(F.concat_ws(" ", "text", F.coalesce("query_class", F.lit("")), F.array_join("query_tags", " "), F.array_join("hints", " "))))
    wanted = q.select("query", "query_class", F.size("wanted").alias("n"), F.explode("wanted").alias("term"))
    met = held.join(wanted, "term").groupBy("query", "id", "query_class", "vulnerability_class", "n").agg(F.count("*").alias("hits"), F.max(F.col("term").isin(*RARE_TERMS)).alias("rare"))
    score = F.col("hits") / F.greatest(F.lit(5), F.col("n")) + F.when(F.col("rare"), RARE).otherwise(0.0) + F.when(F.col("query_class") == F.col("vulnerability_class"), SAME_CLASS).otherwise(0.0)
    ranked = met.withColumn("score", score).where(F.col("score") >= LEAST_SCORE).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= most).select("query", "id", "score", "rank")


def targeted_corpus(fetched: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows of both by ``key``; where both have one, the selected wins."""
    return selected.unionByName(fetched.join(selected.select(key), key, "left_anti"))


def freshness(states: DataFrame, as_of: str = AS_OF, stale_hours: int = STALE_HOURS) -> DataFrame:
    """state, fresh, action of (state, synced_at, has_index, n_findings, has_key, failed, stale_ok).

    A fresh index is used; without a key the cache serves, if there is one; a failed sync falls back on it if stale
    data may serve.
    """
    age = F.to_timestamp(F.lit(as_of)).cast("long") - F.try_to_timestamp("synced_at").cast("long")
    fresh = F.coalesce(F.col("has_index") & (age < stale_hours * 3600), F.lit(False))
    cached = F.col("n_findings") > 0
    action = F.when(F.col("stale_ok") & fresh & cached, "use cache").when(~F.col("has_key"), F.when(cached, "skip").otherwise("unavailable")).when(~F.col("failed"), "sync").when(F.col("stale_ok") & cached, "use stale cache").otherwise("unavailable")
    return states.select("state", fresh.alias("fresh"), action.alias("action"))


def labelled(matches: DataFrame) -> DataFrame:
    """``matches`` with label and strict: exact ids where a query gives some, else by class or by shared expected terms."""
    classes = F.array_union(F.array(F.lower("found_class")), F.transform("found_tags", F.lower))
    expected = terms(F.array_join("expected_terms", " "))
    weak = F.arrays_overlap(F.transform("expected_classes", F.lower), classes) | (F.size(F.array_intersect(expected, terms(F.substring("found_text", 1, LABEL_CHARS)))) >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(expected))))
    strict = F.size("relevant") > 0
    return matches.withColumn("strict", strict).withColumn("label", F.when(strict, F.array_contains("relevant", F.col("found"))).otherwise(weak).cast("int")).withColumn("overlap", F.coalesce(F.try_divide(F.size(F.array_intersect(expected, terms(F.substring("found_text", 1, LABEL_CHARS)))), F.size(expected)), F.lit(0.0)))


def query_metrics(rows: DataFrame) -> DataFrame:
    """query, precision at 5, recall at 5 and 10 (of the given ids, else a hit rate), overlap at 10."""
    upto = lambda k, c: F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col(c))), F.lit(0))
    found = rows.groupBy("query").agg(upto(5, "label").alias("l5"), upto(10, "label").alias("l10"), F.avg(F.when(F.col("rank") <= 10, F.col("overlap"))).alias("overlap10"), F.max(F.when(F.col("strict"), F.size("relevant"))).alias("given"), F.max("label").alias("any"))
    total = F.coalesce("given", F.lit(1))
    return found.select("query", (F.col("l5") / 5).alias("precision5"), F.least(F.lit(1.0), F.col("l5") / total).alias("recall5"), F.least(F.lit(1.0), F.col("l10") / total).alias("recall10"), F.col("overlap10"))


def best_models(results: DataFrame) -> DataFrame:
    """best_by, model, score: of (model, recall10, class_rate, safe_rate, latency_ms), by recall, latency and balanced score; ties to the first by name."""
    balanced = F.greatest(F.lit(0.0), 0.45 * F.col("recall10") + 0.25 * F.col("class_rate") + 0.20 * F.col("safe_rate") - 0.10 * F.least(F.lit(1.0), F.col("latency_ms") / 5000.0))
    scored = results.withColumn("balanced", balanced)
    keys = {"recall": F.col("recall10"), "latency": -F.col("latency_ms"), "balanced": F.col("balanced")}
    picks = F.array(*(F.struct(F.lit(name).alias("best_by"), score.alias("score")) for name, score in keys.items()))
    ranked = scored.select("model", F.explode(picks).alias("p")).withColumn("nth", F.row_number().over(Window.partitionBy("p.best_by").orderBy(F.desc("p.score"), "model")))
    return ranked.where("nth = 1").select("p.best_by", "model", "p.score")


def index_name(prefix: str, model: Column) -> Column:
    """prefix_slug of a model's name, of at most 63 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(F.lit(f"{prefix}_"), slug), 1, 63)


def findings(spark: SparkSession) -> DataFrame:
    return normalised(spark.createDataFrame([(r,) for r in RAW], "value string"))


def given_queries(spark: SparkSession) -> DataFrame:
    listed = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "").alias(f"{c}")
    return spark.createDataFrame(QUERIES_GIVEN, "query int, text string, query_class string, query_tags string, hints string").select("query", "text", "query_class", listed("query_tags"), listed("hints"))


#: state, synced_at, has_index, n_findings, has_key, failed, stale_ok.
STATES = (
    (1, "2025-12-31 12:00:00", True, 10, True, False, True), (2, "2025-12-30 00:00:00", True, 10, True, False, True), (3, "2025-12-30 00:00:00", True, 10, False, False, True), (4, None, True, 0, False, False, True),
    (5, "2025-12-01 00:00:00", True, 5, True, True, True), (6, "2025-12-01 00:00:00", True, 5, True, True, False), (7, "broken", False, 5, True, False, True), (8, "2025-12-31 23:00:00", False, 5, True, False, True),
)
#: query, rank, found, class, tags, text, relevant ids, expected classes, expected terms.
MATCHES = (
    (1, 1, "a", "oracle", "", "stale price feed", "a|c", "", ""), (1, 2, "b", "oracle", "", "x", "a|c", "", ""), (1, 6, "c", "oracle", "", "x", "a|c", "", ""),
    (2, 1, "a", "Oracle", "", "stale price feed", "", "oracle", "stale price"), (2, 2, "b", "fee", "x|ORACLE", "nothing", "", "oracle", "stale price"), (2, 3, "c", "fee", "", "stale price twice", "", "oracle", "stale price"), (2, 4, "d", "fee", "", "stale only", "", "oracle", "stale price"),
    (3, 1, "z", "fee", "", "nothing here", "", "", "rounding"), (3, 11, "y", "fee", "", "rounding", "", "", "rounding"), (4, 1, "q", "fee", "", "text", "", "", ""),
)
#: model, recall at 10, class rate, safe rate, latency.
MODELS = (("small-en", 0.6, 0.5, 0.4, 40.0), ("base-en", 0.8, 0.5, 0.5, 900.0), ("large-en", 0.8, 0.7, 0.6, 7000.0), ("BAAI/bge--Large en v1.5 with a very long name that does not fit into sixty", 0.1, 0.0, 0.0, 9000.0))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles differ in their last bits from engine to engine."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def q_normalize_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark).select("id", "title", "protocol_name", F.array_join("tags", "|").alias("tags"), F.array_join("categories", "|").alias("categories"), "vulnerability_class", F.array_join("root_terms", "|").alias("root_terms"), F.md5("search_text").alias("search_md5"))


def q_finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(finding_scores(findings(spark), given_queries(spark)), "keyword", "class_score", "pattern", "quality")


def q_lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical_candidates(findings(spark), given_queries(spark)), "score")


def q_targeted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every third id as fetched, labelled ones as selected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    selected = docs.join(labels, "doc_id", "left_semi").withColumn("of", F.lit("selected"))
    return targeted_corpus(docs.where("doc_id % 3 = 0").withColumn("of", F.lit("fetched")), selected, "doc_id")


def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(spark.createDataFrame(STATES, "state int, synced_at string, has_index boolean, n_findings int, has_key boolean, failed boolean, stale_ok boolean"))


def q_retrieval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "").alias(c)
    rows = spark.createDataFrame(MATCHES, "query int, rank int, found string, found_class string, found_tags string, found_text string, relevant string, expected_classes string, expected_terms string")
    rows = rows.select("query", "rank", "found", "found_class", listed("found_tags"), "found_text", listed("relevant"), listed("expected_classes"), listed("expected_terms"))
    return _rounded(query_metrics(labelled(rows)), "precision5", "recall5", "recall10", "overlap10")


def q_best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(best_models(spark.createDataFrame(MODELS, "model string, recall10 double, class_rate double, safe_rate double, latency_ms double")), "score")


def q_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m[0],) for m in MODELS], "model string").select("model", index_name("findings", F.col("model")).alias("index_name"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}

_ALIAS = "list_distinct(list_concat(t, CASE WHEN list_has_any(t, ['lowerlookup','lower','lookup']) THEN ['lowerlookup'] ELSE [] END, CASE WHEN list_has_any(t, ['upperlookup','upperlookuprecent','upper','latest']) THEN ['upperlookup'] ELSE [] END, CASE WHEN list_has_any(t, ['handlereport','reports','report']) THEN ['handlereport'] ELSE [] END, CASE WHEN list_has_any(t, ['cantransfer','whitelist','allow','allowed']) THEN ['cantransfer'] ELSE [] END))"


def _terms_sql(text: str) -> str:
    return f"(SELECT {_ALIAS} FROM (SELECT list_distinct(regexp_extract_all(lower({text}), '[a-z][a-z0-9_-]{{2,}}')) AS t))"


def _array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


_KINDS = " ".join(f"WHEN len(list_filter({_array(ts)}, lambda t: contains(hay, t))) > 0 THEN {quoted(k)}" for k, ts in CLASS_TERMS)
_ROOTS = " ".join(f"WHEN len(list_filter({_array(ts)}, lambda t: contains(hay, t))) > 0 THEN list_filter({_array(ts)}, lambda t: contains(hay, t))" for _, ts in CLASS_TERMS)
_FINDINGS = f"""raw AS (SELECT CAST(value AS JSON) AS j FROM {values_sql([(r,) for r in RAW], "value")}),
r0 AS (
  SELECT j->>'id' AS id0, j->>'slug' AS slug, j->>'title' AS title, j->>'summary' AS summary, j->>'content' AS content, j->>'impact' AS impact, j->>'report_date' AS report_date, j->>'protocol_name' AS named, j->>'firm_name' AS firm,
         coalesce(CAST(j->>'quality_score' AS DOUBLE), 0) AS quality_score, coalesce(CAST(j->>'general_score' AS DOUBLE), 0) AS general_score, coalesce(j->>'protocol_name', j->'protocols_protocol'->>'name') AS protocol_name,
         list_sort(list_distinct(list_filter(coalesce(j->>'$.issues_issuetagscore[*].tags_tag.title', []), lambda x: x IS NOT NULL))) AS tags,
         list_sort(list_distinct(list_filter(coalesce(j->>'$.protocols_protocol.protocols_protocolcategoryscore[*].protocols_protocolcategory.title', []), lambda x: x IS NOT NULL))) AS categories FROM raw),
r1 AS (SELECT *, array_to_string(list_filter([coalesce(title, ''), coalesce(summary, ''), left(coalesce(content, ''), {CONTENT_CHARS}), array_to_string(tags, ' '), array_to_string(categories, ' '), coalesce(named, ''), coalesce(firm, '')], lambda x: x <> ''), chr(10)) AS search_text FROM r0),
r2 AS (SELECT *, lower(search_text || ' ' || array_to_string(tags, ' ')) AS hay FROM r1),
f AS (SELECT *, coalesce(id0, slug, title) AS id, CASE {_KINDS} ELSE 'manual_review' END AS vulnerability_class,
        list_sort(list_distinct(CASE {_ROOTS} ELSE list_slice(regexp_extract_all(hay, '[a-zA-Z][a-zA-Z0-9_-]{{3,}}'), 1, 12) END)) AS root_terms FROM r2),
q AS (SELECT query, text, query_class, CASE WHEN query_tags = '' THEN [] ELSE string_split(query_tags, '|') END AS query_tags, CASE WHEN hints = '' THEN [] ELSE string_split(hints, '|') END AS hints FROM {values_sql(QUERIES_GIVEN, "query, text, query_class, query_tags, hints")})"""
_INTENT = "greatest(" + ", ".join(f"CASE WHEN list_has_any(wanted, {_array(g)}) THEN len(list_intersect(intent_terms, {_array(g)})) / {float(len(g))} ELSE 0.0 END" for g in INTENTS) + ")"
_LABELS = f"""m0 AS (SELECT query, rank, found, found_class, list_filter(string_split(found_tags, '|'), lambda x: x <> '') AS found_tags, found_text, list_filter(string_split(relevant, '|'), lambda x: x <> '') AS relevant,
  list_filter(string_split(expected_classes, '|'), lambda x: x <> '') AS expected_classes, replace(expected_terms, '|', ' ') AS expected FROM {values_sql(MATCHES, "query, rank, found, found_class, found_tags, found_text, relevant, expected_classes, expected_terms")}),
m1 AS (SELECT *, {_terms_sql("expected")} AS e, {_terms_sql(f"left(found_text, {LABEL_CHARS})")} AS g FROM m0),
m AS (SELECT *, len(relevant) > 0 AS strict, CAST(CASE WHEN len(relevant) > 0 THEN list_contains(relevant, found)
  ELSE list_has_any(list_transform(expected_classes, lambda x: lower(x)), list_concat([lower(found_class)], list_transform(found_tags, lambda x: lower(x)))) OR len(list_intersect(e, g)) >= least(2, greatest(1, len(e))) END AS INT) AS label,
  CASE WHEN len(e) = 0 THEN 0.0 ELSE len(list_intersect(e, g)) / CAST(len(e) AS DOUBLE) END AS overlap FROM m1)"""
_BALANCED = "greatest(0.0, CAST(0.45 AS DOUBLE) * recall10 + CAST(0.25 AS DOUBLE) * class_rate + CAST(0.20 AS DOUBLE) * safe_rate - CAST(0.10 AS DOUBLE) * least(1.0, latency_ms / 5000.0))"
ORACLE = {
    "normalize_finding": f"WITH {_FINDINGS} SELECT id, coalesce(nullif(title, ''), 'Untitled finding') AS title, protocol_name, array_to_string(tags, '|') AS tags, array_to_string(categories, '|') AS categories, vulnerability_class, array_to_string(root_terms, '|') AS root_terms, md5(search_text) AS search_md5 FROM f",
    "finding_scores": f"""WITH {_FINDINGS},
x AS (SELECT f.*, {_terms_sql(f"f.title || ' ' || array_to_string(f.tags, ' ') || ' ' || array_to_string(f.root_terms, ' ') || ' ' || left(f.search_text, {KEYWORD_CHARS})")} AS held,
        {_terms_sql(f"f.title || ' ' || coalesce(f.summary, '') || ' ' || array_to_string(f.root_terms, ' ') || ' ' || left(f.search_text, {INTENT_CHARS})")} AS intent_terms, lower(coalesce(f.protocol_name, '') || ' ' || array_to_string(f.categories, ' ')) AS protocol FROM f),
w AS (SELECT q.*, {_terms_sql("q.text")} AS wanted FROM q)
SELECT query, id, least(1.0, len(list_intersect(wanted, held)) / CAST(greatest(4, len(wanted)) AS DOUBLE)) AS keyword,
  least(1.0, CASE WHEN query_class = vulnerability_class THEN 0.55 ELSE 0.0 END + least(0.25, 0.08 * len(list_intersect(query_tags, list_transform(tags, lambda t: lower(t))))) + CASE WHEN len(list_filter(hints, lambda h: contains(protocol, h))) > 0 THEN 0.20 ELSE 0.0 END) AS class_score,
  {_INTENT} AS pattern,
  least(1.0, least(1.0, greatest(quality_score, general_score) / 5.0) + CASE upper(impact) WHEN 'HIGH' THEN 0.15 WHEN 'MEDIUM' THEN 0.08 WHEN 'LOW' THEN 0.03 ELSE 0.0 END
    + coalesce(0.15 * exp(-greatest(0.0, date_diff('day', TRY_CAST(left(report_date, 10) AS DATE), DATE '2026-01-01') / 365.0) / 3), 0.0)) AS quality
FROM x CROSS JOIN w""",
    "lexical_candidates": f"""WITH {_FINDINGS},
x AS (SELECT id, vulnerability_class, {_terms_sql(f"title || ' ' || coalesce(summary, '') || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(root_terms, ' ') || ' ' || array_to_string(categories, ' ') || ' ' || left(search_text, {INTENT_CHARS})")} AS held FROM f),
w AS (SELECT query, query_class, {_terms_sql("text || ' ' || coalesce(query_class, '') || ' ' || array_to_string(query_tags, ' ') || ' ' || array_to_string(hints, ' ')")} AS wanted FROM q),
s AS (SELECT query, id, len(list_intersect(wanted, held)) AS hits, len(list_intersect(wanted, held)) / CAST(greatest(5, len(wanted)) AS DOUBLE) + CASE WHEN list_has_any(list_intersect(wanted, held), {_array(RARE_TERMS)}) THEN {RARE} ELSE 0.0 END + CASE WHEN query_class = vulnerability_class THEN {SAME_CLASS} ELSE 0.0 END AS score FROM x CROSS JOIN w)
SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE hits > 0 AND score >= {LEAST_SCORE}) WHERE rank <= {MOST}""",
    "targeted_corpus": """SELECT doc_id, source, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'selected' ELSE 'fetched' END AS of FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR doc_id % 3 = 0""",
    "freshness": f"""SELECT state, fresh, CASE WHEN stale_ok AND fresh AND n_findings > 0 THEN 'use cache' WHEN NOT has_key THEN CASE WHEN n_findings > 0 THEN 'skip' ELSE 'unavailable' END WHEN NOT failed THEN 'sync' WHEN stale_ok AND n_findings > 0 THEN 'use stale cache' ELSE 'unavailable' END AS action
FROM (SELECT *, coalesce(has_index AND epoch(TIMESTAMP '{AS_OF}') - epoch(TRY_CAST(synced_at AS TIMESTAMP)) < {STALE_HOURS * 3600}, false) AS fresh FROM {values_sql(STATES, "state, synced_at, has_index, n_findings, has_key, failed, stale_ok")})""",
    "retrieval_labels": f"""WITH {_LABELS},
a AS (SELECT query, coalesce(sum(label) FILTER (WHERE rank <= 5), 0) AS l5, coalesce(sum(label) FILTER (WHERE rank <= 10), 0) AS l10, avg(overlap) FILTER (WHERE rank <= 10) AS overlap10, coalesce(max(CASE WHEN strict THEN len(relevant) END), 1) AS total FROM m GROUP BY query)
SELECT query, l5 / 5.0 AS precision5, least(1.0, l5 / CAST(total AS DOUBLE)) AS recall5, least(1.0, l10 / CAST(total AS DOUBLE)) AS recall10, overlap10 FROM a""",
    "best_models": f"""WITH s AS (SELECT *, {_BALANCED} AS balanced FROM {values_sql(MODELS, "model, recall10, class_rate, safe_rate, latency_ms")}),
p AS (SELECT 'recall' AS best_by, model, CAST(recall10 AS DOUBLE) AS score FROM s UNION ALL SELECT 'latency', model, -latency_ms FROM s UNION ALL SELECT 'balanced', model, balanced FROM s)
SELECT best_by, model, score FROM (SELECT *, row_number() OVER (PARTITION BY best_by ORDER BY score DESC, model) AS nth FROM p) WHERE nth = 1""",
    "index_names": f"""SELECT model, left('findings_' || trim(regexp_replace(lower(model), '[^a-z0-9]+', '_', 'g'), '_'), 63) AS index_name FROM {values_sql([(m[0],) for m in MODELS], "model")}""",
}
ORACLE |= {name: sample.doubles(ORACLE[name], *columns) for name, columns in {"finding_scores": ("keyword", "class_score", "pattern", "quality",), "lexical_candidates": ("score",), "retrieval_labels": ("precision5", "recall5", "recall10", "overlap10",), "best_models": ("score",)}.items()}
