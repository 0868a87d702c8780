"""Scans, predicates and extraction over the lines and paths of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions import text as X
from lodeline.sources import lines as L
from lodeline.sources import sample

#: Ordered kinds of a line and the patterns that begin them.
STATEMENTS = (("blank", r"^\s*$"), ("list", r"\|"), ("license", "(?i)license"), ("symbolic", r"[#*$%&]{3}"), ("contact", r"@|\+[0-9]"), ("quoted", r'"|='), ("sentence", r"\.\s*$"))
#: Words by topic, in order.
VOCABULARY = ("license", "token", "que", "the", "der", "les", "password", "contact")
DOMAINS = {"english": ("the", "and", "that", "with"), "german": ("der", "und", "die", "nicht"), "french": ("les", "une", "pour", "dans"), "spanish": ("que", "los", "para", "una")}
LICENSE_TERMS = ("license", "copyright", "licensed")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def statement_kind(line: Column) -> Column:
    kind = F.lit(None)
    for name, pattern in reversed(STATEMENTS):
        kind = F.when(line.rlike(pattern), name).otherwise(kind)
    return F.coalesce(kind, F.lit("fragment"))


def search_lines(lines: DataFrame, query: str, key: str, most: int) -> DataFrame:
    """The first lines, by key and number, that hold the query in any case."""
    return lines.where(F.contains(F.lower("raw"), F.lit(query.lower()))).orderBy(key, "line_no").limit(most)


def doc_carry(lines: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Each function line with the last ``most`` documentation lines that stand right before it."""
    doc = F.trim("raw").rlike("^(///|/\\*\\*|\\*)")
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines.withColumn("doc", doc).withColumn("group", F.sum(F.when(F.col("doc"), 0).otherwise(1)).over(w))
    grouped = Window.partitionBy(*keys, "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marked.withColumn("pending", F.collect_list(F.when(F.col("doc"), F.trim("raw"))).over(grouped)).withColumn("carried", F.lag("pending").over(w))
    names = held.where(~F.col("doc") & F.col("raw").rlike(L.DECLARED_FUNCTION))
    last = F.when(F.size("carried") > most, F.slice("carried", -most, most)).otherwise(F.col("carried"))
    return names.where(F.size("carried") > 0).select(*keys, "line_no", F.array_join(last, " ").alias("claim"))


def domain_argmax(terms: Column, hints: dict[str, tuple[str, ...]]) -> Column:
    """The first domain with the most hints among the terms; unknown if none has any."""
    hits = F.array(*(F.struct(F.size(F.array_intersect(terms, F.array(*map(F.lit, words)))).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, words) in enumerate(hints.items())))
    best = F.array_max(hits)
    return F.when(best["hits"] > 0, best["name"]).otherwise("unknown")


def q_line_scan(spark, sf_dir):
    rows = document_lines(spark, sf_dir).withColumn("code", F.trim(L.strip_comment(F.col("raw"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum((F.col("code") != "").cast("int")).alias("n_code"), F.sum(F.length("code")).alias("code_chars"), F.max(F.length("raw")).cast("long").alias("longest"))


def q_term_extract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("terms", F.array_sort(X.terms(F.col("text"))))
    return docs.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def q_path_classify(spark, sf_dir):
    folder = F.expr("map('en', 'src', 'fr', 'test', 'de', 'lib', 'es', 'docs')")
    path = F.concat(F.coalesce(F.element_at(folder, F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)), F.lit("other")), F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+/(.*)$", 1))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("kind", X.source_type(path)).withColumn("role", X.evidence_role(F.col("kind")))
    return pages.groupBy("kind", "role").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def q_term_search_limit(spark, sf_dir):
    return search_lines(document_lines(spark, sf_dir), "License", "doc_id", 200).select("doc_id", "line_no", F.md5("raw").alias("line_md5"))


def q_leak_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    named = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("audits/"), path)).when(F.col("page_id") % 3 == 1, F.concat(path, F.lit("-report.html"))).otherwise(path)
    return pages.withColumn("path", named).where(~X.leaks_answers(F.col("path"))).select("page_id", "path")


def q_blind_exclusion(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return docs.where(~X.has_any(hay, ("src3 ", "mit license", "password"))).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def q_regex_extract_pairs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pattern = '<a href="([^"]*)">([^<]*)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"))
    return pages.select(F.explode(pairs).alias("p")).groupBy(F.col("p.href").alias("href"), F.col("p.label").alias("label")).agg(F.count("*").alias("n"))


def q_statement_kind(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy(statement_kind(F.col("raw")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("n_chars"))


def q_marker_lines(spark, sf_dir):
    low = F.lower("raw")
    flags = {"license": X.has_any(low, LICENSE_TERMS), "secret": X.has_any(low, ("token", "password", "key =")), "contact": F.col("raw").contains("@") | F.col("raw").rlike(r"\+[0-9]"), "long_line": F.length("raw") > 1000}
    rows = document_lines(spark, sf_dir)
    return rows.groupBy("doc_id").agg(*(F.sum(x.cast("int")).alias(n) for n, x in flags.items())).where("license + secret + contact + long_line > 0")


def q_doc_carry(spark, sf_dir):
    return doc_carry(L.to_lines(sample.repositories(spark, sf_dir)), ["repo", "file_path"])


def q_nesting_ranges(spark, sf_dir):
    rows = L.nesting_ranges(L.to_lines(sample.repositories(spark, sf_dir)), ["repo", "file_path"])
    return rows.groupBy("repo", "file_path").agg(F.max("depth_after").alias("deepest"), F.sum((F.col("depth_after") > 1).cast("int")).alias("inner_lines"), F.count("*").alias("n_lines"))


def q_domain_argmax(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("domain", domain_argmax(X.terms(F.col("text")), DOMAINS))
    return docs.groupBy("lang", "domain").agg(F.count("*").alias("n"))


def q_term_top30(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({X.TERM})"), 1)).alias("w")).select(F.lower("w").alias("term"))
    return words.where(~F.col("term").isin("the", "and", "der", "que", "les", "los")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(30)


def q_vocab_profile(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("low", F.lower("text"))
    return docs.groupBy("source").agg(*(F.max(F.contains("low", F.lit(w))).alias(f"has_{w}") for w in VOCABULARY), F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))


def q_cooccurrence_intersect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("low", F.lower("text"))
    both = docs.where(F.contains("low", F.lit("license"))).select("source").intersect(docs.where(F.contains("low", F.lit("token"))).select("source"))
    return docs.join(both, "source", "left_semi").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


def q_set_algebra(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.terms(F.col("text")).alias("t"))
    a, b = F.array(*map(F.lit, ("the", "and", "with", "der"))), F.array(*map(F.lit, ("der", "les", "que")))
    return docs.select("doc_id", F.size(F.array_intersect("t", a)).cast("long").alias("a_hits"), F.size(F.array_intersect("t", F.array_union(a, b))).cast("long").alias("ab_hits"), F.size(F.array_except(a, "t")).cast("long").alias("a_missing"), F.round(F.size(F.array_intersect("t", b)) / F.size(b), 4).alias("b_cover"))


def q_repo_snapshot(spark, sf_dir):
    files = sample.repositories(spark, sf_dir).withColumn("kind", X.source_type(F.col("file_path")))
    return files.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum(F.col("kind").isin("production", "unknown").cast("int")).alias("n_target"), F.sum((F.col("kind") == "test").cast("int")).alias("n_tests"), F.min(F.regexp_extract("text", r"pragma solidity ([^;]+);", 1)).alias("pragma"))


def q_body_concat(spark, sf_dir):
    body = F.substring(F.array_join("body", "\n"), 1, 1600)
    held = L.bodies(sample.repositories(spark, sf_dir)).select("repo", "file_path", "function_name", body.alias("b"))
    return held.select("repo", "file_path", "function_name", F.md5("b").alias("body_md5"), F.length("b").cast("long").alias("n_chars"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}

_DOC_LINES = "lines AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents)"
_TERMS = "list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_-]{2,}'), lambda x: lower(x)))"


def _with_aliases(inner: str) -> str:
    for members, name in X.ALIASES:
        inner = f"(SELECT doc_id, lang, CASE WHEN list_has_any(t, [{', '.join(map(sample.quoted, members))}]) THEN list_distinct(list_append(t, '{name}')) ELSE t END AS t FROM {inner})"
    return inner


_DOC_TERMS = _with_aliases(f"(SELECT doc_id, lang, {_TERMS} AS t FROM documents)")


def _list(words) -> str:
    return "[" + ", ".join(map(sample.quoted, words)) + "]"


ORACLE = {
    "line_scan": f"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n_lines, sum(CAST(trim(split_part(raw, '//', 1), ' ') <> '' AS INT)) AS n_code, sum(length(trim(split_part(raw, '//', 1), ' '))) AS code_chars, max(length(raw)) AS longest FROM lines GROUP BY doc_id",
    "term_extract": f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(list_sort(t), ' ')) AS terms_md5 FROM {_DOC_TERMS}",
    "path_classify": """SELECT kind, CASE kind WHEN 'production' THEN 'primary' WHEN 'test' THEN 'behavioral_example' WHEN 'script' THEN 'deployment_context' ELSE 'supporting' END AS role, count(*) AS n, min(page_id) AS first_page
FROM (SELECT page_id, CASE regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) WHEN 'en' THEN 'production' WHEN 'fr' THEN 'test' WHEN 'de' THEN 'library' WHEN 'es' THEN 'docs' ELSE 'unknown' END AS kind FROM pages) GROUP BY ALL""",
    "term_search_limit": f"WITH {_DOC_LINES} SELECT doc_id, line_no, md5(raw) AS line_md5 FROM lines WHERE contains(lower(raw), 'license') ORDER BY doc_id, line_no LIMIT 200",
    "leak_filter": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'audits/' || path WHEN 1 THEN path || '-report.html' ELSE path END AS path FROM p)
SELECT page_id, path FROM q WHERE NOT (list_has_any(string_split(lower(path), '/'), ['audit','audits','report','reports','findings','known-issues','knownissues','security','contest','submissions','judging'])
  OR (regexp_extract(list_last(string_split(lower(path), '/')), '\\.([a-z0-9]+)$', 1) IN ('md','txt','pdf','html') AND regexp_matches(list_last(string_split(lower(path), '/')), '(audit|finding|report|known[-_ ]?issue|vulnerab|security)')))""",
    "blind_exclusion": "SELECT lang, source, count(*) AS n, sum(n_chars) AS n_chars FROM documents WHERE NOT (contains(lower(concat_ws(' ', source, lang, text)), 'src3 ') OR contains(lower(concat_ws(' ', source, lang, text)), 'mit license') OR contains(lower(concat_ws(' ', source, lang, text)), 'password')) GROUP BY ALL",
    "regex_extract_pairs": """SELECT regexp_extract(m, '<a href="([^"]*)">', 1) AS href, regexp_extract(m, '>([^<]*)</a>', 1) AS label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS m FROM pages) GROUP BY ALL""",
    "statement_kind": f"WITH {_DOC_LINES} SELECT CASE " + " ".join(f"WHEN regexp_matches(raw, {sample.quoted(p)}) THEN '{n}'" for n, p in STATEMENTS) + " ELSE 'fragment' END AS kind, count(*) AS n, sum(length(raw)) AS n_chars FROM lines GROUP BY 1",
    "marker_lines": f"""WITH {_DOC_LINES},
f AS (SELECT doc_id, sum(CAST(contains(lower(raw), 'license') OR contains(lower(raw), 'copyright') AS INT)) AS license,
  sum(CAST(contains(lower(raw), 'token') OR contains(lower(raw), 'password') OR contains(lower(raw), 'key =') AS INT)) AS secret,
  sum(CAST(contains(raw, '@') OR regexp_matches(raw, '\\+[0-9]') AS INT)) AS contact, sum(CAST(length(raw) > 1000 AS INT)) AS long_line FROM lines GROUP BY doc_id)
SELECT * FROM f WHERE license + secret + contact + long_line > 0""",
    "doc_carry": f"""WITH {sample.LINES_SQL},
m AS (SELECT *, regexp_matches(trim(raw), '^(///|/\\*\\*|\\*)') AS doc FROM lines),
g AS (SELECT *, sum(CASE WHEN doc THEN 0 ELSE 1 END) OVER (PARTITION BY repo, file_path ORDER BY line_no) AS grp FROM m)
SELECT f.repo, f.file_path, f.line_no, string_agg(trim(d.raw), ' ' ORDER BY d.line_no) AS claim
FROM g f JOIN g d ON d.repo = f.repo AND d.file_path = f.file_path AND d.grp = f.grp - 1 AND d.doc AND d.line_no >= f.line_no - 3 AND d.line_no < f.line_no
WHERE NOT f.doc AND regexp_matches(f.raw, '\\bfunction\\s+([A-Za-z_][A-Za-z0-9_]*)') GROUP BY ALL""",
    "nesting_ranges": f"WITH {sample.LINES_SQL} SELECT repo, file_path, max(depth_after) AS deepest, sum(CAST(depth_after > 1 AS INT)) AS inner_lines, count(*) AS n_lines FROM depths GROUP BY ALL",
    "domain_argmax": f"""WITH h AS (SELECT lang, [{', '.join(f"len(list_intersect(t, {_list(w)}))" for w in DOMAINS.values())}] AS hits FROM {_DOC_TERMS})
SELECT lang, CASE WHEN list_max(hits) = 0 THEN 'unknown' ELSE {_list(DOMAINS)}[list_position(hits, list_max(hits))] END AS domain, count(*) AS n FROM h GROUP BY ALL""",
    "term_top30": "SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_-]{2,}'))) AS term FROM documents) WHERE term NOT IN ('the','and','der','que','les','los') GROUP BY term ORDER BY n DESC, term LIMIT 30",
    "vocab_profile": "SELECT source, " + ", ".join(f"bool_or(contains(lower(text), '{w}')) AS has_{w}" for w in VOCABULARY) + ", count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source",
    "cooccurrence_intersect": "WITH s AS (SELECT source FROM documents WHERE contains(lower(text), 'license') INTERSECT SELECT source FROM documents WHERE contains(lower(text), 'token')) SELECT source, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE source IN (SELECT source FROM s) GROUP BY source",
    "set_algebra": f"""SELECT doc_id, len(list_intersect(t, ['the','and','with','der'])) AS a_hits, len(list_intersect(t, ['the','and','with','der','les','que'])) AS ab_hits,
4 - len(list_intersect(t, ['the','and','with','der'])) AS a_missing, round(len(list_intersect(t, ['der','les','que'])) / 3.0, 4) AS b_cover FROM {_DOC_TERMS}""",
    "repo_snapshot": f"""WITH {sample.SOURCES_SQL} SELECT repo, count(*) AS n_files, sum(CAST(file_path LIKE 'src/%' OR file_path LIKE 'contracts/%' AS INT)) AS n_target,
sum(CAST(file_path LIKE 'test/%' AS INT)) AS n_tests, min(regexp_extract(text, 'pragma solidity ([^;]+);', 1)) AS pragma FROM src GROUP BY repo""",
    "body_concat": f"""WITH {sample.LINES_SQL}, b AS (SELECT r.repo, r.file_path, r.function_name, r.start_line, substring(string_agg(l.raw, chr(10) ORDER BY l.line_no), 1, 1600) AS b
FROM ranges r JOIN lines l ON l.repo = r.repo AND l.file_path = r.file_path AND l.line_no BETWEEN r.start_line AND r.end_line GROUP BY ALL)
SELECT repo, file_path, function_name, md5(b) AS body_md5, length(b) AS n_chars FROM b""",
}
