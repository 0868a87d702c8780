"""Line heuristics, first matches of a file, and checklists of what documents name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators.judge import _H, hypotheses
from lodeline.sources import lines as L
from lodeline.sources import sample

KEYS = ["repo", "file_path"]
#: Terms of payouts, of paid loops, of collections that grow, of outside state, and of books.
PAYOUT_TERMS = ("percentage", "percent", "precision", "basis", "bps", "wage", "share", "bursary", "reward", "payout", "transfer")
PAID_TERMS = ("transfer", "pay", "reward", "bursary")
GROWING_TERMS = (".length", "list", "array", "students", "teachers", "users")
OUTSIDE_TERMS = (".balanceof(", ".balance", "totalassets(", "latestanswer(")
BOOK_TERMS = ("balance", "balances", "supply", "debt", "reward", "rewards", "bursary", "wage", "fee", "fees", "score", "count", "share", "shares")
UPGRADES = ("upgradeTo(", "upgradeToAndCall(")
#: Names of functions that move what is not theirs.
SENSITIVE_NAMES = ("emergency", "sweep", "drain")
LOOP = r"\bfor\s*\("


def line_kinds(code: Column, upgrades: Column) -> dict[str, Column]:
    """The suspicions a line raises; ``upgrades``: whether its file upgrades anything."""
    low = F.lower(code)
    loop = low.rlike(LOOP)
    return {
        "percentage_distribution_math": (X.has_any(low, PAYOUT_TERMS) & code.rlike("[*/%]")) | (loop & X.has_any(low, PAID_TERMS)),
        "upgrade_authorization_without_upgrade": low.contains("_authorizeupgrade") & ~upgrades,
        "unbounded_loop_dos": loop & X.has_any(low, GROWING_TERMS),
        "external_state_accounting_trust": X.has_any(low, OUTSIDE_TERMS) & X.has_any(low, BOOK_TERMS),
    }


def line_heuristics(sources: DataFrame) -> DataFrame:
    """One row a line and suspicion. What is asked of a whole file is worked out before it becomes lines."""
    marked = sources.withColumn("upgrades", X.has_any(F.col("text"), UPGRADES))
    lines = L.to_lines(marked).withColumn("code", L.strip_comment(F.col("raw")))
    kinds = F.array(*(F.when(c, F.lit(n)) for n, c in line_kinds(F.col("code"), F.col("upgrades")).items()))
    return lines.select(*KEYS, "line_no", F.explode(F.array_compact(kinds)).alias("kind"))


def first_matches(sources: DataFrame) -> DataFrame:
    """The first line of each file whose token transfer goes unchecked, and its first declaration of a sensitive name without a guard."""
    lines = L.to_lines(sources).withColumn("code", L.strip_comment(F.col("raw"))).withColumn("packed", F.replace("code", F.lit(" "), F.lit("")))
    checked = F.lower("code").contains("safetransfer") | X.has_any(F.col("packed"), ("require(", "assert(", "address(this).balance"))
    transfer = X.has_any(F.col("code"), (".transfer(", ".transferFrom(")) & ~checked & ~F.col("packed").startswith("to.transfer(")
    name = F.lower(F.regexp_extract("code", L.DECLARED_FUNCTION, 1))
    exposed = X.has_any(name, SENSITIVE_NAMES) & F.col("code").rlike(r"\b(external|public)\b") & ~F.col("code").rlike(r"\bonly[A-Z]|\bauth\b|requiresAuth")
    kinds = F.array_compact(F.array(F.when(transfer, F.lit("unchecked_transfer")), F.when(exposed, F.lit("missing_access_control"))))
    return lines.select(*KEYS, "line_no", F.explode(kinds).alias("kind")).groupBy(*KEYS, "kind").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))


def checklist(rows: DataFrame, most: int) -> DataFrame:
    """Findings of equal class and equal first four terms of their titles as one point each, the most frequent ones."""
    key = F.array_join(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("title", F.lit("([a-z]{4,})"), 1))), 1, 4), " ")
    points = rows.select("class", key.alias("key"), "doc_id").groupBy("class", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return points.orderBy(F.desc("n"), "class", "key").limit(most)


def q_line_heuristics(spark, sf_dir):
    return line_heuristics(sample.repositories(spark, sf_dir))


def q_first_match_hypotheses(spark, sf_dir):
    return first_matches(sample.repositories(spark, sf_dir))


def q_checklist_build(spark, sf_dir):
    return checklist(hypotheses(spark, sf_dir), 20)


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {sample.quoted(t)})" for t in terms) + ")"


_FOR = r"regexp_matches(lower(code), '\bfor\s*\(')"
ORACLE = {
    "line_heuristics": f"""WITH {sample.LINES_SQL}, f AS (SELECT c.*, {_any('s.text', UPGRADES)} AS upgrades FROM code c JOIN src s USING (repo, file_path))
SELECT repo, file_path, line_no, 'percentage_distribution_math' AS kind FROM f WHERE ({_any('lower(code)', PAYOUT_TERMS)} AND regexp_matches(code, '[*/%]')) OR ({_FOR} AND {_any('lower(code)', PAID_TERMS)})
UNION ALL SELECT repo, file_path, line_no, 'upgrade_authorization_without_upgrade' FROM f WHERE contains(lower(code), '_authorizeupgrade') AND NOT upgrades
UNION ALL SELECT repo, file_path, line_no, 'unbounded_loop_dos' FROM f WHERE {_FOR} AND {_any('lower(code)', GROWING_TERMS)}
UNION ALL SELECT repo, file_path, line_no, 'external_state_accounting_trust' FROM f WHERE {_any('lower(code)', OUTSIDE_TERMS)} AND {_any('lower(code)', BOOK_TERMS)}""",
    "first_match_hypotheses": f"""WITH {sample.LINES_SQL}, p AS (SELECT *, replace(code, ' ', '') AS packed, lower(regexp_extract(code, '\\bfunction\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS fname FROM code),
k AS (SELECT repo, file_path, line_no, 'unchecked_transfer' AS kind FROM p WHERE {_any('code', ('.transfer(', '.transferFrom('))} AND NOT contains(lower(code), 'safetransfer') AND NOT {_any('packed', ('require(', 'assert(', 'address(this).balance'))} AND NOT starts_with(packed, 'to.transfer(')
UNION ALL SELECT repo, file_path, line_no, 'missing_access_control' FROM p WHERE {_any('fname', SENSITIVE_NAMES)} AND regexp_matches(code, '\\b(external|public)\\b') AND NOT regexp_matches(code, '\\bonly[A-Z]|\\bauth\\b|requiresAuth'))
SELECT repo, file_path, kind, min(line_no) AS first_line, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "checklist_build": f"""WITH {_H}, p AS (SELECT class, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(title, '[a-z]{{4,}}'))), 1, 4), ' ') AS key, doc_id FROM h)
SELECT class, key, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY 1, 2 ORDER BY n DESC, class, key LIMIT 20""",
}
