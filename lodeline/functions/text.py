"""Column functions over text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[a-zA-Z][a-zA-Z0-9_-]{2,}"
#: A term of a group brings in the group's name.
ALIASES = (
    (("lowerlookup", "lower", "lookup"), "lowerlookup"),
    (("upperlookup", "upperlookuprecent", "upper", "latest"), "upperlookup"),
    (("handlereport", "reports", "report"), "handlereport"),
    (("cantransfer", "whitelist", "allow", "allowed"), "cantransfer"),
)
#: Folders and suffixes of answers that a blind run must not see.
LEAK_FOLDERS = ("audit", "audits", "report", "reports", "findings", "known-issues", "knownissues", "security", "contest", "submissions", "judging")
LEAK_SUFFIXES = ("md", "txt", "pdf", "html")
LEAK_NAME = "(audit|finding|report|known[-_ ]?issue|vulnerab|security)"


def has_any(column: Column, terms) -> Column:
    """Whether the text holds any of the terms, as they are."""
    out = F.lit(False)
    for term in terms:
        out |= column.contains(term)
    return out


def terms(text: Column) -> Column:
    """Distinct lower-case terms of three characters or more, with the aliases of their groups."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})"), 1), lambda x: F.lower(x)))

    def with_aliases(own: Column) -> Column:
        names = F.array(*(F.when(F.arrays_overlap(own, F.array(*map(F.lit, members))), F.lit(name)) for members, name in ALIASES))
        return F.array_union(own, F.array_compact(names))

    return F.get(F.transform(F.array(found), with_aliases), F.lit(0))  # the terms are worked out once


def collapse(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, length: int = 63) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), 1, length)


def source_type(path: Column) -> Column:
    """docs, dependency, library, test, script, production or unknown; null and empty paths are unknown."""
    clean = F.regexp_replace(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), "^[./]+", "")
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    first, name = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    any_of = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(F.size(parts) == 0, "unknown")
        .when(name.endswith(".md") | name.startswith("readme") | first.isin("doc", "docs"), "docs")
        .when(any_of("node_modules", ".venv", "vendor"), "dependency")
        .when(first.isin("lib", "libs"), "library")
        .when(any_of("test", "tests", "mock", "mocks"), "test")
        .when(first.isin("script", "scripts"), "script")
        .when(first.isin("src", "contracts"), "production")
        .otherwise("unknown")
    )


def evidence_role(kind: Column) -> Column:
    return F.when(kind == "production", "primary").when(kind == "test", "behavioral_example").when(kind == "script", "deployment_context").otherwise("supporting")


def leaks_answers(path: Column) -> Column:
    """Whether a path lies in an answers folder, or is a document named like one."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, LEAK_FOLDERS))) | (F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).isin(*LEAK_SUFFIXES) & name.rlike(LEAK_NAME))


def tolerant_object(text: Column) -> Column:
    """The first JSON object of a text as it stands there, whatever is around or within it; null if its braces do not close or it is no JSON.

    An object in a fence of three backticks comes first. The pieces between quotes, braces and escapes are gone through once: braces count
    unless they are in a string.
    """
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    start = F.instr(text, "{")
    rest = F.substring(text, start, F.length(text))
    pieces = F.when(start > 0, F.regexp_extract_all(rest, F.lit(r'(?s)\\.|["{}]|[^"{}\\]+|\\'), F.lit(0)))
    at_first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def step(s: Column, x: Column) -> Column:
        quoted = F.when(x == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(s["quoted"], 0).when(x == "{", 1).when(x == "}", -1).otherwise(0)
        after = F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["n"] + 1).alias("n"), (~s["quoted"] & (x == "}") & (depth == 0)).alias("closed"))
        return F.when(s["closed"], s).otherwise(after)

    end = F.aggregate(pieces, at_first, step)
    balanced = F.when(end["closed"], F.array_join(F.slice(pieces, F.lit(1), F.greatest(end["n"], F.lit(1))), ""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(fenced), valid(balanced))


def string_list(value: Column, path: str) -> Column:
    """A VARIANT's string or list of strings as a list; null if it is neither."""
    many, one = F.try_variant_get(value, path, "array<string>"), F.try_variant_get(value, path, "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
