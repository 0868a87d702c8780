"""What runs leave behind: JSON and Markdown, corpora, versioned indexes, slim state and lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.plans.shared import _filesystem

#: Characters of a value that slim state keeps as it is.
SLIM_CHARS = 2000
#: Report buckets: name, statuses.
BUCKETS = (("findings", ("confirmed", "likely")), ("leads", ("lead",)), ("needs_manual_review", ("needs_manual_review",)), ("suspicious_hypotheses", ("suspicious",)), ("rejected_hypotheses", ("rejected",)))


def overwrite_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there."""
    df.write.mode("overwrite").json(path)


def overwrite_text(df: DataFrame, path: str, column: str = "value") -> None:
    """A column as lines of text, in place of what was there."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_corpus(raw: DataFrame, normalised: DataFrame, root: str) -> None:
    """Raw rows as JSON lines and normalised ones as Parquet, both in full."""
    overwrite_json(raw, f"{root}/raw")
    normalised.write.mode("overwrite").parquet(f"{root}/normalised")


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def build_index(vectors: DataFrame, root: str, about: dict[str, str | int]) -> None:
    """Vectors as Parquet below index/, and one row of metadata; an index that fails leaves index.UNAVAILABLE behind."""
    spark = vectors.sparkSession
    try:
        vectors.write.mode("overwrite").parquet(f"{root}/index")
    except Exception:
        spark.createDataFrame([("index failed",)], "message string").write.mode("overwrite").json(f"{root}/index.UNAVAILABLE")
        raise
    found = spark.read.parquet(f"{root}/index").agg(F.count("*").alias("rows"))
    found.select("rows", *(F.lit(v).alias(k) for k, v in about.items())).write.mode("overwrite").json(f"{root}/index_metadata")


def rebuild_index(vectors: DataFrame, root: str, about: dict[str, str | int]) -> None:
    """Build anew; the index so far becomes the one archived generation, once the new one is written."""
    spark = vectors.sparkSession
    build_index(vectors, f"{root}/next", about)
    fs, _ = _filesystem(spark, root)
    for part, archived in (("index", True), ("index_metadata", False)):
        _, now = _filesystem(spark, f"{root}/{part}")
        if fs.exists(now):
            _, archive = _filesystem(spark, f"{root}/{part}.archive")
            fs.delete(archive, True)
            fs.rename(now, archive)
            if not archived:
                fs.delete(archive, True)
        fs.rename(_filesystem(spark, f"{root}/next/{part}")[1], now)
    fs.delete(_filesystem(spark, f"{root}/next")[1], True)


def report_document(findings: DataFrame, run: str) -> DataFrame:
    """One row: the run and its findings by bucket, each an array of structs by id."""
    row = F.struct(*findings.columns)
    of = lambda statuses: F.array_sort(F.collect_list(F.when(F.col("status").isin(*statuses), row)))
    return findings.agg(*(of(s).alias(b) for b, s in BUCKETS)).select(F.lit(run).alias("run"), *(b for b, _ in BUCKETS))


def markdown(rows: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """line, value: a title and a table of ``rows``; they are a report, of a few hundred rows."""
    from pyspark.sql.window import Window

    cells = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), cells([F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n]", " "), F.lit("")) for c in rows.columns]).alias("value"))
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "line long, value string")
    return top.unionByName(body.select((F.col("n") + len(head) - 1).cast("long").alias("line"), "value"))


def slim_state(state: DataFrame, omitted: tuple[str, ...] = ()) -> DataFrame:
    """(key, value: JSON) with lists and long values replaced by their sizes, and some keys by a note."""
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    items = F.size(F.from_json("value", "array<string>"))
    keys = F.size(F.map_keys(F.from_json("value", "map<string,string>")))
    short = (
        F.when(F.col("key").isin(*omitted) if omitted else F.lit(False), F.lit("<omitted>"))
        .when(kind.startswith("ARRAY"), F.concat(F.lit("<list:"), items.cast("string"), F.lit(" items>")))
        .when(kind.startswith("OBJECT") & (F.length("value") > SLIM_CHARS), F.concat(F.lit("<dict:"), keys.cast("string"), F.lit(" keys; omitted>")))
        .otherwise(F.col("value"))
    )
    return state.select("key", short.alias("value"))


def append_lessons(lessons: DataFrame, path: str) -> int:
    """Append (repo, lesson) rows that the log does not hold yet; returns how many."""
    spark = lessons.sparkSession
    new = lessons.select("repo", "lesson").distinct()
    if exists(spark, path):
        new = new.join(spark.read.schema("repo string, lesson string").json(path), ["repo", "lesson"], "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n
