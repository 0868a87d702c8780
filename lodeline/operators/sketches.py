"""Sketches that are stored by hour or source and merged upwards: distinct values, quantiles, frequent items.

A sketch of a day is the union of its hours', so what is stored is read again, not the rows. Each has an error bound: RELATIVE
of the distinct count, RANK of the rows for a quantile; and a frequent item is never missed, as those whose share is above that of
what the sketch holds on average are all in it, and a second pass counts these exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.retrieve import read
from lodeline.plans.shared import join_checked, materialise, shared_dir

#: Logarithm of the registers, and three standard errors of the estimate: 3 * 1.04 / sqrt(4096).
REGISTERS, RELATIVE = 12, 0.05
#: Parameter of the quantile sketch, and the share of rows that a quantile may be off.
KLL, RANK = 200, 0.03
QUANTILES = (0.5, 0.9, 0.99)
#: Items of a frequency sketch, and the share from which on an item counts as frequent.
ITEMS, FREQUENT = 1024, 0.02


def store(events: DataFrame, path: str) -> DataFrame:
    """Sketches of users and values by hour and type, as a table: hour, event_type, n, users, amounts."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    hours.agg(F.count("*").alias("n"), F.hll_sketch_agg("user_id", REGISTERS).alias("users"), F.kll_sketch_agg_double("value", KLL).alias("amounts")).write.parquet(path)
    return events.sparkSession.read.parquet(path)


def merged(sketches: DataFrame, *by) -> DataFrame:
    """The same by coarser groups, from the stored sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("amounts").alias("amounts"))


def frequent(rows: DataFrame, group: str, part: str, item: str, share: float = FREQUENT, items: int = ITEMS) -> DataFrame:
    """group, item, n: items that are more than ``share`` of a group's rows, exactly.

    Sketches of each part of a group are stored, merged by group, and give the candidates; their counts come from a second pass.
    ``share`` must be above 2 / ``items``. Null items are left out.
    """
    spark = rows.sparkSession
    given = rows.where(F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(part).alias("p"), F.col(item).alias("x"))
    stored = materialise(given.groupBy("g", "p").agg(F.expr(f"approx_top_k_accumulate(x, {items})").alias("s"), F.count("*").alias("n")), "frequency-sketches")
    whole = stored.groupBy("g").agg(F.expr(f"approx_top_k_combine(s, {items})").alias("s"), F.sum("n").alias("n"))
    candidates = materialise(whole.select("g", "n", F.explode(F.expr(f"approx_top_k_estimate(s, {items})")).alias("c")).where(F.col("c.count") > share * F.col("n") * 0.5).select("g", F.col("c.item").alias("x"), "n"), "frequent-candidates")
    counted = join_checked(given, candidates.select("g", "x"), ["g", "x"], "left_semi").groupBy("g", "x").agg(F.count("*").alias("m"))
    return counted.join(candidates, ["g", "x"]).where(F.col("m") > share * F.col("n")).select(F.col("g").alias(group), F.col("x").alias(item), F.col("m").alias("n"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(read(spark, sf_dir, "events"), f"{shared_dir(spark)}/lodeline/sketches-{uuid.uuid4().hex}")


def q_sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day, and whether the users estimated from its hours are within the bound of the exact number."""
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    estimates = merged(_stored(spark, sf_dir), day).select("day", "n", F.hll_sketch_estimate("users").alias("estimate"))
    exact = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return estimates.join(exact, "day").select("day", "n", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), RELATIVE * F.col("users"))).alias("within"))


def q_sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the values of each type from stored hours, and whether each is within the bound of ranks."""
    whole = materialise(merged(_stored(spark, sf_dir), "event_type").select("event_type", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("amounts", F.lit(q)).alias("found")) for q in QUANTILES))).alias("x")).select("event_type", "x.*"), "quantiles")
    values = join_checked(read(spark, sf_dir, "events").where("value is not null").select("event_type", "value"), whole, "event_type")
    ranks = values.groupBy("event_type", "q").agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("found")).alias("below"), F.count_if(F.col("value") <= F.col("found")).alias("upto"))
    return ranks.select("event_type", "q", "n", ((F.col("below") <= (F.col("q") + RANK) * F.col("n")) & (F.col("upto") >= (F.col("q") - RANK) * F.col("n"))).alias("within"))


def q_frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are more than a fiftieth of a language's words, from sketches of its sources."""
    words = read(spark, sf_dir, "documents").select("lang", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    return frequent(words, "lang", "source", "word")


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "sketch_distinct": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1",
    "sketch_quantiles": f"SELECT event_type, q, count(value) AS n, true AS within FROM events CROSS JOIN (VALUES {', '.join(f'(CAST({q} AS DOUBLE))' for q in QUANTILES)}) t(q) GROUP BY ALL",
    "frequent_words": f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n FROM c JOIN (SELECT lang, sum(n) AS whole FROM c GROUP BY 1) USING (lang) WHERE n > {FREQUENT} * whole""",
}
