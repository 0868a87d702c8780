"""WARC: resolving not-modified revisits.

A revisit holds no payload; it stands for the latest earlier full response of its canonical URL. This is an as-of
join on time, within a URL. A URL may hold any share of the records, so the window runs over (URL, slice of time),
slices being quantiles of all times, and a carried row brings each slice the last response of the slices before.
Then the validators decide (entity tag by weak comparison, else date of modification, else payload digest), and the
headers that a not-modified answer may update replace those of the stored response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that a not-modified answer updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = "utm_[a-z]+|fbclid|gclid|ref|sessionid"
#: Slices of time: the most that one task sees of a URL is about this fraction of all records.
SLICES = 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a last slash, sorted query without tracking.

    Scheme, user and fragment are dropped. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?@]*@)?", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "(?i)^www[0-9]*[.]", ""), ":(80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=.*)?$")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Each revisit of ``records`` with the response it stands for.

    ``records``: record_id long, url, at timestamp, kind ('response' or 'revisit'), etag, last_modified, digest
    (null: not sent), headers map<string,string> with lower-case names. Returned for each revisit: record_id,
    canonical, at, source_id and source_at of the latest response of a strictly earlier time (of several at that
    time, the greatest record_id), outcome and headers (sorted 'name: value' lines; null unless resolved).

    outcome: 'resolved'; 'mismatch' (a validator differs); 'unvalidated' (no validator in common); 'orphan' (no
    earlier response, or no URL or time). Repeated revisits come out each; other kinds and extra columns are ignored.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "at", "etag", "last_modified", "digest", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))).alias("lines"),
        canonical_url(F.col("url")).alias("canonical"), (F.col("kind") == "response").alias("full"),
    )
    quantiles = [i / slices for i in range(1, slices)]
    bounds = sorted(set(rows.agg(F.percentile_approx("t", F.lit(quantiles), 10 * slices)).first()[0] or []))
    part = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= F.col("t"))) if bounds else F.lit(0)
    dated = rows.where("t is not null and canonical is not null").withColumn("slice", part)
    source = F.when(F.col("full"), F.struct("t", "record_id", "at", "etag", "last_modified", "digest", "lines"))

    within = Window.partitionBy("canonical", "slice").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    seen = dated.withColumn("inside", F.max(source).over(within)).where("not full")
    ends = dated.where("full").groupBy("canonical", "slice").agg(F.max(source).alias("end"))
    needs = dated.select("canonical", "slice").distinct().join(ends, ["canonical", "slice"], "left")  # at most SLICES rows a URL
    carried = needs.select("canonical", "slice", F.max("end").over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = seen.join(carried, ["canonical", "slice"], "left").withColumn("of", F.coalesce("inside", "before"))

    both = [(_weak(F.col("etag")), _weak(F.col("of.etag"))), (F.col("last_modified"), F.col("of.last_modified")), (F.col("digest"), F.col("of.digest"))]
    agreed = F.coalesce(*(a == b for a, b in both))
    outcome = F.when(F.col("of").isNull(), F.lit("orphan")).when(agreed.isNull(), F.lit("unvalidated")).when(agreed, F.lit("resolved")).otherwise(F.lit("mismatch"))
    updates = F.filter("lines", lambda x: x["key"].isin(*PERMITTED))
    kept = F.filter(F.col("of.lines"), lambda x: ~F.array_contains(F.transform(updates, lambda u: u["key"]), x["key"]))
    merged = F.array_join(F.array_sort(F.transform(F.concat(kept, updates), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))), "\n")
    resolved = found.withColumn("outcome", outcome).select(
        "record_id", "canonical", "at", F.col("of.record_id").alias("source_id"), F.col("of.at").alias("source_at"), "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers")
    )
    undated = rows.where("not full and (t is null or canonical is null)")
    orphans = undated.select("record_id", "canonical", "at", F.lit(None).cast("long").alias("source_id"), F.lit(None).cast(records.schema["at"].dataType).alias("source_at"), F.lit("orphan").alias("outcome"), F.lit(None).cast("string").alias("headers"))
    return resolved.unionByName(orphans)


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages`` as records: two full fetches of a page, and two revisits.

    Page i is fetched i hours after the start of 2020, and again, if i is even and so in a new version, two days later.
    It is asked for half an hour after the first fetch and three days after it; what is sent are the validators of the
    latest version, but of the first one for every fourth page. The server sends no entity tag for every fifth page, and
    for every seventh the tag of another version. Between its fetches those of other pages with the same URL may lie.
    """
    i = F.col("page_id")
    hour = F.lit(1_577_836_800) + i * 3600
    first, second = (F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit(mark))) for mark in ("", "#2"))
    tag_of = lambda body: F.when(i % 5 != 0, F.concat(F.lit('"'), body, F.lit('"')))
    modified = lambda at: F.when(i % 3 != 0, at.cast("string"))

    def fetched(number: int, at: Column, body: Column) -> list[Column]:
        sent = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), at.cast("string"))
        return [(i * 4 + number).alias("record_id"), F.col("url"), F.timestamp_seconds(at).alias("at"), F.lit("response").alias("kind"), tag_of(body).alias("etag"), modified(at).alias("last_modified"), body.alias("digest"), sent.alias("headers")]

    def asked(number: int, at: Column, body: Column, since: Column) -> list[Column]:
        sent = F.create_map(F.lit("content-type"), F.lit("ignored"), F.lit("date"), at.cast("string"), F.lit("expires"), (at + 5400).cast("string"))
        tag = F.when(i % 7 == 3, F.lit('W/"other"')).otherwise(F.concat(F.lit("W/"), tag_of(body)))
        return [(i * 4 + number).alias("record_id"), F.col("url"), F.timestamp_seconds(at).alias("at"), F.lit("revisit").alias("kind"), tag.alias("etag"), modified(since).alias("last_modified"), F.when(i % 15 != 0, body).alias("digest"), sent.alias("headers")]

    newer = (i % 2 == 0) & (i % 4 != 2)
    later = hour + 172_800
    records = [
        pages.select(*fetched(0, hour, first)), pages.where(i % 2 == 0).select(*fetched(1, later, second)),
        pages.select(*asked(2, hour + 1800, first, hour)), pages.select(*asked(3, hour + 259_200, F.when(newer, second).otherwise(first), F.when(newer, later).otherwise(hour))),
    ]
    return records[0].unionByName(records[1]).unionByName(records[2]).unionByName(records[3])


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl of all pages, resolved."""
    return resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("record_id", "canonical", "source_id", "outcome", "headers")


QUERIES = {"op8_warc_revisits": op8_warc_revisits}
ORACLE = {
    "op8_warc_revisits": r"""
WITH bare AS (
  SELECT page_id, md5(coalesce(html, '')) AS body, md5(coalesce(html, '') || '#2') AS second, 1577836800 + page_id * 3600 AS h,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?@]*@)?', '') AS b
  FROM pages),
split AS (
  SELECT page_id, body, second, h,
         lower(regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*', 0), '(?i)^www[0-9]*[.]', ''), ':(80|443)$', '')) AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref|sessionid)(=.*)?$'))) AS q
  FROM bare),
page AS (
  SELECT page_id AS i, body, second, h, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM split),
sent AS (
  SELECT i, i * 4 AS record_id, canonical, h AS t, h AS since, body FROM page
  UNION ALL SELECT i, i * 4 + 1, canonical, h + 172800, h + 172800, second FROM page WHERE i % 2 = 0),
full_ AS (SELECT *, CASE WHEN i % 5 <> 0 THEN '"' || body || '"' END AS tag, CASE WHEN i % 3 <> 0 THEN CAST(since AS VARCHAR) END AS modified FROM sent),
asked AS (
  SELECT i, i * 4 + 2 AS record_id, canonical, h + 1800 AS t, h AS since, body FROM page
  UNION ALL SELECT i, i * 4 + 3, canonical, h + 259200, CASE WHEN i % 4 = 0 THEN h + 172800 ELSE h END, CASE WHEN i % 4 = 0 THEN second ELSE body END FROM page),
revisit AS (
  SELECT *, CASE WHEN i % 7 = 3 THEN '"other"' WHEN i % 5 <> 0 THEN '"' || body || '"' END AS tag, CASE WHEN i % 3 <> 0 THEN CAST(since AS VARCHAR) END AS modified, CASE WHEN i % 15 <> 0 THEN body END AS digest FROM asked),
joined AS (
  SELECT r.record_id, r.canonical, r.t, r.tag, r.modified, r.digest, p.record_id AS p, p.tag AS ptag, p.modified AS pmodified, p.body AS pdigest,
         row_number() OVER (PARTITION BY r.record_id ORDER BY p.t DESC NULLS LAST, p.record_id DESC) AS rn
  FROM revisit r LEFT JOIN full_ p ON p.canonical = r.canonical AND p.t < r.t),
judged AS (
  SELECT *, coalesce(tag = ptag, modified = pmodified, digest = pdigest) AS agreed FROM joined WHERE rn = 1)
SELECT record_id, canonical, p AS source_id,
       CASE WHEN p IS NULL THEN 'orphan' WHEN agreed IS NULL THEN 'unvalidated' WHEN agreed THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN p IS NOT NULL AND agreed THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) || 'expires: ' || (t + 5400) END AS headers
FROM judged"""
}
