"""The call ledger: summaries, duplicate calls, milestones, and tumbling and session windows over its stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeline.functions.text import tolerant_object
from lodeline.plans.shared import shared_dir
from lodeline.sources.sample import quoted, values_sql

#: Milestones of a run in order.
MILESTONES = ("signup", "view", "click", "purchase")
#: Levels of a fingerprint's tree: a thousand digests are joined at most, for ids of up to 10 ** (3 * LEVELS + 3).
LEVELS = 4
#: Texts that hold a JSON object among others: id, text.
REPLIES = (
    (1, 'Here it is: ```json\n{"name": "a", "n": 1}\n``` done'),
    (2, '{"name": "b", "n": 2}'),
    (3, "no object"),
    (4, 'first {"name": "c", "n": 3} and then more'),
    (5, '{"name": broken'),
)


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def append_records(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def tumbling_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Calls, errors and summed value by window and type; works on batches and on streams.

    In append mode a stream gives a window when the watermark has passed its end, in complete mode (``run_stream_whole``) every window.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def run_stream(spark: SparkSession, source_dir: str, schema: T.StructType, pattern: str, transform, name: str) -> DataFrame:
    """Read the files of a folder as a stream, transform it, write it until no file is left, and read the result.

    Progress and results lie in the shared folder, so the run can be taken up after a failure.
    """
    import uuid

    base = f"{shared_dir(spark)}/lodeline/{name}-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source_dir)
    query = transform(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def run_stream_whole(spark: SparkSession, source_dir: str, schema: T.StructType, pattern: str, transform, name: str) -> DataFrame:
    """The same for an aggregation of which all groups count, open windows too: complete mode, so no row is late.

    Each batch writes all groups to a table of its own, again if it is taken up after a failure; the last one is the result.
    """
    import uuid

    base = f"{shared_dir(spark)}/lodeline/{name}-{uuid.uuid4().hex}"
    stream = transform(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source_dir))
    done: list[int] = []

    def keep(groups: DataFrame, batch: int) -> None:
        groups.write.mode("overwrite").parquet(f"{base}/out-{batch}")
        done.append(batch)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out-{max(done)}") if done else spark.createDataFrame([], stream.schema)


def first_calls(events: DataFrame) -> DataFrame:
    """Of equal calls of a user, the first; a call is its type and canonical input."""
    key = F.sha2(F.concat_ws("|", "event_type", F.coalesce("props", F.lit(""))), 256)
    rank = F.row_number().over(Window.partitionBy("user_id", "key").orderBy("ts", "event_id"))
    return events.withColumn("key", key).withColumn("nth", rank).where("nth = 1").drop("nth")


def q_ledger_summary(spark, sf_dir):
    """Calls, kinds and errors of a user, and the last six calls: ranked before any are gathered."""
    events = read(spark, sf_dir)
    counts = events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = events.select("user_id", "ts", "event_id").withColumn("nth", nth).where("nth <= 6").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("last_calls"))
    return counts.join(last, "user_id")


def q_milestone_gap(spark, sf_dir):
    """The first milestone that a user lacks."""
    events = read(spark, sf_dir)
    done = events.groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    missing = F.array_except(F.array(*map(F.lit, MILESTONES)), F.col("done"))
    return done.select("user_id", F.try_element_at(missing, F.lit(1)).alias("next"), F.size(missing).cast("long").alias("n_missing"))


def q_call_dedup(spark, sf_dir):
    return first_calls(read(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def q_json_path_get(spark, sf_dir):
    return read(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def q_tolerant_json(spark, sf_dir):
    rows = spark.createDataFrame(REPLIES, "id int, text string").withColumn("found", tolerant_object(F.col("text")))
    return rows.select("id", F.get_json_object("found", "$.name").alias("name"), F.get_json_object("found", "$.n").cast("int").alias("n"))


def q_corpus_fingerprint(spark, sf_dir):
    """Digest of the corpus as a tree: of a thousand consecutive documents, of a thousand of those, and so on up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    level = docs.select(F.col("doc_id").alias("key"), F.sha2(F.concat_ws("|", "doc_id", "source", "text"), 256).alias("digest"), F.lit(1).cast("long").alias("n"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "digest"))), lambda x: x["digest"]), "")
    for _ in range(LEVELS):
        level = level.groupBy(F.floor(F.col("key") / 1000).alias("key")).agg(F.sha2(digests, 256).alias("digest"), F.sum("n").alias("n"))
    return level.agg(F.sha2(digests, 256).alias("fingerprint"), F.sum("n").alias("n"))


def q_index_gate(spark, sf_dir):
    """Whether an index of the embeddings fits: model, dimension and row count of the metadata row."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    meta = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    return meta.select("n", F.col("most").cast("long").alias("dim"), ((F.col("least") == 64) & (F.col("most") == 64)).alias("compatible"))


def q_tumbling_counts(spark, sf_dir):
    return tumbling_counts(read(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "value")


def q_ledger_stream_windows(spark, sf_dir):
    """Daily counts by the same operator as a stream over the event file, until all input is read; windows that are still open count too."""
    events = read(spark, sf_dir)

    def daily(stream):
        return tumbling_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), 24 * 60, "1 day")

    out = run_stream_whole(spark, sf_dir, events.schema, "events*.parquet", daily, "ledger-stream")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "ledger_summary": """SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'error') AS errors,
array_to_string(list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 6), ',') AS last_calls FROM events GROUP BY 1""",
    "milestone_gap": f"""WITH m AS (SELECT user_id, list_filter([{', '.join(map(quoted, MILESTONES))}], lambda x: NOT list_contains(d, x)) AS m FROM (SELECT user_id, list(DISTINCT event_type) AS d FROM events GROUP BY 1))
SELECT user_id, m[1] AS next, len(m) AS n_missing FROM m""",
    "call_dedup": """SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, coalesce(props, '') ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1 GROUP BY 1""",
    "json_path_get": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
    "tolerant_json": f"""WITH r AS (SELECT id, nullif(regexp_extract(text, '(\\{{[^{{}}]*\\}})', 1), '') AS o FROM {values_sql(REPLIES, 'id, text')}), v AS (SELECT id, CASE WHEN o IS NOT NULL AND json_valid(o) THEN o END AS o FROM r)
SELECT id, json_extract_string(o, '$.name') AS name, CAST(json_extract_string(o, '$.n') AS INT) AS n FROM v""",
    "corpus_fingerprint": f"""WITH l0 AS (SELECT doc_id AS key, sha256(concat_ws('|', doc_id, source, text)) AS digest, 1 AS n FROM documents),
{", ".join(f"l{i + 1} AS (SELECT key // 1000 AS key, sha256(string_agg(digest, '' ORDER BY key)) AS digest, sum(n) AS n FROM l{i} GROUP BY 1)" for i in range(LEVELS))}
SELECT sha256(string_agg(digest, '' ORDER BY key)) AS fingerprint, sum(n) AS n FROM l{LEVELS}""",
    "index_gate": "SELECT count(*) AS n, max(len(embedding)) AS dim, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS compatible FROM embeddings",
    "ledger_stream_windows": "SELECT event_type, count(*) AS n, count(DISTINCT time_bucket(INTERVAL 1 DAY, ts)) AS windows FROM events GROUP BY 1",
    "tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS value FROM events GROUP BY 1, 2",
}
