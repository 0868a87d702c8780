"""Queries that write to the shared folder and read back: corpora, notes, indexes, reports, state and lessons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import hypotheses as H
from lodeline.operators.extract import NOTES, front_matter
from lodeline.operators.extract import ORACLE as EXTRACT_SQL
from lodeline.plans.shared import shared_dir
from lodeline.sources import files, sample, sinks
from lodeline.sources.sample import values_sql
from lodeline.sources.versions import VersionedCorpus
from lodeline.streaming.ledger import append_records

#: key, value (JSON) of a run's state.
STATE = (("run_id", '"r1"'), ("tool_ledger", "[1, 2, 3]"), ("repo_facts", '{"a": 1}'), ("static_facts", '{"x": "' + "y" * 2100 + '", "z": 1}'), ("protocol_graph", '{"slices": []}'), ("errors", "[]"), ("note", "not json"))
#: repo, path.
MARKERS = (("a", "foundry.toml"), ("a", "hardhat.config.js"), ("b", "app/hardhat.config.ts"), ("c", "README.md"))
LESSONS = (("a", "bind the price"), ("a", "bind the price"), ("b", "check expiry"))
MORE_LESSONS = (("a", "bind the price"), ("c", "check expiry"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodeline/{name}-{uuid.uuid4().hex}"


def q_corpus_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a raw and a normalised corpus, the raw one with a broken line, and both read back."""
    root = scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    sinks.write_corpus(docs, docs, root)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(f"{root}/raw")
    raw = files.read_json_lines(spark, f"{root}/raw", "doc_id long, source string, n_chars long", strict=False)
    both = raw.withColumn("of", F.lit("raw")).unionByName(spark.read.parquet(f"{root}/normalised").withColumn("of", F.lit("normalised")))
    return both.groupBy("of", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def q_ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in two parts, read strictly."""
    path = scratch(spark, "ledger")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    for part in (0, 1):
        append_records(events.where(F.col("user_id") % 2 == part), path)
    return files.read_json_lines(spark, path, "user_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def q_note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as files in two folders, read back as records."""
    root = scratch(spark, "notes")
    for path, text in NOTES:  # three inline notes
        folder, name = path.rsplit("/", 1)
        fs, target = sinks._filesystem(spark, f"{root}/{folder}/{name}")
        out = fs.create(target)
        out.write(bytearray(text.encode()))
        out.close()
    return front_matter(files.read_notes(spark, root))


def q_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors indexed, then rebuilt from half of them: rows of the index, of its archive and of the metadata."""
    root = scratch(spark, "vectors")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    about = {"model": "given", "canonical_version": 1}
    sinks.build_index(rows, root, about)
    sinks.rebuild_index(rows.where("vec_id % 2 = 0"), root, about)
    size = lambda p: spark.read.parquet(f"{root}/{p}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    meta = spark.read.json(f"{root}/index_metadata").select(F.lit("metadata").alias("part"), F.col("rows").alias("n"))
    return size("index").unionByName(size("index.archive")).unionByName(meta)


def q_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report document written as JSON and read back: ids by bucket."""
    path = scratch(spark, "report")
    sinks.overwrite_json(sinks.report_document(H.gated(H.rows(spark)).select("id", "title", "severity", "status"), "r1"), path)
    schema = "run string, " + ", ".join(f"{b} array<struct<id:string>>" for b, _ in sinks.BUCKETS)
    d = files.read_json_lines(spark, path, schema)
    buckets = F.map_from_arrays(F.array(*(F.lit(b) for b, _ in sinks.BUCKETS)), F.array(*(F.transform(b, lambda x: x["id"]) for b, _ in sinks.BUCKETS)))
    return d.select("run", F.explode(buckets).alias("bucket", "ids")).select("run", "bucket", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))


def q_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.gated(H.rows(spark)).select("id", "severity", "status")
    path = scratch(spark, "markdown")
    sinks.overwrite_text(sinks.markdown(found, "Findings", [F.col("id")]).orderBy("line"), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


def q_slim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.slim_state(spark.createDataFrame(STATE, "key string, value string"), ("protocol_graph",))


def q_lesson_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons of two runs appended to a log, each once."""
    path = scratch(spark, "lessons")
    for rows in (LESSONS, MORE_LESSONS):
        sinks.append_lessons(spark.createDataFrame(rows, "repo string, lesson string"), path)
    return files.read_json_lines(spark, path, "repo string, lesson string")


def q_listing_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred URLs of the pages, and whether there are more."""
    return files.listed(spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select(F.col("url").alias("path")).distinct(), 100)


def q_bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written one a file and read back by their first 400 bytes. Tasks move their files into place themselves; the driver would take one after the other."""
    root = scratch(spark, "files")
    rows = sample.repositories(spark, sf_dir, sample.LINKED_SOURCES).select("text")
    rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(root)
    return files.read_bounded(spark, root, 400).select(F.md5("text").alias("md5"), "truncated", "n_lines").distinct()


def q_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.framework(spark.createDataFrame(MARKERS, "repo string, path string"))


def q_versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged into a stored corpus twice, with a merge that fails between: rows and sums of each version, and what each merge did."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))
    corpus = VersionedCorpus(spark, scratch(spark, "versioned"), "doc_id", "doc_id long, source string, n_chars long", 16, F.pmod("doc_id", F.lit(16)))
    done = [corpus.merge(docs.where("doc_id % 3 = 0"))]
    try:
        corpus.merge(docs.withColumn("n_chars", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("a merge that fails"))).otherwise(F.col("n_chars"))))
    except Exception:
        done.append({"version": corpus.version(), "added": 0, "replaced": 0, "rewritten": 0})
    done.append(corpus.merge(docs.where("doc_id % 16 < 5").withColumn("n_chars", F.col("n_chars") + 1)))
    merges = spark.createDataFrame([(i, *(m[c] for c in ("version", "added", "replaced", "rewritten"))) for i, m in enumerate(done)], "step int, version int, added long, replaced long, rewritten int")
    versions = None
    for v in (1, 2):
        one = corpus.read(v).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).withColumn("version", F.lit(v))
        versions = one if versions is None else versions.unionByName(one)
    return merges.join(versions, "version")


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_GATED = H._GATED_SQL
NOTE_SQL = EXTRACT_SQL["front_matter_note"]
ORACLE = {
    "corpus_store": "SELECT of, source, count(*) AS n, sum(n_chars) AS n_chars FROM documents CROSS JOIN (VALUES ('raw'), ('normalised')) t(of) GROUP BY ALL",
    "versioned_upsert": """WITH v AS (SELECT 1 AS version, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 2, count(*), CAST(sum(n_chars + CAST(doc_id % 16 < 5 AS INT)) AS BIGINT) FROM documents WHERE doc_id % 3 = 0 OR doc_id % 16 < 5),
m AS (SELECT 0 AS step, 1 AS version, count(*) AS added, 0 AS replaced, count(DISTINCT doc_id % 16) AS rewritten FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 1, 1, 0, 0, 0
  UNION ALL SELECT 2, 2, count(*) FILTER (WHERE doc_id % 3 <> 0), count(*) FILTER (WHERE doc_id % 3 = 0), count(DISTINCT doc_id % 16) FROM documents WHERE doc_id % 16 < 5)
SELECT * FROM m JOIN v USING (version)""",
    "ledger_append": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "note_files": NOTE_SQL,
    "index_rebuild": "SELECT 'index' AS part, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'index.archive', count(*) FROM embeddings UNION ALL SELECT 'metadata', count(*) FROM embeddings WHERE vec_id % 2 = 0",
    "report_json": f"""WITH {_GATED}, b(bucket, status) AS (VALUES {", ".join(f"('{b}', '{s}')" for b, ss in sinks.BUCKETS for s in ss)})
SELECT 'r1' AS run, bucket, count(id) AS n, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM b LEFT JOIN gated g USING (status) GROUP BY bucket""",
    "report_markdown": f"""WITH {_GATED} SELECT value, count(*) AS n FROM (SELECT '| ' || id || ' | ' || severity || ' | ' || status || ' |' AS value FROM gated UNION ALL SELECT unnest(['# Findings', '', '| id | severity | status |', '| --- | --- | --- |'])) GROUP BY 1""",
    "slim_state": f"""SELECT key, CASE WHEN key = 'protocol_graph' THEN '<omitted>' WHEN json_type(TRY_CAST(value AS JSON)) = 'ARRAY' THEN '<list:' || json_array_length(TRY_CAST(value AS JSON)) || ' items>'
WHEN json_type(TRY_CAST(value AS JSON)) = 'OBJECT' AND length(value) > {sinks.SLIM_CHARS} THEN '<dict:' || len(json_keys(TRY_CAST(value AS JSON))) || ' keys; omitted>' ELSE value END AS value FROM {values_sql(STATE, "key, value")}""",
    "lesson_log": f"SELECT DISTINCT repo, lesson FROM {values_sql(LESSONS + MORE_LESSONS, 'repo, lesson')}",
    "listing_capped": "SELECT path, count(*) OVER () > 100 AS truncated FROM (SELECT DISTINCT url AS path FROM pages WHERE url IS NOT NULL) ORDER BY path LIMIT 100",
    "bounded_read": f"""WITH {sample.src_sql(sample.LINKED_SOURCES)} SELECT DISTINCT md5(left(text || chr(10), 400)) AS md5, length(text || chr(10)) > 400 AS truncated, len(string_split(left(text || chr(10), 400), chr(10))) AS n_lines FROM src""",
    "framework": f"""SELECT repo, CASE WHEN bool_or(regexp_matches(path, '(^|/)foundry.toml$')) THEN 'foundry' WHEN bool_or(regexp_matches(path, '(^|/)hardhat.config.(js|ts)$')) THEN 'hardhat' ELSE 'unknown' END AS framework FROM {values_sql(MARKERS, "repo, path")} GROUP BY repo""",
}
