"""Streams with keyed state: a token bucket with timers, and deliveries with late rows, repeated rows and sessions.

State is bounded in all of them: a bucket is forgotten when it would be full again, a delivered id when the watermark has passed
it by the delay, a session when the watermark has passed its end. Files, progress and results lie in the shared folder, so a run
can be taken up after a failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodeline.plans.shared import shared_dir
from lodeline.streaming.ledger import read

#: Calls that a bucket holds, and microseconds in which one is filled up.
CAPACITY, REFILL_US = 3, 12 * 3600 * 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Deliveries of the events, the share of rows that come one delivery late (one in so many), and of those that come twice.
DELIVERIES, LATE_EVERY, TWICE_EVERY = 3, 50, 40
#: How late a row may be, and the silence that ends a session.
DELAY_DAYS, GAP_HOURS = 9, 6


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def admitted(level: int, updated: int | None, at: int, capacity: int, refill: int) -> tuple[int, int, int]:
    """(level, updated, wait) after a call at ``at``: all in microseconds, a call costing ``refill`` of the level."""
    if updated is None:
        return (capacity - 1) * refill, at, 0
    now = max(at, updated)
    level = min(capacity * refill, level + now - updated)
    if level >= refill:
        return level - refill, now, now - at
    return 0, now + refill - level, now - at + refill - level


class TokenBucket(StatefulProcessor):
    """A bucket a key. A call takes a token or waits for the next one; a timer clears a bucket that is full again."""

    def __init__(self, capacity: int, refill: int):
        self.capacity, self.refill = capacity, refill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "level long, updated long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", "event_id"], ignore_index=True)
        level, updated = self.bucket.get() if self.bucket.exists() else (0, None)
        waits = []
        for at in calls["at"].tolist():
            level, updated, wait = admitted(level, updated, at, self.capacity, self.refill)
            waits.append(wait)
        self.bucket.update((level, updated))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((updated + self.capacity * self.refill - level) // 1000 + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": calls["event_id"], "wait_us": waits})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        yield from ()

    def close(self) -> None:
        pass


def admissions(calls: DataFrame, capacity: int = CAPACITY, refill_us: int = REFILL_US) -> DataFrame:
    """user_id, event_id, wait_us of a stream (user_id, event_id, ts): how long each call waits for a token.

    Calls of a batch are taken in the order of (ts, event_id); a call older than the bucket's last one waits for that. Null
    keys and times are left out; a repeated row is another call.
    """
    given = calls.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    given = given.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
    return given.groupBy("user_id").transformWithStateInPandas(TokenBucket(capacity, refill_us), "user_id long, event_id long, wait_us long", "append", "eventTime")


def _drained(stream: DataFrame, base: str, name: str, mode: str = "append") -> None:
    """Run a stream until no input is left; its rows are appended below ``base``."""
    stream.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def deliver(events: DataFrame, path: str, number: int) -> None:
    """Write a delivery: a tenth-day share of the events by time, those that are late from the one before, and some of that again."""
    own = F.floor(F.dayofmonth("ts") / F.lit(-(-32 // DELIVERIES))).cast("int")
    late = (F.col("event_id") % LATE_EVERY == 0).cast("int")
    again = events.where((own + 1 == number) & (F.col("event_id") % TWICE_EVERY == 1))
    events.where(F.least(own + late, F.lit(DELIVERIES - 1)) == number).unionByName(again).write.mode("append").parquet(path)


class Deliveries:
    """A folder of deliveries, split on arrival into rows in time and late ones, and the sessions of the former.

    A row is late if its time lies more than the delay before the latest one of earlier deliveries.
    """

    def __init__(self, spark: SparkSession, schema, base: str):
        self.spark, self.schema, self.base = spark, schema, base

    def _split(self, rows: DataFrame, batch: int) -> None:
        """Both parts of a batch, each in a folder of its own, so a batch that is run again replaces what it wrote."""
        seen = [f"{self.base}/seen/{b}" for b in range(batch)]
        latest = self.spark.read.parquet(*seen).agg(F.max("ts")).first()[0] if seen else None
        rows = rows.persist()
        late = F.lit(False) if latest is None else F.col("ts") < F.lit(latest) - F.expr(f"INTERVAL {DELAY_DAYS} DAYS")
        rows.where(~late).write.mode("overwrite").parquet(f"{self.base}/kept/batch={batch}")
        rows.where(late).write.mode("overwrite").parquet(f"{self.base}/late/batch={batch}")
        rows.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.base}/seen/{batch}")
        rows.unpersist()

    def take_in(self) -> None:
        """Split what has been delivered since."""
        arrived = self.spark.readStream.schema(self.schema).parquet(f"{self.base}/delivered")
        arrived.writeStream.foreachBatch(self._split).option("checkpointLocation", f"{self.base}/split-progress").trigger(availableNow=True).start().awaitTermination()

    def count_sessions(self) -> None:
        """Sessions of the rows in time, each id once: repeated ids within the delay are dropped."""
        kept = self.spark.readStream.schema(self.schema).parquet(f"{self.base}/kept").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{DELAY_DAYS} days")
        once = kept.dropDuplicatesWithinWatermark(["event_id"])
        sessions = once.groupBy(F.session_window("ts", f"{GAP_HOURS} hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
        _drained(sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"), self.base, "sessions")

    def close(self) -> None:
        """End all sessions: a row of no user far in the future moves the watermark past them."""
        end = self.spark.read.schema(self.schema).parquet(f"{self.base}/kept").agg((F.max("ts") + F.expr(f"INTERVAL {DELAY_DAYS + 365} DAYS")).alias("ts"))
        end.where("ts is not null").select(*(F.col("ts").cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{self.base}/kept/batch={1 << 20}")
        self.count_sessions()


def received(spark: SparkSession, sf_dir: str) -> Deliveries:
    """The events in DELIVERIES parts, each taken in by the streams before the next one comes."""
    events = read(spark, sf_dir)
    out = Deliveries(spark, events.schema, f"{shared_dir(spark)}/lodeline/deliveries-{uuid.uuid4().hex}")
    for number in range(DELIVERIES):
        deliver(events, f"{out.base}/delivered", number)
        out.take_in()
        out.count_sessions()
    out.close()
    return out


def q_token_bucket_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user, those that had to wait for a token, and how long, off a stream."""
    base = f"{shared_dir(spark)}/lodeline/token-bucket-{uuid.uuid4().hex}"
    with _conf(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        stream = spark.readStream.schema(read(spark, sf_dir).schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
        _drained(admissions(stream), base, "admissions")
    found = spark.read.schema("user_id long, event_id long, wait_us long").parquet(f"{base}/admissions")
    return found.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("wait_us") > 0).alias("waited"), F.sum("wait_us").alias("wait_us"), F.max("wait_us").alias("longest_us"))


def q_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user over deliveries with late and repeated rows."""
    out = received(spark, sf_dir)
    sessions = spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{out.base}/sessions").where("user_id is not null")
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("most"), F.max(F.unix_micros("end") - F.unix_micros("start")).alias("longest_us"))


def q_late_rows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the side table of late rows, by type."""
    out = received(spark, sf_dir)
    return spark.read.schema(out.schema).parquet(f"{out.base}/late").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_DAYS = -(-32 // DELIVERIES)
_DELIVERED = f"""o AS (SELECT *, CAST(floor(day(ts) / {_DAYS}) AS INT) AS own FROM events),
arrived AS (SELECT *, least(own + CAST(event_id % {LATE_EVERY} = 0 AS INT), {DELIVERIES - 1}) AS batch FROM o UNION ALL SELECT *, own + 1 FROM o WHERE event_id % {TWICE_EVERY} = 1 AND own + 1 < {DELIVERIES}),
marks AS (SELECT b.batch, (SELECT max(ts) FROM arrived a WHERE a.batch < b.batch) - INTERVAL {DELAY_DAYS} DAY AS mark FROM (SELECT DISTINCT batch FROM arrived) b),
judged AS (SELECT a.*, coalesce(a.ts < mark, false) AS late FROM arrived a JOIN marks USING (batch))"""
ORACLE = {
    "token_bucket_stream": f"""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS came, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (
  SELECT user_id, nth, {(CAPACITY - 1) * REFILL_US}::BIGINT AS level, came AS updated, 0::BIGINT AS wait FROM c WHERE nth = 1
  UNION ALL
  SELECT user_id, nth, CASE WHEN have >= {REFILL_US} THEN have - {REFILL_US} ELSE 0 END, CASE WHEN have >= {REFILL_US} THEN now ELSE now + {REFILL_US} - have END, CASE WHEN have >= {REFILL_US} THEN now - came ELSE now - came + {REFILL_US} - have END
  FROM (SELECT c.user_id, c.nth, c.came, greatest(c.came, b.updated) AS now, least({CAPACITY * REFILL_US}, b.level + greatest(c.came, b.updated) - b.updated) AS have FROM b JOIN c ON c.user_id = b.user_id AND c.nth = b.nth + 1))
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE wait > 0) AS waited, CAST(sum(wait) AS BIGINT) AS wait_us, max(wait) AS longest_us FROM b GROUP BY 1""",
    "session_stream": f"""WITH {_DELIVERED},
once AS (SELECT DISTINCT ON (event_id) user_id, event_id, ts FROM judged WHERE NOT late ORDER BY event_id, batch),
g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER w >= INTERVAL {GAP_HOURS} HOUR, true) AS INT) AS fresh FROM once WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
x AS (SELECT user_id, session, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) + {GAP_HOURS * 3600 * 1_000_000} AS us FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS most, max(us) AS longest_us FROM x GROUP BY 1""",
    "late_rows_stream": f"WITH {_DELIVERED} SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM judged WHERE late GROUP BY 1",
}
