"""A stored corpus in buckets, with versions: a merge rewrites the buckets it touches and swaps one pointer.

``manifests/<n>.json`` lists the folder of each bucket in version n; ``current`` names the version that counts. A merge
writes new folders and a new manifest before it replaces ``current``, so a merge that fails leaves the version before as it was,
and every version stays readable. One writer at a time: a merge fails if another one has swapped the pointer meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.plans.shared import _filesystem, discard, materialise


class Conflict(RuntimeError):
    """Another merge has made the version that this one was to make."""


class VersionedCorpus:
    """Rows by key in ``buckets`` buckets below ``path``; ``bucket_of`` names a row's bucket (a hash of the key unless given)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64, bucket_of: Column | None = None):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.bucket_of = (F.pmod(F.xxhash64(key), F.lit(buckets)) if bucket_of is None else bucket_of).cast("int")

    def _write(self, name: str, text: str) -> None:
        """A small file, in place at once or not at all."""
        fs, target = _filesystem(self.spark, f"{self.path}/{name}")
        _, draft = _filesystem(self.spark, f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, target, options)

    def _read(self, name: str) -> str | None:
        fs, target = _filesystem(self.spark, f"{self.path}/{name}")
        if not fs.exists(target):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())  # a small file of this class

    def version(self) -> int:
        """The version that counts; 0 before the first merge."""
        return int(self._read("current") or 0)

    def manifest(self, version: int) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        if not version:
            return {}
        text = self._read(f"manifests/{version}.json")
        if text is None:
            raise ValueError(f"there is no version {version}")
        return {int(b): folder for b, folder in json.loads(text)["buckets"].items()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one unless given."""
        folders = sorted(self.manifest(self.version() if version is None else version).values())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def merge(self, rows: DataFrame, order: Column | None = None) -> dict[str, int]:
        """Upsert rows by key: a new row replaces a stored one. Of new rows of one key the last by ``order`` counts; null keys are left out.

        Returns version, added, replaced, rewritten (buckets). Only the touched buckets are read and written.
        """
        before = self.version()
        known = self.manifest(before)
        columns = self.spark.createDataFrame([], self.schema).columns
        given = rows.where(F.col(self.key).isNotNull()).select(*columns)
        latest = F.max_by(F.struct(*columns), F.struct(*columns) if order is None else order)
        fresh = materialise(given.groupBy(self.key).agg(latest.alias("row")).select("row.*").withColumn("_bucket", self.bucket_of), "merge-rows")
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # numbers of buckets
        if not touched:
            discard(fresh)
            return {"version": before, "added": 0, "replaced": 0, "rewritten": 0}
        old = [f"{self.path}/{known[b]}" for b in touched if b in known]
        stored = self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)
        replaced = stored.select(self.key).join(fresh.select(self.key), self.key, "left_semi").count() if old else 0
        kept = stored.join(fresh.select(self.key), self.key, "left_anti").withColumn("_bucket", self.bucket_of).select(*columns, "_bucket")
        folder = f"data/{before + 1}-{uuid.uuid4().hex}"
        kept.unionByName(fresh.select(*columns, "_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        added = fresh.count() - replaced
        discard(fresh)
        if self.version() != before:
            raise Conflict(f"version {before + 1} has been made meanwhile")
        after = known | {b: f"{folder}/_bucket={b}" for b in touched}
        self._write(f"manifests/{before + 1}.json", json.dumps({"buckets": after, "added": added, "replaced": replaced}))
        self._write("current", str(before + 1))
        return {"version": before + 1, "added": added, "replaced": replaced, "rewritten": len(touched)}
