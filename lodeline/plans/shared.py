"""Tables that cut lineage, and joins whose broadcast side is measured first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes of Parquet; above it, the join shuffles.
BROADCAST_BYTES = 24 << 20
#: The most rows and bytes of a batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves local mode (tests); a cluster without it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="lodeline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of batches to BATCH_ROWS and BATCH_BYTES, where they are higher or none.

    Both sides of a worker's pipe hold a batch, so its size, not the partition's, decides their memory.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(value: str) -> int:
    """A number with or without a unit of bytes; 0 if it is none."""
    digits = value.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    digits = digits[:-1] if unit else digits
    return int(digits) << unit if digits.isdigit() else 0


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a cached frame it survives the loss of executors, and unlike checkpoint() it keeps column
    pruning for the readers. The folder's name is the table's; ``discard`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files below a frame that ``materialise`` returned."""
    total = 0
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, target = _filesystem(df.sparkSession, path)
        total += fs.getContentSummary(target).getLength()
    return total


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, target = _filesystem(df.sparkSession, path)
            fs.delete(target, True)


def join_shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join by a shuffle of both sides, for sides that grow with the input.

    At run time a side of few shuffled bytes would be broadcast, and facts of code compress so well that it would fill the driver.
    """
    return left.join(right.hint("merge"), on, how)


def join_checked(large: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a materialised ``small`` side: broadcast if its files are below ``limit``, else by shuffle.

    Past the limit adaptive execution splits the partitions of hot keys.
    """
    return large.join(F.broadcast(small) if table_bytes(small) <= limit else small.hint("merge"), on, how)
