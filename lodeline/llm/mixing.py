"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a hashed order, form blocks. A source of weight w (a share of the slots) owns for its i-th
block the window [floor((i - 1) / w), ceil(i / w)): release time and deadline. One block is placed in each slot, the
released one of the earliest deadline. As the weights sum to 1 every block meets its window, so after any number of
slots a source has less than one block more or less than its weight asks for.

Weights are exact ratios: whole parts whose sum is the period, after which every source has just its share. Where the
period is at most RESOLUTION slots, the schedule of one period is a frame that repeats, and the driver works out that
frame only. Else the driver goes on from frame to frame of RESOLUTION slots with the open blocks carried over, and
holds a number for each block (BLOCK_ROWS rows) of the phase. When a source is used up, a new phase begins with the
weights of the rest, exact again: no row is dropped or repeated.

Sources without a target share OTHER.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.plans.shared import join_checked, materialise

RESOLUTION = 1000
BLOCK_ROWS = 64
#: Rows of a bucket of a source's order, and the most buckets a source.
BUCKET_ROWS, MOST_BUCKETS = 1000, 65_536
#: Name of all sources without a target weight.
OTHER = ""
#: Targets of the registered query and of the pipeline.
TARGETS = {"src0": 0.23, OTHER: 0.01} | {f"src{i}": 0.04 for i in range(1, 20)}


def whole_slots(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Weights rounded to whole slots of a frame: largest remainders, at least one each. Schedules use ``whole_parts``."""
    total = sum(weights.values())
    exact = {s: w / total * resolution for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := resolution - sum(slots.values())) != 0:
        step = 1 if left > 0 else -1
        pick = max((s for s in slots if slots[s] + step >= 1), key=lambda s: (step * (exact[s] - slots[s]), s))
        slots[pick] += step
    return slots


def whole_parts(weights: dict[str, float]) -> dict[str, int]:
    """The weights, as the decimal numbers that they are written as, in whole parts without a common divisor."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * unit) for s, x in exact.items()}
    divisor = math.gcd(*parts.values())
    return {s: a // divisor for s, a in parts.items()}


def turns(parts: dict[str, int]) -> Iterator[str]:
    """Earliest deadline first without end: the source of each slot."""
    size = sum(parts.values())
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in sorted(parts)]
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, source, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * size // parts[source]), source, i))
        deadline, source, i = heapq.heappop(ready)
        assert t < deadline, "feasible weights met no deadline"
        yield source
        heapq.heappush(waiting, ((i + 1) * size // parts[source], source, i + 1))
        t += 1


def frame(slots: dict[str, int]) -> dict[str, list[int]]:
    """Earliest deadline first over one frame: the slots that each source gets."""
    given: dict[str, list[int]] = {s: [] for s in slots}
    for t, source in enumerate(islice(turns(slots), sum(slots.values()))):
        given[source].append(t)
    return given


def _schedule(blocks: dict[str, int], weights: dict[str, float], resolution: int) -> Iterator[tuple]:
    """The rows of ``phases``, each with the releases and deadlines of its frame's blocks, counted as its slots are."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start, phase = dict.fromkeys(left, 0), 0, 0
    while left:
        parts = whole_parts({s: weights[s] for s in left})
        period = sum(parts.values())
        placed = dict.fromkeys(left, 0)  # in this phase
        order, at = turns(parts), 0
        while all(placed[s] < n for s, n in left.items()):
            if period <= resolution:
                size, given = period, frame(parts)
                # the phase ends with the last block of the source that is used up first
                end = min((n - 1) // parts[s] * size + given[s][(n - 1) % parts[s]] for s, n in left.items()) + 1
                used = {s: end // size * parts[s] + bisect_left(given[s], end % size) for s in left}
            else:
                size, given, end = resolution, {s: [] for s in left}, 0
                while end < size and all(placed[s] + len(own) < left[s] for s, own in given.items()):
                    given[next(order)].append(end)
                    end += 1
                used = {s: len(own) for s, own in given.items()}
            for s in sorted(left):
                if used[s]:
                    first, numbers = done[s] + placed[s], range(placed[s], placed[s] + len(given[s]))
                    releases = [i * period // parts[s] - at for i in numbers]
                    deadlines = [-(-(i + 1) * period // parts[s]) - at for i in numbers]
                    yield s, phase, first, first + used[s], start + at, size, given[s], releases, deadlines
                placed[s] += used[s]
            at += end
        done = {s: n + placed.get(s, 0) for s, n in done.items()}
        left = {s: blocks[s] - done[s] for s in left if blocks[s] > done[s]}
        start, phase = start + at, phase + 1


def phases(blocks: dict[str, int], weights: dict[str, float], resolution: int = RESOLUTION) -> list[tuple]:
    """(source, phase, first block, end block, first slot, frame size, slots of a frame) until all blocks are placed."""
    return [row[:7] for row in _schedule(blocks, weights, resolution)]


def _named(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin([s for s in weights if s != OTHER]), source).otherwise(F.lit(OTHER))


def _placed(docs: DataFrame, weights: dict[str, float], block_rows: int, resolution: int) -> DataFrame:
    """(row, mixed): each row of ``docs`` as a struct, and its place."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("target weights must be positive")
    weights = {OTHER: min(weights.values())} | weights
    payload = [c for c in docs.columns if c in ("doc_id", "text")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), _named(F.col("source"), weights).alias("of"), F.pmod(F.xxhash64(*payload), F.lit(1 << 40)).alias("draw"), F.xxhash64("source", *payload).alias("tie"))
    counts = {r["of"]: r["n"] for r in rows.groupBy("of").agg(F.count("*").alias("n")).collect()}  # at most one a target
    spark = docs.sparkSession
    buckets = spark.createDataFrame([(s, max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))) for s, n in counts.items()], "of string, buckets long")
    plan = spark.createDataFrame(list(_schedule({s: -(-n // block_rows) for s, n in counts.items()}, weights, resolution)), "of string, phase int, first long, beyond long, start long, size long, slots array<int>, releases array<long>, deadlines array<long>")

    rows = rows.join(F.broadcast(buckets), "of").withColumn("bucket", F.floor(F.col("draw") * F.col("buckets") / F.lit(1 << 40)).cast("int")).drop("buckets")
    offsets = rows.groupBy("of", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(offsets.select("of", "bucket", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")  # a row for each BUCKET_ROWS
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("of", "bucket").orderBy("draw", "tie")))
    index = F.col("offset") + F.col("rank") - 1
    placed = join_checked(ranked, offsets, ["of", "bucket"]).withColumn("block", F.floor(index / F.lit(block_rows))).withColumn("within", index % F.lit(block_rows))
    placed = placed.join(F.broadcast(plan.withColumnRenamed("of", "planned")), (F.col("of") == F.col("planned")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("beyond")))
    local, a = F.col("block") - F.col("first"), F.size("slots")
    frame_start, nth = F.col("start") + F.floor(local / a) * F.col("size"), (local % a + 1).cast("int")
    slot = frame_start + F.element_at("slots", nth)
    return placed.select(
        "row",
        F.struct(
            (slot * block_rows + F.col("within")).alias("position"),
            slot.alias("slot"),
            "phase",
            "block",
            (frame_start + F.element_at("releases", nth)).alias("release"),
            (frame_start + F.element_at("deadlines", nth)).alias("deadline"),
        ).alias("mixed"),
    )


def mix(docs: DataFrame, weights: dict[str, float], block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``mixed``: position, slot, phase, block, release, deadline.

    ``position`` orders the mixture. Null and unlisted sources share OTHER (weight: that of OTHER, else the least).
    Rows with the same doc_id, or none, are ordered by their text's hash; equal rows may change places. Weights must
    be positive. A column of ``docs`` named mixed is replaced. An empty table gives an empty result.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c != "mixed"]
    return _placed(docs, weights, block_rows, resolution).select(*own, "mixed")


def mixed_order(docs: DataFrame, weights: dict[str, float], block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture: files of a written table follow each other in it."""
    position = F.col("mixed.position")
    return _placed(docs, weights, block_rows, resolution).repartitionByRange(position).sortWithinPartitions(position).select("row.*")


def written_order(docs: DataFrame) -> DataFrame:
    """The rows of a table that Spark wrote, read from its Parquet files, with their ``position``: 0, 1, ... in file order.

    Readers deal files out by size, so a frame's own order says nothing; the numbers of the written partition and of
    its file, and the row's number within the file, do. Of each file only its name and count are gathered.
    """
    name = F.col("_metadata.file_name")
    rows = docs.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = docs.select(name.alias("_file")).groupBy("_file").agg(F.count("*").alias("n"))
    numbers = [F.regexp_extract("_file", pattern, 1).try_cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    before = F.sum("n").over(Window.orderBy(*numbers, "_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(files), "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every document in the mixture of all sources to TARGETS."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, TARGETS).select("doc_id", "source", "mixed.*")


QUERIES = {"op3_mixing": op3_mixing}
#: No SQL: earliest deadline first is iterative; tests check the windows and deviations of every slot.
ORACLE: dict[str, str] = {}
