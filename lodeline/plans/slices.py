"""Windows over keys that may hold any share of the rows: by (key, slice of the order), with what earlier slices carry over.

Slices are quantiles of all rows' order, so a task sees about a SLICES-th of a key's rows at most; what a slice passes on is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 128
SLICE = "_slice"


def sliced(rows: DataFrame, at: Column, slices: int = SLICES) -> DataFrame:
    """``rows`` with the number of their slice; nulls are in the first. ``at`` is a number."""
    inner = [i / slices for i in range(1, slices)]
    bounds = sorted(set(rows.agg(F.percentile_approx(at, F.lit(inner), 10 * slices)).first()[0] or [])) if inner else []
    number = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= at)) if bounds else F.lit(0)
    return rows.withColumn(SLICE, F.when(at.isNull(), F.lit(0)).otherwise(number))


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their (keys, slice); null keys meet each other."""
    same = [rows[k].eqNullSafe(carried[k]) for k in (*keys, SLICE)]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return rows.join(carried, condition, "left").select(rows["*"], *(carried[c] for c in carried.columns if c not in (*keys, SLICE)))


def with_nearest(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, after: bool = False) -> DataFrame:
    """The last non-null ``value`` of the rows before (or the first of those after), of sliced rows, as the column ``name``."""
    way = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    within = Window.partitionBy(*keys, SLICE).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, -1)
    given = rows.withColumn("_value", value)
    at_end = F.min_by if after else F.max_by
    ends = given.groupBy(*keys, SLICE).agg(at_end("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(way(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SLICE, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    found = _joined(given.withColumn("_inside", F.last("_value", ignorenulls=True).over(within)), carried, keys)
    return found.withColumn(name, F.coalesce("_inside", "_carried")).drop("_value", "_inside", "_carried")


def with_running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to and with each row, of sliced rows, as the column ``name``."""
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    given = rows.withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = given.groupBy(*keys, SLICE).agg(F.sum("_value").alias("_sum")).select(*keys, SLICE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    found = _joined(given.withColumn("_inside", F.sum("_value").over(within)), sums, keys)
    return found.withColumn(name, F.col("_inside") + F.coalesce("_carried", F.lit(0))).drop("_value", "_inside", "_carried")
