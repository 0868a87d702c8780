"""Packing under a budget as a table function of SQL: breadth first, then depth.

    packed(TABLE(t) PARTITION BY g ORDER BY priority, budget => 4000, item => 'id', cover => 'role', size => 'chars')

takes the rows of each partition in order: first one row of every ``cover`` value, then whatever still fits. A row that does not fit
is passed over, later smaller ones are not. The columns are named by the caller, and the result has their types.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Packed:
    """Holds of a partition only what may still be chosen: of each size as many rows as would fill the budget."""

    @staticmethod
    def analyze(table: AnalyzeArgument, budget: AnalyzeArgument, item: AnalyzeArgument, cover: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument of packed is a TABLE")
        if not isinstance(budget.value, int) or budget.value < 0:
            raise ValueError("the budget of packed is a number of 0 or more")
        known = {f.name: f.dataType for f in table.dataType.fields}
        for what in (item, cover, size):
            if what.value not in known:
                raise ValueError(f"the table of packed has no column {what.value}")
        kinds = known[item.value], known[cover.value]
        return AnalyzeResult(StructType().add("item", kinds[0]).add("cover", kinds[1]).add("size", LongType()).add("pass", StringType()).add("place", IntegerType()).add("used", LongType()))

    def __init__(self):
        self.used, self.chosen, self.covered, self.waiting, self.held = 0, [], set(), [], Counter()
        self.budget = 0

    def _fits(self, size: int) -> bool:
        return self.used + size <= self.budget

    def _take(self, item, cover, size: int, name: str) -> None:
        self.used += size
        self.chosen.append((item, cover, size, name, len(self.chosen) + 1, self.used))

    def eval(self, table: Row, budget: int, item: str, cover: str, size: str) -> Iterator[tuple]:
        self.budget = budget
        size_of = table[size]
        if not size_of or size_of < 0 or not self._fits(size_of):  # what does not fit now never will
            return
        if table[cover] not in self.covered:
            self.covered.add(table[cover])
            self._take(table[item], table[cover], size_of, "breadth")
        elif self.held[size_of] < (self.budget - self.used) // size_of:
            self.held[size_of] += 1
            self.waiting.append((table[item], table[cover], size_of))
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        for item, cover, size in self.waiting:
            if self._fits(size):
                self._take(item, cover, size, "depth")
        yield from self.chosen


def register(spark: SparkSession) -> None:
    """Make ``packed`` known to the session's SQL."""
    spark.udtf.register("packed", F.udtf(Packed))
