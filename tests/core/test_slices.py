import random

import pytest
from pyspark.sql import functions as F

from lodeline.operators.relate import sessions
from lodeline.plans.slices import sliced, with_nearest, with_running_sum


@pytest.mark.parametrize("slices", [1, 7, 50])
def test_slices_give_what_whole_keys_give(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(60)]), i, rng.choice([None, i])) for i in range(300)]
    own = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        own.setdefault(k, []).append((i, v))
    want = []
    for k, seq in own.items():
        for at, (i, v) in enumerate(seq):
            before = [x for _, x in seq[:at] if x is not None]
            after = [x for _, x in seq[at + 1 :] if x is not None]
            want.append((i, before[-1] if before else None, after[0] if after else None, at + 1))
    df = sliced(spark.createDataFrame(rows, "k string, t long, i long, v long"), F.col("t"), slices)
    df = with_nearest(df, ["k"], ["t", "i"], F.col("v"), "before")
    df = with_nearest(df, ["k"], ["t", "i"], F.col("v"), "behind", after=True)
    df = with_running_sum(df, ["k"], ["t", "i"], F.lit(1), "nth")
    assert sorted((r.i, r.before, r.behind, r.nth) for r in df.collect()) == sorted(want)


def test_sessions_go_on_over_slices(spark):
    events = spark.range(200).selectExpr("id AS event_id", "id % 2 AS user_id", "timestamp_seconds(id * 600 + (id DIV 40) * 7200) AS ts")
    got = {r.user_id: r.n for r in sessions(events, 30, 20).groupBy("user_id").agg(F.max("session").alias("n")).collect()}
    assert got == {0: 5, 1: 5}
