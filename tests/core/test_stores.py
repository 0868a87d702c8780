import random

import pytest
from pyspark.sql import functions as F

from lodeline.operators.containment import contained
from lodeline.sources import sinks
from lodeline.sources.versions import VersionedCorpus
from lodeline.streaming.stateful import admitted


def rows_of(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_merges_versions_and_a_merge_that_fails(spark, tmp_path):
    corpus = VersionedCorpus(spark, f"file://{tmp_path}/c", "k", "k string, v int", 8)
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert corpus.read().count() == 0
    first = corpus.merge(make([("a", 1), ("b", 2), ("b", 5), (None, 9)] + [(f"x{i}", i) for i in range(40)]))
    assert (first["version"], first["added"], first["replaced"]) == (1, 42, 0)
    assert dict(rows_of(corpus.read()))["b"] == 5
    with pytest.raises(Exception, match="broken"):
        corpus.merge(make([("a", 1)]).withColumn("v", F.raise_error(F.lit("broken")).cast("int")))
    assert corpus.version() == 1
    second = corpus.merge(make([("a", 7), ("new", 8)]))
    assert (second["version"], second["added"], second["replaced"]) == (2, 1, 1) and second["rewritten"] <= 2
    assert dict(rows_of(corpus.read()))["a"] == 7 and dict(rows_of(corpus.read(1)))["a"] == 1 and corpus.read().count() == 43
    assert corpus.merge(make([]))["version"] == 2
    with pytest.raises(ValueError):
        corpus.read(9)


def test_rebuild_keeps_the_index_until_the_new_one_is_written(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    make = lambda n: spark.range(n).withColumnRenamed("id", "vec_id")
    sinks.build_index(make(4), root, {"model": "m"})
    with pytest.raises(Exception, match="broken"):
        sinks.rebuild_index(make(3).withColumn("vec_id", F.raise_error(F.lit("broken"))), root, {"model": "m"})
    assert spark.read.parquet(f"{root}/index").count() == 4
    sinks.rebuild_index(make(2), root, {"model": "m"})
    assert (spark.read.parquet(f"{root}/index").count(), spark.read.parquet(f"{root}/index.archive").count(), spark.read.json(f"{root}/index_metadata").first()["rows"]) == (2, 4, 2)


@pytest.mark.parametrize("block_chars", [10, 10**6])
def test_containment_equals_all_pairs(spark, block_chars):
    rng = random.Random(2)
    base = "".join(rng.choices("ab c", k=400))
    cut = lambda: base[(i := rng.randrange(380)) : i + rng.randrange(1, 40)]
    given = [(i, cut()) for i in range(40)] + [(100, None), (101, ""), (0, base), (102, base)]
    rows = [(i, cut() + rng.choice(["", "zz", cut()])) for i in range(60)] + [(900, base), (901, None), (902, ""), (5, base)]
    want = sorted((n, i, "row" if g in t else "given") for n, g in given for i, t in rows if g and t and (g in t or t in g))
    got = contained(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(given, "name long, text string"), block_chars)
    assert sorted(map(tuple, got.collect())) == want


def test_a_bucket_fills_up_and_waits():
    level, updated, waits = 0, None, []
    for at in (0, 1, 2, 3, 4, 1000, 999):
        level, updated, wait = admitted(level, updated, at, 2, 10)
        waits.append(wait)
    assert waits == [0, 0, 8, 17, 26, 0, 1]
