from lodeline.operators import codefacts
from lodeline.sources import sample


def _suppliers(spark, path, n):
    spark.range(n).selectExpr("id + 1 as s_suppkey", "cast(id % 25 as int) as s_nationkey", "cast(id % 7 - 2 as double) as s_acctbal").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_repositories_of_a_small_file_are_many_tasks_that_grow_with_it(spark, tmp_path, monkeypatch):
    found = sample.repositories(spark, _suppliers(spark, tmp_path, 95), sample.LINKED_SOURCES)
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert found.count() == 19 * len(sample.LINKED_SOURCES) and found.select("repo").distinct().count() == 95
    monkeypatch.setattr(sample, "SUPPLIERS", 10)
    assert sample.repositories(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_ranges_of_functions_are_worked_out_once(spark, tmp_path, monkeypatch):
    calls, given = [], codefacts.L.function_ranges
    monkeypatch.setattr(codefacts.L, "function_ranges", lambda sources: calls.append(1) or given(sources))
    own = codefacts.facts(spark, _suppliers(spark, tmp_path, 10))
    assert own.functions.count() > 0 and len(calls) == 1
