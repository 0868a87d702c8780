import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.plans.registry import Operator, Registry, SchemaMismatch, canonical_hash

NEEDS = T.StructType([T.StructField("id", T.LongType())])
GIVES = T.StructType([T.StructField("twice", T.LongType())])


def test_calls_are_checked_counted_and_kept(spark):
    registry = Registry(budget=4)
    registry.register(Operator("math.double", lambda rows, by=2: rows.select((F.col("id") * by).alias("twice")), {"rows": NEEDS}, GIVES))
    registry.register(Operator("math.wrong", lambda rows: rows, {"rows": NEEDS}, GIVES))
    registry.register(Operator("text.none", lambda: None))
    with pytest.raises(ValueError):
        registry.register(Operator("text.none", lambda: None))
    rows = spark.range(3)
    assert [r.twice for r in registry.call("math.double", {"rows": rows}, by=3).collect()] == [0, 3, 6]
    with pytest.raises(SchemaMismatch):
        registry.call("math.double", {"rows": rows.select(F.col("id").cast("string").alias("id"))})
    with pytest.raises(SchemaMismatch):
        registry.call("math.wrong", {"rows": rows})
    with pytest.raises(KeyError):
        registry.call("math.absent", {})
    with pytest.raises(RuntimeError):
        registry.call("math.double", {"rows": rows})
    assert [(r.operator, r.status) for r in registry.ledger(spark).orderBy("call_id").collect()] == [("math.double", "ok"), ("math.double", "failed"), ("math.wrong", "failed"), ("math.absent", "failed")]
    assert registry.names("math") == ["math.double", "math.wrong"] and len(registry.scoped(["text.none"])) == 1
    assert canonical_hash({"b": 1, "a": 2}) == canonical_hash({"a": 2, "b": 1})
