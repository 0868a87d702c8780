import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.operators import vector_index as V
from lodeline.operators.lexical_index import LexicalIndex


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def best(q, x, names, k):
    """The k best (score, id) of each query by all products."""
    out = {}
    for name, v in zip(names, q, strict=True):
        s = np.round(x.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float), 6)
        out[name] = [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != name][:k]
    return out


def test_exact_mode_equals_all_products_with_a_hot_list(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (250, 1)) + rng.normal(scale=1e-4, size=(250, 8)), np.tile(rng.normal(size=(1, 8)), (40, 1))])
    monkeypatch.setattr(V, "SLICE_ROWS", 60)
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    rows = vectors(spark, x).unionByName(spark.createDataFrame([(9999, None)], "vec_id long, embedding array<float>"))
    index = V.VectorIndex.build(rows, str(tmp_path / "index"))
    assert index.rows.count() == len(x) and index.lists.agg(F.max("slices")).first()[0] > 1
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in index.search(queries, 5, exact=True, probed=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == best(x[::20], x, range(0, len(x), 20), 5)
    again = V.VectorIndex(spark, str(tmp_path / "index"))  # opened from its files
    assert again.calibrate(5) <= len(again.names)
    found = {(r.query_id, r.vec_id) for r in again.search(queries, 5).collect()}
    assert len({(q, v) for q, vs in got.items() for v in vs} & found) >= 0.8 * sum(map(len, got.values()))


def test_fewer_rows_than_matches(spark, tmp_path):
    index = V.VectorIndex.build(vectors(spark, np.eye(4)), str(tmp_path / "index"))
    found = index.search(vectors(spark, np.eye(4)).withColumnRenamed("vec_id", "query_id"), 10, exact=True)
    assert found.count() == 12


@pytest.mark.parametrize("slice_docs", [7, 10_000])
def test_lexical_index_equals_counting_terms(spark, tmp_path, slice_docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i * 5, sorted(set(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 6, 25]))))) for i in range(150)] + [(None, ["w1"])]
    queries = [(i, 1, [words[i]]) if i % 3 else (i, 9, rng.sample(words, 9)) for i in range(12)] + [(99, 0, []), (98, 1, ["unknown"])]
    index = LexicalIndex.build(spark.createDataFrame(docs, "doc_id long, terms array<string>"), str(tmp_path / "index"), slice_docs)
    got = {}
    for r in index.search(spark.createDataFrame(queries, "query_id long, n int, terms array<string>"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {}
    for q, n, own in queries:
        scored = sorted((-len(set(own) & set(t)), d) for d, t in docs if d is not None and set(own) & set(t))[:4]
        if scored:
            want[q] = [(d, round(-s / max(4, n), 6)) for s, d in scored]
    assert got == want
