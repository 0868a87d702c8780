import random

import pytest

from lodeline.functions.packing import register


def naive(rows, budget):
    used, seen, covered, out = 0, set(), set(), []
    for way in ("breadth", "depth"):
        for item, cover, size in rows:
            if item in seen or not size or used + size > budget or (way == "breadth" and cover in covered):
                continue
            used += size
            seen.add(item)
            covered.add(cover)
            out.append((item, cover, size, way, len(out) + 1, used))
    return out


def test_packing_equals_two_passes(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice("abcd"), rng.choice([None, 0, 1, 2, 3, 7, 30, 200])) for g in range(30) for i in range(rng.choice([0, 1, 9, 60]))]
    register(spark)
    table = spark.createDataFrame(rows, "g int, i int, c string, n int")
    for budget in (0, 5, 40, 1000):
        found = spark.sql(f"SELECT * FROM packed(TABLE({{t}}) PARTITION BY g ORDER BY i, budget => {budget}, item => 'k', cover => 'c', size => 'n')", t=table.selectExpr("g", "i", "struct(g, i) k", "c", "n"))
        got = sorted((r["item"].g, r["place"], r["item"].i, r["cover"], r["size"], r["pass"], r["used"]) for r in found.collect())
        want = sorted((g, p, i, c, n, way, used) for g in range(30) for i, c, n, way, p, used in naive([r[1:] for r in rows if r[0] == g], budget))
        assert got == want


def test_wrong_columns_are_refused(spark):
    register(spark)
    with pytest.raises(Exception, match="no column x"):
        spark.sql("SELECT * FROM packed(TABLE({t}), budget => 1, item => 'x', cover => 'id', size => 'id')", t=spark.range(3)).collect()
