"""Functions and their lines are cut from their own text: no join, so nothing that could be broadcast."""

import pytest
from lodeline.operators import detect, extract, packets, scan
from lodeline.sources import lines as L
from lodeline.sources import sample

SMALLEST = "/root/testdata/sf0.001"
TEXTS = (
    ("two", "// head\r\ncontract A {\r\n  function f() public {\r\n    g();\r\n  }\r\n  function g()\r\n    internal\r\n  {\r\n    x = 1;\r\n  }\r\n}\r\n"),
    ("whole", "function f() { x; }"),
    ("adjacent", "contract A {\n function f() { x; }\n function g() { f(); }\n}"),
    ("none", "a\nb\n"),
    ("empty", ""),
    ("null", None),
)


def test_held_lines(spark):
    src = spark.createDataFrame(TEXTS, "k string, text string")
    columns = ["k", "line_no", "raw", "contract_name", "function_name", "start_line", "end_line", "signature"]
    held = lambda df: sorted(map(tuple, df.select(columns).collect()), key=str)
    got = held(L.held_lines(src))
    assert got == held(L.containing(L.to_lines(src), L.function_ranges(src), ["k"]))
    assert sum(r[4] is not None for r in got) == 3 + 5 + 1 + 2
    bodies = {(r.k, r.function_name): "\n".join(r.body) for r in L.bodies(src).collect()}
    assert bodies[("two", "f")] == "  function f() public {\n    g();\n  }" and len(bodies) == 5


def test_callers(spark):
    src = spark.createDataFrame([("r", "a", TEXTS[0][1]), ("r", "b", "contract B {\n function h() { f(); h(); far(); }\n}"), ("s", "a", "function far() { f(); }")], "repo string, file_path string, text string")
    assert {tuple(r) for r in packets.callers(src).select("repo", "caller", "callee").collect()} == {("r", "f", "g"), ("r", "h", "f")}


@pytest.mark.parametrize("query", [packets.q_caller_mentions, extract.q_slice_scoring, detect.q_interval_join, scan.q_body_concat, detect.q_first_call_then_accounting])
def test_no_join(spark, query):
    """Only the few patterns of the sample meet the suppliers by a join."""
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(query(spark, SMALLEST)) == joins(sample.repositories(spark, SMALLEST)) == 1
