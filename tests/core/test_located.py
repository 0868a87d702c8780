import re

from lodeline.operators import codefacts as C
from lodeline.operators import slices as G
from lodeline.sources import lines as L
from lodeline.sources import sample

ODD = """contract A { uint256 a; address a;
    function one() external { a = 1; }
    function two(
        uint256 x
    ) external {
        uint256 y = a;
    }
    uint256 b;
}
contract B {
    bool b;
    function three() external { b = true; a = 2; }
}
a = 3;"""


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_once(spark):
    src = sample.sources(spark, sample.LINKED_SOURCES)
    rows = C.located(src, L.function_ranges(src))
    assert _plan(rows).count("Exchange hashpartitioning") == 1
    stored = spark.createDataFrame([], rows.schema)
    assert not any("Exchange" in _plan(facts(stored)) for facts in (C.call_edges, C.lifecycle_transitions, C.trust_boundaries))


def test_lines_are_sorted_once(spark):
    src = sample.sources(spark, sample.LINKED_SOURCES)
    assert _plan(C.located(src, L.function_ranges(src))).count("Sort [") == 1


def test_lines_lie_in_their_function_and_know_the_variables_they_mention(spark):
    src = spark.createDataFrame([("r", "src/A.sol", ODD), ("r", "src/N.sol", None)], "repo string, file_path string, text string")
    got = {r.line_no: (r.contract_name, r.function_name, sorted((v.name, v.type_name) for v in r.vars)) for r in C.located(src).collect()}
    assert len(got) == 14
    assert got[2] == ("A", "one", []) and got[8] == ("A", None, [("b", "uint256")])
    assert [got[i][1] for i in (3, 4, 5, 6, 7)] == ["two"] * 5
    assert got[12] == ("B", "three", [("b", "bool")]) and got[14] == ("A", None, [])


def test_facts_of_slices_do_not_join_lines_again(spark):
    own = C.Facts(sample.sources(spark, sample.LINKED_SOURCES))
    fns = G.functions_of(own)
    facts = G.slice_facts(own, fns, *G.slices(own, fns))
    assert not re.search(r"line_no#\d+ = line_no#\d+", facts._jdf.queryExecution().optimizedPlan().toString())
    assert facts.where("text is null").count() == 0
