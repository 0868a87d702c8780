import os

import pytest

from lodeline.operators import codefacts as C
from lodeline.operators import hypotheses as H
from lodeline.operators import planner as P
from lodeline.operators import retrieve as V
from lodeline.operators import slices as G
from lodeline.sources import files, sample, sinks
from lodeline.sources import lines as L

TOKENS = """contract Nft is ERC721 {}
contract Shop {
    IERC20 coin;
    Nft badge;
    function a(address to) external {
        coin.transfer(to, 1);
        badge.transferFrom(msg.sender, to, 1);
        require(coin.transfer(to, 2));
        bool ok = coin.transfer(to, 3);
        nftPool.approve(to, 4);
        IERC20(addr).approve(to, 5);
        target.call(abi.encodeWithSelector(IERC20.transfer.selector, to));
    }
}
"""


@pytest.fixture(scope="module")
def own(spark):
    return C.Facts(sample.sources(spark, sample.LINKED_SOURCES))


def test_unchecked_returns_leave_other_tokens_alone(spark):
    src = spark.createDataFrame([("r", "src/Shop.sol", TOKENS)], "repo string, file_path string, text string")
    got = {r.line_no: (r.receiver, r.kind) for r in C.unchecked_returns(C.located(src), C.token_types(src)).collect()}
    assert got == {6: ("coin", "erc20"), 11: ("IERC20", "erc20"), 12: (None, "unknown")}


def test_facts_of_odd_sources(spark):
    rows = [("r", "src/a.sol", None), ("r", "src/b.sol", ""), ("r", "src/c.sol", "no contract\nx = 1;"), ("r", "test/d.sol", "contract T { uint x; }"), ("r", "src/e.sol", "contract A\n{\n  uint256 x;\n}\nuint256 y;")]
    facts = C.Facts(spark.createDataFrame(rows, "repo string, file_path string, text string"))
    assert {(r.file_path, r.contract_name, r.name) for r in facts.variables.collect()} == {("src/e.sol", "A", "x")}
    assert facts.functions.count() == facts.edges.count() == facts.flows.count() == 0
    assert {r.contract_name for r in facts.rows.where("file_path = 'src/c.sol'").collect()} == {None}


def test_aliases_name_the_storage_they_stand_for(own):
    got = {(r.function_name, r.variable_name): r.access for r in own.storage.where("contract_name = 'Market' and variable_name like 'pools.%'").collect()}
    assert got == {("borrow", "pools.debt"): "write", ("closePool", "pools.active"): "write"}


def test_slices_reach_through_calls_and_end_in_cycles(spark, own):
    fns = G.functions_of(own)
    reach = {(r.entry, r.node) for r in G.slices(own, fns)[0].where("repo = 'market'").collect()}
    assert {n for e, n in reach if e == "Market.borrow"} == {"Market.borrow", "Market.sendOut", "Market.logged"}
    steps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    found = G.reachable(steps, spark.createDataFrame([("a",)], "node string"), 2)
    assert {(r.node, r.hop) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_lines_meet_the_ranges_of_their_bin(spark):
    lines = spark.createDataFrame([("k", i) for i in range(1, 400)], "k string, line_no int")
    spans = [(1, 200), (63, 64), (64, 64), (128, 300), (350, 360)]
    ranges = spark.createDataFrame([("k", f"f{i}", a, b) for i, (a, b) in enumerate(spans)], "k string, name string, start_line int, end_line int")
    want = {n: next((f"f{i}" for i, (a, b) in enumerate(spans) if a <= n <= b), None) for n in range(1, 400)}
    assert {r.line_no: r.name for r in L.containing(lines, ranges, ["k"]).collect()} == want


def test_gates_follow_their_order(spark):
    got = {r.id: (r.status, r.gates, r.confidence) for r in H.gated(H.rows(spark)).collect()}
    assert got["finding-7"] == ("confirmed", ["executed"], 0.97)
    assert got["finding-12"] == ("rejected", ["executed", "counterevidence"], 0.99)
    assert got["finding-3"] == ("likely", ["proof"], 0.85) and got["lead-8"] == ("lead", [], 0.45)
    assert "finding-10" not in got


def test_no_plan_no_error_and_broken_json(spark):
    plans = spark.createDataFrame([(1, "{}"), (2, "not json"), (3, None)], "plan int, value string")
    signatures = spark.createDataFrame([], "type string, function string, arity int")
    got = {r.plan: r.errors for r in P.plan_errors(plans, signatures, []).collect()}
    assert set(got) == {1, 2, 3} and "no attack call" in got[1]


def test_walks_keep_inside_and_listings_say_what_they_leave_out(spark, tmp_path):
    root = tmp_path / "repo"
    for name in ("src/A.sol", ".git/config", "docs/audit-report.md", "b.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    (tmp_path / "secret").write_text("s")
    os.symlink(tmp_path / "secret", root / "link")
    os.symlink(tmp_path, root / "up")
    assert [r.path for r in files.walk(spark, str(root)).orderBy("path").collect()] == ["b.txt", "docs/audit-report.md", "src/A.sol"]
    assert {r.path for r in files.walk(spark, str(root), blind=True).collect()} == {"b.txt", "src/A.sol"}
    found = files.listed(files.walk(spark, str(root)), 2).collect()
    assert [(r.path, r.truncated) for r in found] == [("b.txt", True), ("docs/audit-report.md", True)]


def test_broken_lines_are_errors_or_dropped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2\n[3]\n{"a": 4, "b": 5}\n')
    assert sorted(r.a for r in files.read_json_lines(spark, str(tmp_path), "a int", strict=False).collect()) == [1, 4]
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path), "a int").collect()


def test_failed_index_leaves_a_marker(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = spark.createDataFrame([(1,)], "vec_id long").withColumn("embedding", F.raise_error(F.lit("no vectors")).cast("array<float>"))
    with pytest.raises(Exception):
        sinks.build_index(bad, str(tmp_path / "i"), {"model": "m"})
    assert (tmp_path / "i" / "index.UNAVAILABLE").exists() and not (tmp_path / "i" / "index_metadata").exists()


def test_lessons_are_logged_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "repo string, lesson string")
    assert [sinks.append_lessons(rows, str(tmp_path / "log")) for _ in range(2)] == [2, 0]


def test_blocks_hold_every_query_once_and_best_keeps_the_first_ties(spark):
    import pandas as pd

    queries = spark.range(1000).withColumnRenamed("id", "query_id")
    parts = list(V.blocks(queries, 100))
    assert sorted(q for p in parts for q in p["query_id"]) == list(range(1000)) and max(map(len, parts)) < 200
    best = V.Best(2, 2, "doc_id")
    best.add(pd.DataFrame({"q": [0, 0, 0, 1], "doc_id": [5, 4, 3, 9], "score": [1.0, 1.0, 0.5, 0.1]}))
    best.add(pd.DataFrame({"q": [0, 0, 1], "doc_id": [2, 1, 8], "score": [1.0, 0.9, 0.1]}))
    assert best.rows[["q", "doc_id"]].values.tolist() == [[0, 2], [0, 4], [1, 8], [1, 9]]
