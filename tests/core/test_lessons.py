from lodeline.operators.slices import lessons

WORDS = [("r", "Market", "buyOrder", "function buyOrder(uint256 price) external"), ("s", "A", "b", "function b() external")]


def test_the_fixed_terms_are_what_is_broadcast(spark):
    found = lessons(spark.createDataFrame(WORDS, "repo string, contract_name string, function_name string, signature string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
    assert [(r.repo, r.n_terms) for r in found.collect()] == [("r", 2)]
