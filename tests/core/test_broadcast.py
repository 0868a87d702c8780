"""Joins of facts of code shuffle: a broadcast of facts would pass the driver."""

import re

from lodeline.operators import hypotheses


def test_code_hypotheses_broadcasts_no_facts(spark):
    found = hypotheses.q_code_hypotheses(spark, "/root/testdata/sf0.001")
    assert found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what is left joins suppliers with the patterns of their code, which are rows of the sample
    names = re.findall(r"BroadcastHashJoin \[(\w+)#", plan)
    assert set(names) <= {"kind"} and "SortMergeJoin" in plan
