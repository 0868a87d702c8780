import os

import pytest

import __spark_entry__ as entry
from lodeline import catalogue

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query_and_columns_are_named():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()).isdisjoint(catalogue.FIXTURES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are absent")
def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "doc_id", "hits", "score", "rank"] and found.limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["line_scan", "path_classify", "session_gaps", "gate_chain", "ledger_summary", "first_call_then_accounting", "unguarded_writes", "retrieval_metrics", "line_heuristics", "first_match_hypotheses", "checklist_build", "detections", "function_facts", "graph_slices", "order_races", "finding_gates", "hypothesis_merge", "recall_report", "normalize_finding", "finding_scores", "plan_validate", "state_effects", "tolerant_json", "tolerant_objects", "tolerant_kinds", "token_bucket_stream", "late_rows_stream", "session_stream", "containment", "overlap_evidence", "versioned_upsert", "corpus_store", "index_rebuild", "budget_greedy", "ledger_stream_windows", "corpus_fingerprint"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{file}')")
    query, sql = catalogue.fixtures().get(name) or (entry.queries()[name], entry.oracle_sql()[name])
    df = query(spark, SMALL)
    columns = sorted(df.columns)

    def plain(value):
        return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(names) == columns and got == want
