import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators import detect as D
from lodeline.operators import judge as J
from lodeline.operators import relate as R
from lodeline.operators import retrieve as V
from lodeline.plans.shared import discard, join_checked, materialise, table_bytes
from lodeline.sources import lines as L
from lodeline.sources import sample
from lodeline.streaming import ledger as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_source_types(spark):
    want = {"src/A.sol": "production", "./contracts/B.sol": "production", "test/A.t.sol": "test", "src/mocks/M.sol": "test", "lib/x.sol": "library", "docs/a.txt": "docs", "README": "docs", "a/node_modules/b.js": "dependency", "script/D.s.sol": "script", "x.sol": "unknown", "": "unknown", None: "unknown", "SRC\\A.sol": "production"}
    assert {k: one(spark, X.source_type, k) for k in want} == want


def test_terms_and_aliases(spark):
    assert set(one(spark, X.terms, "Latest report of ab Foo_bar foo_bar 12x")) == {"latest", "report", "foo_bar", "upperlookup", "handlereport"}
    assert one(spark, X.terms, "") == [] and one(spark, X.slug, "Ab--C d") == "ab_c_d"


def test_function_ranges_of_odd_sources(spark):
    rows = [("a", "contract A {\n  function f()\n    external\n  {\n    x = 1; // }\n  }\n  function g() external;\n  function h() public { y = 2; }\n}\n"), ("b", ""), ("c", None), ("d", "no code")]
    got = {(r.k, r.contract_name, r.function_name, r.start_line, r.end_line) for r in L.function_ranges(spark.createDataFrame(rows, "k string, text string")).collect()}
    assert got == {("a", "A", "f", 2, 6), ("a", "A", "h", 8, 8)}


def test_detectors_fire_where_they_should(spark):
    got = {(r.repo, r.detector): r.evidence for r in D.detections(sample.sources(spark)).collect()}
    vault, feed, game = "src/Treasury.sol", "src/PushOracle.sol", "contracts/HatchGame.sol"
    assert got == {
        ("game", "erc4626_convertto_includes_fees"): f"{game}:26",
        ("game", "public_vault_accounting_spoof"): f"{game}:15,{game}:16,{game}:17",
        ("game", "strategy_accounting_trust"): f"{game}:22",
        ("game", "weak_randomness"): f"{game}:8,{game}:9,{game}:11",
        ("treasury", "chainlink_unbounded_price"): f"{feed}:14",
        ("treasury", "dangerous_delegatecall"): f"{vault}:37",
        ("treasury", "external_call_before_accounting"): f"{vault}:27,{vault}:29",
        ("treasury", "oracle_constant_threshold"): f"{feed}:20",
        ("treasury", "oracle_stale_read"): f"{feed}:19",
        ("treasury", "oracle_staleness_logic"): f"{feed}:25",
        ("treasury", "oracle_update_replay"): f"{feed}:13",
        ("treasury", "pause_not_enforced"): f"{vault}:20,{vault}:26",
        ("treasury", "tx_origin_auth"): f"{vault}:41",
        ("treasury", "unchecked_erc20_returns"): f"{vault}:22,{vault}:33",
        ("treasury", "unguarded_initializer"): f"{vault}:16,{vault}:17",
        ("treasury", "unsafe_approve"): f"{vault}:33",
        ("treasury", "unsafe_or_guards"): f"{feed}:25,{vault}:41",
    }


def test_lines_of_a_function_are_the_first_range_that_holds_them(spark):
    lines = spark.createDataFrame([("a", i) for i in range(1, 7)], "k string, line_no int")
    ranges = spark.createDataFrame([("a", "f", 2, 5), ("a", "g", 4, 6)], "k string, name string, start_line int, end_line int")
    got = {r.line_no: r.name for r in L.containing(lines, ranges, ["k"]).collect()}
    assert got == {1: None, 2: "f", 3: "f", 4: "f", 5: "f", 6: "g"}


def test_reachability_equals_a_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    found = R.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (5,)], "node long"), 4)
    for start in (0, 5):
        best, frontier = {start: 0}, {start}
        for hop in range(1, 5):
            frontier = {b for a, b in edges if a in frontier and b not in best}
            best |= dict.fromkeys(frontier, hop)
        assert {r.node: r.hop for r in found.where(F.col("start") == start).collect()} == best


def test_vector_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    got = {(r.query_id, r.rank): r.vec_id for r in V.vector_top_k(df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), df, 3).collect()}
    for q, own in rows[::20]:
        order = sorted((-sum(a * b for a, b in zip(own, e, strict=True)), i) for i, e in rows if i != q)
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in order[:3]]


def test_greedy_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("h", 1, 99)], "g string, k long, size long")
    got = {r.g: (r.used, r.chosen) for r in J.budget_greedy(df, "g", "size", "k", 10).collect()}
    assert got == {"g": (9, [1, 3]), "h": (0, [])}


def test_gates_only_lower_a_status(spark):
    rows = [(i, q, t, n, c) for i, (q, t, n, c) in enumerate((q, t, n, c) for q in (None, 0, 1) for t in (None, 0, 1) for n in (10, 1000) for c in ("secret", "prose"))]
    got = J.gated(spark.createDataFrame(rows, "doc_id int, quality int, toxic int, n_chars int, class string")).collect()
    order = {"rejected": 0, "needs_manual_review": 1, "likely": 2, "confirmed": 3}
    claimed = {None: 1, 0: 2, 1: 3}
    assert all(order[r.status] <= claimed[rows[r.doc_id][1]] for r in got)
    assert all(r.confidence <= 0.85 or r["class"] == "secret" for r in got)


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "view" if i % 3 else "error", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    out = S.run_stream(spark, f"{tmp_path}/events.parquet", df.schema, "*.parquet", lambda s: S.tumbling_counts(s, 60, "0 seconds"), "test-stream")
    closed = out.select(F.max("start")).first()[0]
    batch = {tuple(r) for r in S.tumbling_counts(df).where(F.col("start") <= F.lit(closed)).collect()}
    assert closed is not None and {tuple(r) for r in out.collect()} == batch


@pytest.mark.parametrize("minutes", [0, 7, 60])
def test_a_stream_counts_every_window(spark, tmp_path, minutes):
    import datetime as dt

    import pandas as pd

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes * i), "view" if i % 3 else "error", float(i)) for i in reversed(range(400))]
    pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    batch = {}
    for _, ts, kind, _ in rows:
        batch.setdefault(kind, []).append(ts.date())
    got = {r.event_type: (r.n, r.windows) for r in S.q_ledger_stream_windows(spark, str(tmp_path)).collect()}
    assert got == {kind: (len(days), len(set(days))) for kind, days in batch.items()}


def test_shared_tables(spark):
    df = materialise(spark.range(100).withColumn("x", F.col("id") % 7), "t")
    small = materialise(spark.createDataFrame([(1, "a")], "x long, y string"), "s")
    assert 0 < table_bytes(small) < 10_000
    assert join_checked(df, small, "x").count() == join_checked(df, small, "x", limit=0).count() == 15
    discard(small)
    assert df.count() == 100


def test_bound_batches_lowers_but_never_raises(spark):
    from lodeline.plans import shared

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50000")
    shared.bound_batches(spark)
    assert spark.conf.get(key) == str(shared.BATCH_ROWS)
    spark.conf.set(key, "7")
    shared.bound_batches(spark)
    assert spark.conf.get(key) == "7"
    spark.conf.set(key, before)
    assert [shared._bytes(x) for x in ("50", "4m", "64MB", "-1", "")] == [50, 4 << 20, 64 << 20, 0, 0]
