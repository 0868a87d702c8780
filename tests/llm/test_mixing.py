import random
from collections import Counter
from fractions import Fraction

import pytest

from lodeline.llm import mixing as M


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.5}, {"a": 0.7, "b": 0.2, "c": 0.1}, {f"s{i}": 1 + i * i for i in range(30)}])
def test_a_frame_stays_within_one_block_of_the_weights(weights):
    slots = M.whole_slots(weights, 500)
    given = M.frame(slots)
    assert sorted(t for x in given.values() for t in x) == list(range(500))
    for s, own in given.items():
        for t in range(501):
            assert abs(sum(x < t for x in own) - t * slots[s] / 500) < 1


def test_phases_place_every_block_once():
    blocks = {"a": 7, "b": 1000, "c": 43, "d": 0}
    slots = Counter()
    placed = Counter()
    for s, _, first, beyond, start, size, given in M.phases(blocks, {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.1}, 100):
        for k in range(beyond - first):
            slots[start + k // len(given) * size + given[k % len(given)]] += 1
            placed[s, first + k] += 1
    assert set(slots.values()) == set(placed.values()) == {1}
    assert sorted(slots) == list(range(1050)) and len(placed) == 1050


def test_rows_windows_and_deviation(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices(["src0", "src1", "rare", None], [10, 5, 1, 1])[0], f"t{i}", i) for i in range(3000)]
    rows += [rows[0], (None, "src1", "no id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, position long")
    weights = {"src0": 0.6, "src1": 0.3, M.OTHER: 0.1}
    got = M.mix(df, weights, block_rows=8, resolution=50).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.text, r.position) for r in got))) == sorted(map(str, rows))
    assert len({r.mixed.position for r in got}) == len(rows)
    assert all(r.mixed.release <= r.mixed.slot < r.mixed.deadline for r in got)
    first = [r for r in got if r.mixed.phase == 0]
    last = max(r.mixed.slot for r in first)
    by_slot = {r.mixed.slot: r.source if r.source in weights else M.OTHER for r in first}
    assert sorted(by_slot) == list(range(last + 1))
    for s, w in weights.items():
        n = 0
        for t in range(last + 1):
            n += by_slot[t] == s
            assert abs(n - (t + 1) * w) < 1
    clash = df.withColumnRenamed("position", "mixed")
    order = [r.doc_id for r in M.mixed_order(clash, weights, 8, 50).coalesce(1).collect()]
    assert sorted(map(str, order)) == sorted(str(r[0]) for r in rows)
    by_source = {r[0]: r[1] for r in rows}
    first_slots = [by_source[i] for i in order[: 8 * 20]]
    assert abs(first_slots.count("src0") - 0.6 * 160) < 16
    assert M.mixed_order(clash, weights).columns == M.mix(clash, weights).drop("mixed").columns[:3] + ["mixed"]
    assert M.mix(df.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, {"src0": 0})


def deviations(blocks, weights, resolution):
    """By phase: its slots, and the most blocks by which a source deviates from its exact weight after any slot."""
    by_slot = {}
    for s, phase, first, beyond, start, size, given in M.phases(blocks, weights, resolution):
        for k in range(beyond - first):
            by_slot[start + k // len(given) * size + given[k % len(given)]] = (phase, s)
    assert sorted(by_slot) == list(range(sum(blocks.values())))
    out, left = {}, dict(blocks)
    for phase in sorted({p for p, _ in by_slot.values()}):
        order = [by_slot[t][1] for t in range(len(by_slot)) if by_slot[t][0] == phase]
        live = {s: Fraction(str(weights[s])) for s in left if left[s]}
        n, most = Counter(), 0
        for t, s in enumerate(order, 1):
            n[s] += 1
            most = max(most, *(abs(n[x] - t * w / sum(live.values())) for x, w in live.items()))
        out[phase] = (len(order), float(most))
        left = {s: left[s] - n[s] for s in left}
    return out


@pytest.mark.parametrize(
    "blocks, weights",
    [
        ({"src0": 12000, M.OTHER: 300} | {f"src{i}": 60 * i + 80 for i in range(1, 20)}, M.TARGETS),
        ({"a": 4000, "b": 2000, "c": 3}, {"a": 2 / 3, "b": 1 / 3, "c": 0.0004}),  # long periods, and less than a slot of a frame
        ({"a": 5000, "b": 2500, "c": 1500}, {"a": 0.55555, "b": 0.27777, "c": 0.16668}),
    ],
)
def test_every_phase_stays_within_one_block_of_the_exact_weights(blocks, weights):
    got = deviations(blocks, weights, M.RESOLUTION)
    assert len(got) >= 2 and max(n for n, _ in got.values()) > 3 * M.RESOLUTION
    assert all(most < 1 for _, most in got.values()), got


def test_rows_follow_exact_weights_over_frames(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 5 THEN 'a' WHEN id % 10 < 8 THEN 'b' ELSE 'c' END AS source", "CAST(id AS string) AS text")
    weights = {"a": 0.55555, "b": 0.27777, "c": 0.16667, M.OTHER: 0.00001}
    got = M.mix(df, weights, block_rows=1, resolution=50).collect()
    assert sorted(r.mixed.slot for r in got) == list(range(6000))
    assert all(r.mixed.release <= r.mixed.slot < r.mixed.deadline for r in got)
    order = [r.source for r in sorted(got, key=lambda r: r.mixed.slot) if r.mixed.phase == 0]
    live = {s: weights[s] / (1 - weights[M.OTHER]) for s in "abc"}
    n = Counter()
    for t, s in enumerate(order, 1):
        n[s] += 1
        assert all(abs(n[x] - t * w) < 1 + 1e-9 for x, w in live.items())
    assert len(order) > 5000
