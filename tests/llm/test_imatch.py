import hashlib
import random
import re
from collections import Counter

import pytest

from lodeline.llm.imatch import LADDER, fingerprints, in_order_with_next


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h string, bucket string")


def test_order_next_and_edited_texts(spark):
    rng = random.Random(3)
    words = [f"term{i}" for i in range(3000)]
    rows = [(i * 7 % 997, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 300]))), "x", "y") for i in range(300)]
    rows += [(5000, None, "x", "y"), (5001, "", "x", "y"), (5002, "ü" * 20_000, "x", "y")]
    rows += [(6000 + i, rows[40][1], "x", "y") for i in range(3)]
    df = rows_of(spark, rows)
    ordered = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    texts = [t for _, t in ordered]
    want = {}
    for (i, t), following in zip(ordered, texts[1:] + texts[:1], strict=True):
        cut = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest())
    got = fingerprints(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(dict(ordered)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got if r.n_chars > 900]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_buckets_chain_through_the_whole_order(spark):
    df = rows_of(spark, [(i, f"t{i}", "", "") for i in range(100)] + [(None, "none", "", ""), (50, "t50", "", "")])
    found, n = in_order_with_next(df, bucket_rows=9)
    got = {(r.t, r.next_t) for r in found.where("real").collect()}
    order = [f"t{i}" for i in range(99, -1, -1)]
    order.insert(order.index("t50"), "t50")
    order.append("none")
    assert n == 102 and got == set(zip(order, order[1:] + order[:1], strict=True))


def test_one_row_and_none(spark):
    one = fingerprints(rows_of(spark, [(1, "alpha beta gamma", "", "")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(rows_of(spark, [])).count() == 0


def test_fingerprints_and_likeness_by_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([2, 8, 40, 200, 1500]))).title(), "", "") for i in range(120)]
    least, most = 0.03, 0.25
    terms_of = lambda t: sorted(set(re.findall(r"[a-z0-9]+", t.lower())))
    df = Counter(w for _, t, *_ in rows for w in terms_of(t))
    lexicon = {w for w, n in df.items() if max(2, least * len(rows)) <= n <= max(2, most * len(rows))}
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    ordered = [t for _, t, *_ in sorted(rows, reverse=True)]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(ordered, ordered[1:] + ordered[:1], strict=True)]
    unknown = {w for t in edited for w in terms_of(t)} - set(hashes)
    assert not unknown & lexicon

    def plain(text):
        """The lexicon's terms in each randomised lexicon."""
        own = sorted(hashes[w] for w in terms_of(text) if w in lexicon)
        inside = lambda h, m, k: h >> 40 + k & 1 if m == 2 else h % m == k
        return [tuple(h for h in own if inside(h, m, k)) for m, n in LADDER for k in range(n)]

    def like(a, b, equal):
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return 1.0 if equal else sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0

    found = {r.doc_id: r for r in fingerprints(rows_of(spark, rows), least, most).collect()}
    prints = [plain(t) for t in ordered]
    for at, (i, t, *_) in enumerate(sorted(rows, reverse=True)):
        following = (at + 1) % len(rows)
        assert found[i].near_edited == pytest.approx(like(prints[at], plain(edited[at]), t == edited[at]))
        assert found[i].near_next == pytest.approx(like(prints[at], prints[following], t == ordered[following]))
        assert found[i].fingerprint.startswith("text:") != bool(prints[at][0])
    whole = {p[0] for p in prints if p[0]}
    assert len({f.fingerprint for f in found.values() if not f.fingerprint.startswith("text:")}) == len(whole)


def test_texts_of_very_different_lengths_are_compared(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample([f"w{j}" for j in range(3000)], 20)), "", "") for i in range(400)]
    shared = " ".join(f"s{j}" for j in range(30))
    rows += [(1002, shared, "", ""), (1001, f"{shared} " + " ".join(f"w{j}" for j in range(300)), "", ""), (1000, shared, "", "")]
    found = {r.doc_id: r for r in fingerprints(rows_of(spark, rows), 0.0, 0.5).collect()}
    assert 0 < found[1002].near_next < 0.5 and found[1001].near_next == found[1002].near_next
