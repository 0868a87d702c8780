import random
import re
from collections import Counter

import pytest

from lodeline.llm import divergence as D


def plain(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, reported=200):
    """Every row (lang, source, part, item, value, rank), term by term."""
    rows = [(plain(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        df = Counter(t for words, _, _ in own for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = sorted({r[2] for r in own})
        count = {s: Counter(t for words, _, x in own if x == s for t in words if df[t] >= least) for s in sources}
        count[None] = sum(count.values(), Counter())

        def p(s, t, count=count, kept=kept):
            return 1 + 10**9 * (count[s][t] + 1) // (sum(count[s].values()) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s in sources:
            pairs = [(-sum(f(p(s, t), p(o, t)) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p(s, t), p(None, t)), t.encode(), t) for t in kept if count[s][t] and p(s, t) > p(None, t)]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:reported])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def corpus(n=160):
    rng = random.Random(6)
    words = ["the", "The", "und", "épée", "ÉPÉE", "x1y2", "日本", "a_b", "\x00zero", "tail"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""])) for _ in range(n)]
    return rows + rows[:7] + [(None, "en", "only"), ("", "fr", "a"), ("123 !", "fr", "b"), ("single", "it", "c")]


def test_equals_the_plain_form(spark):
    rows = corpus()
    got = D.divergence(frame(spark, rows).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_small_blocks_and_ranks(spark):
    rows = corpus(60)
    terms = D.term_table(frame(spark, rows).coalesce(1), block_terms=3)
    whole = D.term_table(frame(spark, rows).coalesce(1))
    key = lambda r: (r.lang, r.term or "", r.total, sorted(zip(r.sources, r.counts, strict=True)))
    assert sorted(map(key, terms.collect())) == sorted(map(key, whole.collect()))
    assert sorted(map(tuple, D.divergence(frame(spark, rows), reported=2).collect())) == brute(rows, reported=2)


def test_large_counts_stay_exact():
    import pyarrow as pa

    big = 5 * 10**11
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["a", "b"]), pa.array([2 * big, big + 7]), pa.array([["x", "y"], ["x", "y"]]), pa.array([[big, big], [big, 7]])], names=["lang", "term", "total", "sources", "counts"])
    sizes = {"en": (2, {"x": 2 * big, "y": big + 7})}
    rows = [r for out in D._both(sizes)(iter([batch])) for r in out.to_pylist()]

    def p(c, n):
        return 1 + 10**9 * (c + 1) // (n + 2)

    def f(a, b):
        return (a - b) ** 2 // b

    def want(s, o):
        n, m = sizes["en"][1][s], sizes["en"][1][o]
        of = {"x": (big, big), "y": (big, 7)}
        return sum(f(p(a, n), p(b, m)) - f(p(a, n), p(0, m)) - f(p(0, n), p(b, m)) + f(p(0, n), p(0, m)) for a, b in zip(of[s], of[o], strict=True))

    assert {(r["source"], r["item"]): int(r["value"]) for r in rows} == {("x", "y"): want("x", "y"), ("y", "x"): want("y", "x")}


@pytest.mark.parametrize("rows", [[], [("a b a b", "en", "s")] * 3])
def test_empty_tables_and_one_group(spark, rows):
    assert sorted(map(tuple, D.divergence(frame(spark, rows)).collect())) == brute(rows)


def test_further_columns_are_not_read(spark):
    rows = [(t, lang, source, 1, "x") for t, lang, source in corpus(20)]
    extra = spark.createDataFrame(rows, "text string, lang string, source string, term int, count string")
    assert sorted(map(tuple, D.divergence(extra).collect())) == brute([r[:3] for r in rows])
