import math
import random
import re
from collections import Counter

import numpy as np

from lodeline.llm import ranked as R


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    words = [(d, Counter(plain(t))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n, length = len(words), sum(x for _, _, x in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, own in words:
            m = 100 - 90 + (90 * own * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def corpus(n=400):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(200)] + ["É", "日本", "x-y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 3, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 8, 60, 300])))) for i in range(n)]
    docs += docs[:9] + [(None, "t0 t5 t150"), (1, None), (2, ""), (4, "?!"), (10**12, "t190 " * 5000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 40])))) for i in range(25)]
    return docs, items + [(100, None), (101, "nothing like it"), (102, "T0"), (102, "T0 t1"), (None, "t3")]


def test_equals_scoring_every_document(spark):
    docs, items = corpus()
    for partitions, shard_docs, postings in ((1, 50, 10**6), (3, 10**6, 10**6), (2, 10**6, 300)):
        d, i = tables(spark, docs, items)
        got = R.search(d.repartition(partitions), i, shard_docs=shard_docs, shard_postings=postings)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_blocks_of_queries_give_the_same(spark):
    docs, items = corpus(60)
    d, i = tables(spark, docs, items)
    assert sorted(map(tuple, R.search(d, i, block=7, k=3).collect()), key=repr) == brute(docs, items, 3)


def test_the_search_of_a_shard_skips_and_stays_exact():
    rng = np.random.default_rng(5)
    docs = 20_000
    looked = 0
    for _ in range(20):
        lists = []
        for size in (12_000, 9_000, 5_000, 300, 40, 12):
            places = np.sort(rng.choice(docs, size, replace=False))
            lists.append((places, rng.integers(0, 40, size) * int(1_000_000 / size)))
        dense = np.zeros(docs, np.int64)
        for places, adds in lists:
            dense[places] += adds
        want = np.lexsort((np.arange(docs), -dense))[:10]
        posting = [R.PostingList(p, a, (docs >> R.BLOCK_BITS) + 1) for p, a in lists]
        found, scores, n = R.best_of_shard(posting, docs, 10)
        assert found.tolist() == want.tolist() and scores.tolist() == dense[want].tolist()
        found, scores, _ = R.best_of_shard(posting, docs, 10, short_share=0)
        assert found.tolist() == want.tolist()
        looked += n
    assert looked < 20 * docs / 10


def test_empty_tables_and_further_columns(spark):
    assert R.search(*tables(spark, [], [(1, "a")])).count() == 0
    assert R.search(*tables(spark, [(1, "a")], [])).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b c", 6, "y")], "doc_id int, text string, score long, rank string")
    items = spark.createDataFrame([("q", "c", 1)], "item_id string, text string, doc_id long")
    assert [(r.item_id, r.rank, r.doc_id) for r in R.search(docs, items).collect()] == [("q", 1, 2)]
