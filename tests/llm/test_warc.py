import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodeline.llm import warc as W

SCHEMA = "record_id long, url string, at timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>, t string"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top", "example.com/a/b?a=1&b=2"),
        ("https://user:pw@example.com", "example.com"),
        ("https://example.com/?ref=9", "example.com"),
        ("https://m.example.com/x?q=www.y", "m.example.com/x?q=www.y"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(W.canonical_url(F.col("u"))).first()[0] == want


def brute(rows):
    out = []
    full = [r for r in rows if r[3] == "response" and r[1] is not None and r[2] is not None]
    for i, url, at, kind, etag, modified, digest, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in full if url is not None and at is not None and r[1] == url and r[2] < at]
        if not earlier:
            out.append((i, None, "orphan", None))
            continue
        s = max(earlier, key=lambda r: (r[2], r[0]))
        weak = lambda x: None if x is None else x.removeprefix("W/")
        agreed = next((a == b for a, b in ((weak(etag), weak(s[4])), (modified, s[5]), (digest, s[6])) if a is not None and b is not None), None)
        outcome = "unvalidated" if agreed is None else "resolved" if agreed else "mismatch"
        merged = (s[7] or {}) | {k: v for k, v in (headers or {}).items() if k in W.PERMITTED}
        out.append((i, s[0], outcome, "\n".join(sorted(f"{k}: {v}" for k, v in merged.items())) if agreed else None))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 7, 256])
def test_like_brute_force_with_a_hot_url_ties_and_nulls(spark, slices):
    rng = random.Random(slices)
    rows = []
    for i in range(500):
        url = rng.choice(["hot.com"] * 6 + [f"u{rng.randrange(40)}.com", None])
        at = None if rng.random() < 0.03 else dt.datetime(2021, 1, 1) + dt.timedelta(seconds=rng.randrange(200))
        pick = lambda *x: rng.choice([*x, None])
        rows.append((i, url, at, rng.choice(["response", "revisit", "request"]), pick('"a"', 'W/"a"', '"b"'), pick("m1", "m2"), pick("d"), pick({"date": str(i), "content-type": "x"}, {"etag": "e", "vary": "v"}, {}), "clash"))
    rows.append(next(r for r in rows if r[3] == "revisit"))
    got = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), slices).collect()
    assert sorted(((r.record_id, r.source_id, r.outcome, r.headers) for r in got), key=lambda x: (x[0], str(x))) == sorted(brute(rows), key=lambda x: (x[0], str(x)))


def test_empty(spark):
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
