import hashlib

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from lodeline.llm.bpe import Bpe, encode_documents, read_ranks, round_trip  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
OURS = Bpe(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_tiktoken(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinorst -'é.\n", max_size=300))
def test_same_ids_on_words(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 5000 + "x", "ab" * 9000, "\x1c\x85  x y", "<|endoftext|>", "ß" * 3000, "1" * 5000])
def test_long_and_odd_runs(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_round_trip_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(df, PATH, P.PATTERN).collect())
    want = []
    for i, text, _ in rows:
        ids = THEIRS.encode_ordinary(text or "")
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert {tuple(r.ids) for r in encode_documents(df, PATH, P.PATTERN).where("doc_id = 3").collect()} == {tuple(THEIRS.encode_ordinary("Hello world"))}
    assert round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
