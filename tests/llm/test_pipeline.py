import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("tiktoken")

import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402

import corpus_pipeline as C  # noqa: E402
from lodeline.llm import language_id, mixing  # noqa: E402
from lodeline.llm.bpe import read_ranks  # noqa: E402


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_redacted(text):
    """The e-mail addresses and telephone numbers of the test's sentences, by the given patterns."""
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    return re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "[PHONE]", text)


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    sentence = "the quick brown fox number {} jumps over the lazy dog and writes to a.b@c.de or calls +1 (523) 555-1055 today"
    rows = [(i, sentence.format(i // 3) + f" w{i // 3}" * 30, "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(100, "123 456", "en", "src0", 7), (101, None, None, None, None), (102, "", "en", "src1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect()}

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    kept, sets = {}, []
    for i, text, *_ in rows:
        own = plain_shingles(text)
        if not any(c.isalpha() for c in text or "") or any(100 * len(own & s) >= 75 * len(own | s) for s in sets):
            continue
        sets.append(own)
        kept[i] = text
    want = {}
    for i, text in kept.items():
        clean = plain_redacted(text)
        ids = theirs.encode_ordinary(clean)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    assert got == want

    docs = df
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    assert language_id.REJECT_BELOW < 0.2 and min(mixing.TARGETS.values()) > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_the_result_follows_the_target_weights(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60)), "en", "src0" if i < 800 else f"src{1 + i % 4}", 0) for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.position, r.doc_id) for r in C.run(spark, str(tmp_path)).collect())
    assert [p for p, _ in got] == list(range(len(got))) and len(got) > 1350
    weights = {f"src{i}": mixing.TARGETS[f"src{i}"] for i in range(5)}
    seen, left = Counter(), Counter(rows[i][3] for _, i in got)
    for position, doc in got:
        seen[rows[doc][3]] += 1
        if max(seen[s] - left[s] for s in weights) == 0:  # a source is used up
            break
        for s, w in weights.items():
            assert abs(seen[s] - (position + 1) * w / sum(weights.values())) < 2 * mixing.BLOCK_ROWS
    assert position > 800


def test_written_order_is_that_of_the_mixture(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id % 4900) AS text", "concat('src', id % 7) AS source")
    want = {r.doc_id: n for n, r in enumerate(sorted(mixing.mix(df, mixing.TARGETS).collect(), key=lambda r: r.mixed.position))}
    path = f"{tmp_path}/mixed"
    mixing.mixed_order(df, mixing.TARGETS).write.option("maxRecordsPerFile", 300).parquet(path)
    for shuffled in ("1k", "128m"):  # how the reader deals files out has no effect
        spark.conf.set("spark.sql.files.maxPartitionBytes", shuffled)
        got = {r.doc_id: r.position for r in mixing.written_order(spark.read.parquet(path)).collect()}
        assert got == want
