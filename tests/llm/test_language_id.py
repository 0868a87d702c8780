import random
import zlib

import numpy as np

from lodeline.llm import language_id as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ein", "ung", "pf"], "cc": ["ção", "ñe", "rr", "íl"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def plain_ngrams(word, size=L.NGRAM):
    padded = f" {word} "
    return [padded[i : i + size] for i in range(max(1, len(padded) - size + 1))]


def test_ngrams_are_those_of_each_word_alone():
    words = ["a", "ab", "abc", "abcd", "straße", "x", "ññññññ"]
    h, owner = L.ngram_hashes(words)
    alone = [L.ngram_hashes([w])[0].tolist() for w in words]
    assert [h[owner == i].tolist() for i in range(len(words))] == alone
    assert [len(x) for x in alone] == [len(plain_ngrams(w)) for w in words]
    assert L.ngram_hashes(["ab"])[0][0] != L.ngram_hashes(["abc"])[0][0]


def test_filters_hold_what_was_inserted_and_little_else():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 40_000, dtype=np.uint64)
    filters = L.LanguageFilters.empty(["aa", "bb"])
    filters.insert(h[:20_000], 0)
    filters.insert(h[10_000:20_000], 1)
    filters = L.LanguageFilters(filters.languages, filters.cells)
    (bits,) = filters.holders(h)
    assert (bits[:10_000] & 1).all() and (bits[10_000:20_000] & 3 == 3).all()
    assert (bits[20_000:] != 0).mean() < 0.01
    assert 0 < filters.false_rate[1] < filters.false_rate[0] < 0.01


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.choice([3, 30, 200])), lang, "x", 0.5) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    rows += [(1000, None, "aa", "x", 0.1), (1001, "", "aa", "x", 0.1), (1002, "123 !? ²", None, "x", 0.1), (1003, sentence(rng, "bb", 40_000), None, "x", 0.1)]
    rows += [(None, sentence(rng, "cc", 20), None, "x", 0.1)] + [rows[5]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    filters = L.train(df)
    got = L.predict(df, filters).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    judged = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(judged) > 60 and all(r.lang_pred == truth[r.doc_id] for r in judged)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {by_id[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert by_id[1003].lang_pred == "bb" and by_id[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.accepted(df, filters)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(truth) - {1000, 1001, 1002}


def test_more_languages_than_a_word_holds(spark):
    letters = [chr(0x4E00 + i) for i in range(280)]
    names = [f"l{i:02d}" for i in range(70)]
    rng = random.Random(8)
    rows = [(i * 70 + j, " ".join("".join(rng.choices(letters[4 * j : 4 * j + 4], k=5)) for _ in range(12)), name) for j, name in enumerate(names) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = L.train(df)
    assert filters.languages == names and filters.cells.shape == (2, L.CELLS)
    assert all(r.lang_pred == rows_lang for r, rows_lang in zip(L.predict(df, filters).collect(), [r[2] for r in rows], strict=True))
    assert L.cells_for(64) == L.CELLS and L.cells_for(10_000) * 8 * 157 <= L.MODEL_BYTES


def test_spark_fills_the_cells_that_insertion_fills(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, 500)
    names = [f"l{i}" for i in range(65)]
    pairs = [(names[int(i)], int(x)) for i, x in zip(rng.integers(0, 65, 500), h, strict=True)]
    plain = L.LanguageFilters.empty(names)
    for lang, x in pairs:
        plain.insert(np.array([x]).view(np.uint64), names.index(lang))
    found = L.filled_cells(spark.createDataFrame(pairs, "lang string, h long"), names, plain).collect()
    cells = np.zeros_like(plain.cells)
    for r in found:
        cells[r.word, r.place] = np.array([r.bits]).view(np.uint64)[0]
    assert (cells == plain.cells).all()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.predict(df, L.train(df)).collect()] == ["und"]
    assert L.predict(df.limit(0), L.train(df.limit(0))).count() == 0
