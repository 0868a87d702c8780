import random

import numpy as np

from lodeline.llm import toxicity as X


def corpus(rng, n=500):
    syllables = ["ka", "lo", "mi", "tu", "ren", "sa"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.choice([20, 60, 200]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "zgrub" + rng.choice(syllables)
        docs.append((i, " ".join(words).capitalize() + ".", "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_grams_are_what_the_automaton_finds():
    text = X.normalised("You are, ÉCLAIR eclair; a")
    names = sorted(X.grams(text) | {"zzz", "are e"})
    assert {names[i] for i in X.Presence(names).of(text)} >= X.grams(text)
    assert "zzz" not in {names[i] for i in X.Presence(names).of(text)}


def test_swaps_change_only_the_term():
    pairs = X.counterfactuals("Some women came. Nothing here. The people left!")
    assert [a.split()[0] for a, _ in pairs] == ["some"] + ["the"] * (len(pairs) - 1)
    assert all(sum(x != y for x, y in zip(a.split(), b.split(), strict=True)) == 1 for a, b in pairs)


def test_penalty_takes_the_weight_off_a_swapped_term():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 3)) < 0.5).astype(np.float32)
    y = np.maximum(x[:, 0], (rng.random(400) < 0.2) * x[:, 1]).astype(np.float32)
    swaps = np.array([[0, 1, 0], [0, 1, -1]], np.float32)
    free, _ = X._fit(x, y, np.zeros((3, 3), np.float32))
    held, _ = X._fit(x, y, swaps.T @ swaps / len(swaps))
    assert abs(held[1]) < 0.3 * abs(free[1]) and held[0] > 1


def test_every_swap_of_a_text_counts(spark):
    text = "Some women came. " * 70 + "The jews and the women left. " * 40
    names = sorted(X.grams(" some women jews people christians "))
    presence = X.Presence(names)
    plain = np.zeros((len(names), len(names)), int)
    swaps = X.counterfactuals(text)
    assert len(swaps) == 150
    for before, after in swaps:
        change = np.zeros(len(names), int)
        change[presence.of(after)] += 1
        change[presence.of(before)] -= 1
        plain += np.outer(change, change)
    got = {(r.i, r.j): r.total for r in X.swap_products(spark.createDataFrame([(text,), (None,)], "text string"), names).collect()}
    assert got.pop((-1, -1)) == 150
    assert {k: v for k, v in got.items() if v} == {(int(i), int(j)): int(plain[i, j]) for i, j in zip(*np.nonzero(plain), strict=True)}


def test_held_out_rows_odd_rows_and_neutral_mentions(spark):
    rng = random.Random(6)
    docs, labels = corpus(rng)
    docs += [(900, None, "x"), (901, "", "x"), (None, "zgrubka zgrublo zgrubmi", "x"), (902, "kalo " * 40_000 + "zgrubka zgrubsa zgrubtu", "x"), docs[0], (903, "we met the women and the muslims in town", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labelled = spark.createDataFrame(labels + [(None, 1, 1), (77_777, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int")
    got = X.scored(frame, X.train(frame, labelled)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in labels}
    judged = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(judged) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].predicted for i in (900, 901, 902, 903, None)] == [0, 0, 1, 0, 1]
    assert by_id[900].score == by_id[901].score


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in X.scored(frame, X.train(frame, none)).collect()] == [0]
    assert X.scored(frame.limit(0), X.train(frame.limit(0), none)).count() == 0
