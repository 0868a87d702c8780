import random
from itertools import combinations

from lodeline.llm.components import connected_components
from lodeline.llm.near_dup import keep_one, near_duplicates, shingle_set


def brute(rows):
    """doc_id -> (n, least id reachable), by all pairs of plain shingle sets."""
    sets = {}
    for i, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_random_groups_match_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for group in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 70, 130, 400]))
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            rows.append((len(rows) * 3, text if rng.random() < 0.7 else f"{text} {passage}"))
    for i in range(60):  # a chain: each differs from the one before by two words
        base = rows[-1][1].split() if i else rng.choices(vocabulary, k=120)
        base[(i * 7) % len(base)] = f"chain{i}"
        rows.append((len(rows) * 3, " ".join(base)))
    check(spark, rows)


def test_a_large_group_of_short_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(48)]
    rows = []
    for i in range(260):  # one or two words changed: linked to the base, or only to those that share a change, or to none
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(48)] = rng.choice(["x", "y", f"u{i}"])
        rows.append((i, " ".join(words[: rng.choice([48, 48, 40, 44])])))
    rows += [(1000, " ".join(base)), (1001, " ".join(base[:37])), (1002, " ".join(base + [f"t{i}" for i in range(14)]))]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b\x0bC"), (5, "a B c"), (6, "a b c d"), (7, "x " * 3000), (8, "x " * 9), (9, "É é é é é"), (10, "é é é é é"), (11, "no break one two three four five")]
    check(spark, rows)


def test_null_ids_repeats_clashing_columns_and_keep_one(spark):
    text = "one two three four five six seven"
    rows = [(7, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, "something else entirely", "d"), (9, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(7, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (None, 1, None, True), (9, 0, 9, True)}
    assert {r.doc_id for r in keep_one(df).collect()} >= {3, 9} and keep_one(df).columns == df.columns
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (5, 4)]
    got = {(r.u, r.v) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 130)}


def test_shingles_of_short_sequences_differ_from_long_ones():
    assert len(set(shingle_set("a b c d")) & set(shingle_set("a b c d e"))) == 0
    assert len(shingle_set("a a a a a a a a")) == 1
