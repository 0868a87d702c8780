import random
import re

import xxhash

from lodeline.llm.simhash import block_masks, fingerprint, fingerprint_components, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, least id reachable) by all pairs."""
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def check(spark, rows):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \t\n", "One", "one two three", "One two three four", "a b c d e", "a\x0bb\x0cc\rd e f", "ÉÀ É é", "x " * 70_001, "x y"):
        assert fingerprint(None if text is None else text.encode()) == plain(text)


def test_masks_cover_every_pair_of_near_fingerprints():
    rng = random.Random(1)
    for n in (1, 10_000, 3_000_000, 200_000_000):
        masks = block_masks(n)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any((a ^ b) & m & (1 << 64) - 1 == 0 for m in masks)


def test_random_groups_match_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, "alone and without a number"), (None, None), (5, None), (5, ""), (900_000, "Short"), (900_001, "short")]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([2, 5, 30, 200, 600]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((rng.randrange(100_000), " ".join(words)))
    check(spark, rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(500)], k=400)
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(400)] = f"x{rng.randrange(90)}"
        rows.append((i * 2, " ".join(words)))
    check(spark, rows)


def test_dense_and_sparse_lists_match_all_pairs(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for size, least, most in ((500, 2, 5), (400, 5, 7), (30, 4, 12)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fp = centre
            for bit in rng.sample(range(64), rng.randint(least, most)):
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x, 1) for x in fps]
    got = {r.fp: r.root for r in fingerprint_components(spark.createDataFrame(signed, "fp long, copies long")).collect()}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (fp, _) in enumerate(signed):
        groups.setdefault(find(i), set()).add(got[fp])
    assert all(len(x) == 1 for x in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_empty_table_and_further_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    frame = spark.createDataFrame([(1, "a b c d", "x", 1), (2, "A B C D", "y", 2)], "doc_id int, text string, fp string, pivot int")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(frame).collect()} == {(1, 1), (2, 1)}
