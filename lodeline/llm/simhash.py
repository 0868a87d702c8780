"""SimHash near-dedup by tables of distances to reference fingerprints.

1. A pass over the texts gives each document a 64-bit fingerprint: a bit is the majority of that bit in the XXH64
   hashes of all its 4-word shingles. Equal fingerprints are handled as one from here on.
2. Lists hold what can be linked. The 64 bits are cut into blocks; fingerprints at a distance of at most MOST_BITS agree
   in all blocks but MOST_BITS. (In terms of references: those that differ from a base in one bit of a block are at
   equal distances from both.) A list belongs to a choice of blocks and what they hold. More blocks, for more
   fingerprints, keep the lists of unlike fingerprints at about one member.
3. Each list has a pivot, its most repeated fingerprint. The distances to it link the members near it. Lists that then
   lie in one component are closed; so is a list of two.
4. In the other lists, members of different components are compared. A table holds each fingerprint's distances to
   REFERENCES fingerprints of the corpus; by the triangle inequality a pair whose distances to one reference differ by more than
   MOST_BITS is discarded; the survivors' own distance decides.
5. A list of many near copies in different components would make a pair of every two. There the distances to the
   list's pivot serve instead: each member names what is left of its difference from the pivot after dropping up to MOST_BITS
   bits. Linked members meet in what their differences have in common, having dropped at most MOST_BITS bits together, and
   all who meet there are linked through the one that dropped least. The cheaper of both ways is taken for each list;
   both find every link between components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.components import connected_components
from lodeline.plans.shared import bound_batches, discard, join_checked, materialise

SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints that differ in so many bits, or fewer, are linked.
MOST_BITS = 4
#: Columns of the table of distances.
REFERENCES = 24
#: Shingle hashes whose bits are counted at once.
COUNTED = 65_536


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text (null: empty), unsigned.

    A-Z count as a-z; words are runs without ASCII white space. Fewer words than a shingle has make one shingle; none
    give zero.
    """
    import xxhash

    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)
    n = len(words) - SHINGLE_WORDS + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, COUNTED):
        ones += np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) of every row of (doc_id, text, whatever else)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(n: int, most_bits: int = MOST_BITS) -> list[int]:
    """Masks (signed) of the choices of blocks for so many fingerprints: all but ``most_bits`` of the blocks."""
    count = most_bits + 1
    while n > 2 ** (64 * (count - most_bits) / count) and count < most_bits + 6:
        count += 1
    edges = [round(64 * i / count) for i in range(count + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, count - most_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _members(distinct: DataFrame, most_bits: int) -> DataFrame:
    """which, key, fp, pivot: the members of each list of two or more."""
    masks = F.lit(block_masks(distinct.count(), most_bits)).cast("array<bigint>")
    lists = F.transform(masks, lambda m, i: F.struct(i.cast("int").alias("which"), F.col("fp").bitwiseAND(m).alias("key")))
    entries = distinct.select("fp", "copies", F.explode(lists).alias("x")).select("fp", "copies", "x.*")
    shared = entries.groupBy("which", "key").agg(F.count("*").alias("n"), F.max(F.struct("copies", "fp")).alias("top")).where("n > 1")
    shared = materialise(shared.select("which", "key", F.col("top.fp").alias("pivot")), "simhash-lists")
    members = materialise(join_checked(entries.drop("copies"), shared, ["which", "key"]), "simhash-members")
    discard(shared)
    return members


def _dropped(most_bits: int):
    """Rows (which, key, fp, comp, rest, dropped): what is left of the difference from the pivot when bits are dropped."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            which, key, fp, comp, pivot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i, difference in enumerate((fp ^ pivot).view(np.uint64).tolist()):
                bits = [1 << j for j in range(64) if difference >> j & 1]
                left = [(difference - sum(c), k) for k in range(min(most_bits, len(bits)) + 1) for c in combinations(bits, k)]
                rest = np.array([r for r, _ in left], np.uint64).view(np.int64)
                same = [pa.array(np.full(len(left), x[i])) for x in (which, key, fp, comp)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(rest), pa.array([k for _, k in left], pa.int32())], names=["which", "key", "fp", "comp", "rest", "dropped"])

    return run


def _subsets(bits: Column, most_bits: int) -> Column:
    """Number of ways to drop up to ``most_bits`` of so many bits."""
    total, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, most_bits + 1):
        term = term * (bits - (k - 1)) / k
        total = total + F.greatest(term, F.lit(0.0))
    return total


def _remaining_edges(members: DataFrame, forest: DataFrame, references: list[int], most_bits: int) -> DataFrame:
    """Links (u, v) between different components of the lists that a look at their pivots leaves open."""
    table = F.transform(F.lit(references).cast("array<bigint>"), lambda r: _apart(F.col("fp"), r).cast("byte"))
    placed = join_checked(members.where("fp != pivot"), forest.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    placed = materialise(placed.select("which", "key", "fp", "pivot", F.coalesce("root", "fp").alias("comp"), table.alias("table")), "simhash-placed")
    of = ["which", "key"]
    parts = placed.groupBy(*of, "comp").agg(F.count("*").alias("m"), F.sum(_subsets(_apart(F.col("fp"), F.col("pivot")), most_bits)).alias("names"))
    open_lists = parts.groupBy(*of).agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m").cast("double")).alias("same"), F.sum("names").alias("names")).where("parts > 1")
    open_lists = materialise(open_lists.select(*of, ((F.col("m") * F.col("m").cast("double") - F.col("same")) / 2 > F.col("names")).alias("dense")), "simhash-open")
    still = materialise(join_checked(placed, open_lists, of), "simhash-still-open")

    sparse = still.where("not dense")
    l, r = sparse.alias("l"), sparse.alias("r")
    meets = (F.col("l.which") == F.col("r.which")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & (F.col("l.comp") != F.col("r.comp"))
    discarded = F.exists(F.zip_with("l.table", "r.table", lambda a, b: F.abs(a - b)), lambda x: x > most_bits)
    pairs = l.join(r, meets & ~discarded).where(_apart(F.col("l.fp"), F.col("r.fp")) <= most_bits).select(F.col("r.fp").alias("u"), F.col("l.fp").alias("v"))

    names = materialise(still.where("dense").select(*of, "fp", "comp", "pivot").mapInArrow(_dropped(most_bits), "which int, key long, fp long, comp long, rest long, dropped int"), "simhash-names")
    least = names.groupBy(*of, "rest").agg(F.min(F.struct("dropped", "fp", "comp")).alias("x"), F.count("*").alias("n")).where("n > 1")
    least = least.select(*of, "rest", F.col("x.dropped").alias("d"), F.col("x.fp").alias("v"), F.col("x.comp").alias("vcomp"))
    stars = names.join(least, [*of, "rest"]).where((F.col("dropped") + F.col("d") <= most_bits) & (F.col("comp") != F.col("vcomp"))).select(F.col("fp").alias("u"), "v")
    edges = materialise(pairs.unionByName(stars).distinct(), "simhash-edges")
    discard(placed, open_lists, still, names)
    return edges


def fingerprint_components(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """fp, root: the component of each of (fp, copies), all different; its name is one of its fingerprints."""
    references = [x.fp for x in distinct.orderBy(F.xxhash64("fp"), "fp").limit(REFERENCES).select("fp").collect()]
    members = _members(distinct, most_bits)
    near = members.where((F.col("fp") != F.col("pivot")) & (_apart(F.col("fp"), F.col("pivot")) <= most_bits))
    forest = connected_components(near.select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct())
    edges = _remaining_edges(members, forest, references, most_bits)
    whole = connected_components(forest.unionByName(edges))
    discard(members, forest, edges)
    return distinct.join(whole.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of ``docs`` (doc_id, text, whatever else).

    Texts without words, and nulls, have fingerprint zero and are linked like any other. Rows that repeat a doc_id count
    each by its text; very long texts are read whole. component_id is the least doc_id reachable; a null doc_id is never
    the least, and a component without any other has a null one. An empty table gives an empty result; further columns
    are not read.
    """
    bound_batches(docs.sparkSession)
    rows = materialise(fingerprints(docs), "simhash-rows")
    distinct = materialise(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")), "simhash-distinct")
    rooted = materialise(fingerprint_components(distinct.select("fp", "copies"), most_bits).join(distinct.select("fp", "first"), "fp"), "simhash-roots")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = materialise(join_checked(rooted, least, "root").select("fp", "component_id"), "simhash-named")
    discard(distinct, rooted, least)
    return join_checked(rows, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_simhash": op11_simhash}
#: No SQL: XXH64 with a seed is not among its functions; tests compare all pairs on small tables.
ORACLE: dict[str, str] = {}
