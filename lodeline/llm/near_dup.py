"""MinHash near-dedup by bottom-k sketches of one hash function.

1. A pass over the texts hashes the 5-word shingles (64 bits); the k least values of a document are its sketch, and
   a digest of the whole set finds equal sets. One document stands for each distinct set.
2. Inverted lists of the retained values generate overlaps. Linked sets share so many retained values
   (``_retained_overlap``) that a document which has more than the rest alone is linked to none. So documents that
   share only a common passage, or nothing, drop out here, and only the others' full sets are formed.
3. These are listed by the values of their full sets that others among them have, rarest first. A link needs so large
   an overlap that the two meet in a list of one of their first values (``_needed``; exact), and a document whose own
   values outnumber the rest needs no list.
4. A list is not paired off: all members are compared with its most central member (a pivot), linked members become
   one component, and the pivot leaves the list. This repeats, with more pivots a list each time, until every list
   lies within one component: no pair of different components that shares a list stays unseen, while a group of m
   near copies costs m comparisons, not m squared.
5. Union sketches estimate a candidate's similarity, and the exact Jaccard of the full sets confirms it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.components import connected_components
from lodeline.plans.shared import bound_batches, discard, join_checked, materialise

SHINGLE_WORDS = 5
#: The k of bottom-k.
RETAINED = 96
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The values that linked sets share among the k least of their union are drawn without replacement, a share PERCENT
#: of them at least; so many standard deviations below the mean a count rules a link out (one in 10^9).
DEVIATIONS = 6.0
#: Pivots of a list in the first round, and their growth from round to round.
PIVOT_GROWTH = 64
#: Growth of sizes from class to class.
CLASS_RATIO = 1.1

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z count as a-z; words are runs without ASCII white space. Fewer words than ``words`` make one
    shingle; none, or null, make the empty set.
    """
    import xxhash

    found = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return np.empty(0, np.int64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        rolled = h[:n].copy()
        for j in range(1, words):
            rolled = rolled * _MULTIPLIER + h[j : j + n]
        return np.unique(_mixed(rolled).view(np.int64))


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, its k least values."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(found[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _full_sets(docs: DataFrame) -> DataFrame:
    """rep, members: the whole shingle set of each document."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col("doc_id").alias("rep"), "text").mapInArrow(run, schema)


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Members that linked sets of these sizes share at least."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100 + percent)).cast("int")


def _retained_overlap(union: Column, k: int, percent: int) -> Column:
    """Common values among the k least of a union of this size, at least, if the sets are linked and the union exceeds k."""
    t = percent / 100
    spread = F.sqrt(F.lit(k * t * (1 - t)) * F.greatest(union - k, F.lit(0.0)) / F.greatest(union - 1, F.lit(1.0)))
    return F.floor(F.lit(k * t) - DEVIATIONS * spread).cast("int")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(CLASS_RATIO)))).cast("int")


def _possible(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """rep, n of the documents whose retained values leave a link possible: they have few enough alone."""
    entries = reps.select("rep", "n", F.explode("sketch").alias("v"))
    common = entries.groupBy("v").agg(F.count("*").alias("f")).where("f > 1").select("v")
    n, largest = F.col("n"), F.col("n") * F.lit(100 / percent)  # size of the largest partner, and of that union
    whole = k * percent // 100  # a partner of up to so many members is retained whole, like the set itself
    needed = F.when(n <= whole, F.ceil(n * F.lit(percent) / F.lit(100))).when(n <= k, F.lit(-(-whole * percent // 100))).otherwise(_retained_overlap(largest, k, percent))
    return entries.join(common, "v", "left_semi").groupBy("rep", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= needed).select("rep", "n")


def _listed(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, central, keys: documents that stand in a list with another, and the lists they stand in.

    A list belongs to a value and a class of sizes. In the order of frequency, rarest first, the smaller of two linked
    sets has a common value among its first n - needed + 1 (it is indexed there), and so has the larger, which probes
    the classes of all sizes it may be linked to. Values that a document has alone come first and make no list.
    ``place`` is the value's place in that order; ``central`` the mean frequency of a document's values.
    """
    entries = sets.select("rep", F.size("members").alias("n"), F.explode("members").alias("v"))
    common = entries.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    n = F.col("n")
    alone = n - F.size("found")
    lowest = F.ceil(n * F.lit(percent) / F.lit(100)).cast("int")
    own = _size_class(n)
    indexed = n - _needed(n, n, percent) + 1 - alone

    def probed(c: Column) -> Column:
        smallest = F.least(F.greatest(F.ceil(F.pow(F.lit(CLASS_RATIO), c)) - 1, lowest), n)  # of the partners in the class
        length = F.greatest(n - _needed(n, smallest, percent) + 1 - alone, F.when(c == own, indexed).otherwise(F.lit(0)), F.lit(0))
        return F.transform(
            F.slice("found", 1, length.cast("int")),
            lambda x, i: F.struct(x["v"].alias("v"), c.cast("int").alias("c"), (alone + i + 1).cast("int").alias("place"), ((c == own) & (i < indexed)).alias("indexed")),
        )

    return (
        entries.join(common, "v")
        .groupBy("rep", "n")
        .agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("found"), (F.sum("f") / n).alias("central"))
        .withColumn("keys", F.flatten(F.transform(F.sequence(_size_class(lowest), own), probed)))
        .where(F.size("keys") > 0)
        .select("rep", "n", "central", "keys")
    )


def _round_pairs(lists: DataFrame, pivots_a_list: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pivots (v, c, p, ...) of each unfinished list, and the distinct pairs (a, b) to compare."""
    seat = F.pmod(F.xxhash64("rep"), F.lit(pivots_a_list))
    pivots = (
        lists.where("indexed")
        .withColumn("seat", seat)
        .groupBy("v", "c", "seat")
        .agg(F.max(F.struct("central", "rep", "comp", "n", "place")).alias("top"))
        .select("v", "c", F.col("top.rep").alias("p"), F.col("top.comp").alias("pcomp"), F.col("top.n").alias("pn"), F.col("top.place").alias("pplace"))
    )
    # what can follow the first common value, in either's order, bounds the overlap
    bound = F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pplace")) + 1
    l, r = lists.alias("l"), pivots.alias("r")
    meets = (F.col("l.v") == F.col("r.v")) & (F.col("l.c") == F.col("r.c")) & (F.col("comp") != F.col("pcomp"))
    meets &= (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * F.lit(percent)) & (bound >= _needed(F.col("n"), F.col("pn"), percent))
    pairs = l.join(r, meets).select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b")).distinct()
    return pivots, pairs


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union sketch allows a link and whose full sets are similar enough, as edges (u, v)."""
    s, x = sketches.select("rep", "n", "sketch"), sets
    estimated = (
        pairs.join(s.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(s.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .withColumn("merged", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
        .withColumn("both", F.size(F.array_intersect("merged", F.array_intersect("sa", "sb"))))
        .withColumn("union", (F.col("na") + F.col("nb")) * F.lit(100 / (100 + percent)))  # at most, if they are linked
        .where(F.col("both") >= F.when(F.col("union") <= k, _needed(F.col("na"), F.col("nb"), percent)).otherwise(_retained_overlap(F.col("union"), k, percent)))
        .select("a", "b")
    )
    return (
        estimated.join(x.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a")
        .join(x.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b")
        .withColumn("shared", F.size(F.array_intersect("ma", "mb")))
        .where(F.col("shared") * 100 >= (F.size("ma") + F.size("mb") - F.col("shared")) * F.lit(percent))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int = RETAINED, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, whatever else).

    Empty or null texts have no shingles and stand alone. Equal texts are one component. Rows that repeat a
    doc_id get one component. A null doc_id is never a representative: such a row takes the component of an equal
    text, else a null one, and is kept only then. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = materialise(_sketches(docs, k), "sketches")
    reps = (
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sketch")).alias("one"))
        .select("digest", F.col("one.doc_id").alias("rep"), "one.n", "one.sketch")
    )
    reps = materialise(reps, "representatives")
    possible = materialise(_possible(reps, k, percent), "possible")
    sketches = materialise(reps.join(possible.select("rep"), "rep", "left_semi").select("rep", "n", "sketch"), "possible-sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialise(_full_sets(join_checked(texts, possible.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")), "possible-sets")
    listed = _listed(sets, percent).select("rep", "n", "central", F.col("rep").alias("comp"), F.explode("keys").alias("x"))
    lists = materialise(listed.select("rep", "n", "central", "comp", "x.*"), "lists")
    forest = connected_components(rows.sparkSession.createDataFrame([], "u long, v long"))
    pivots_a_list = 1
    while True:
        open_lists = lists.groupBy("v", "c").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("indexed").alias("any")).where("low != high and any").select("v", "c")
        unfinished = materialise(lists.join(open_lists, ["v", "c"], "left_semi"), "lists")
        discard(lists)
        lists = unfinished
        if lists.isEmpty():
            break
        pivots, pairs = _round_pairs(lists, pivots_a_list, percent)
        pivots = materialise(pivots, "pivots")
        edges = _confirmed(pairs, sketches, sets, k, percent)
        grown = connected_components(forest.unionByName(edges))
        left = lists.join(pivots.select("v", "c", F.col("p").alias("rep")), ["v", "c", "rep"], "left_anti").drop("comp")
        moved = left.join(grown.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
        after = materialise(moved.select("rep", "n", "central", F.coalesce("root", "rep").alias("comp"), "v", "c", "place", "indexed"), "lists")
        discard(lists, pivots, forest)
        lists, forest = after, grown
        pivots_a_list *= PIVOT_GROWTH
    discard(lists, sets, sketches, possible)

    classes = reps.select("digest", "rep").join(forest.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
    labelled = rows.select("doc_id", "n_shingles", "digest").join(classes.select("digest", F.coalesce("root", "rep").alias("root")), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return labelled.withColumn("component_id", component).select(
        "doc_id", "n_shingles", "component_id", F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that another document of their component stands for."""
    verdicts = near_duplicates(docs)
    dropped = materialise(verdicts.where("not kept").select("doc_id").where("doc_id is not null").distinct(), "dropped")
    return join_checked(docs, dropped, "doc_id", "left_anti").select(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
#: No SQL: the plain form compares all pairs; tests do so on small tables.
ORACLE: dict[str, str] = {}
