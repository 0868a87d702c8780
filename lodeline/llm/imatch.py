"""I-Match document fingerprints, in DataFrame functions only.

Terms are runs of letters and digits, in lower case. The lexicon holds the terms whose document frequency
lies in a band of the corpus, i.e. whose inverse document frequency does; as every one of its terms is in
at least ``LEAST_SHARE`` of the documents, its size is at most (mean distinct terms a document) /
``LEAST_SHARE``, however large the corpus. All of a document's terms are looked up in it, however long the text is.

The sorted distinct terms of the lexicon that a document has are hashed to one signature. The same is done in
randomised lexicons, the same ones for all texts: random halves of the lexicon, and parts of a hash's M parts of it for
M = 8, 32, ... 8192 (LADDER). Large ones notice any change of a short text, small ones survive changes of a
long one; whatever its length, all of a text's terms are in the signatures of the whole lexicon, of its halves and of its
eighths. Signatures have 64 bits.

Likeness of two fingerprints: equal signatures / randomised lexicons in which either has a term.
A text without a term of the lexicon is fingerprinted by its digest; its likeness is 1 to an equal text, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.plans.shared import discard, join_checked, materialise

#: The band: shares of the documents that hold a term of the lexicon.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.1
#: Parts that the lexicon is dealt into, and how many of them are hashed; of 2 parts, so many random halves.
LADDER = ((1, 1), (2, 4), (8, 8), (32, 16), (128, 16), (512, 16), (2048, 16), (8192, 16))
#: Rows of a bucket of consecutive documents; and the most buckets, whose bounds the driver holds.
BUCKET_ROWS, MOST_BUCKETS = 1000, 65_536
LEAST_KEY = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(F.array_distinct(words), lambda x: F.xxhash64(x))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """h, df: documents that hold each term."""
    return docs.select(F.explode(term_hashes(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))


def in_order_with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(bucket, place, real, doc_id, t) in descending doc_id within a bucket, and the number of documents.

    Each bucket ends with a copy of the row that follows it in the whole order (real: false), so a window over
    a bucket finds every row's next; the last row's is the first of all. Equal ids are ordered by text; null ids
    come last.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_KEY)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    n = keyed.count()
    count = max(1, min(MOST_BUCKETS, n // bucket_rows))
    inner = [i / count for i in range(1, count)]
    bounds = sorted(set(keyed.agg(F.percentile_approx("key", F.lit(inner), 10 * count)).first()[0] or [])) if inner else []
    groups = [bounds[i : i + 256] for i in range(0, len(bounds), 256)]

    def below(values: list[int]) -> Column:
        return F.size(F.filter(F.lit(values), lambda x: x <= F.col("key")))

    if groups:
        outer = below([g[0] for g in groups])
        inside = F.size(F.filter(F.element_at(F.lit([g + [g[-1]] * (256 - len(g)) for g in groups]), F.greatest(outer, F.lit(1))), lambda x: x <= F.col("key")))
        bucket = F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * 256 + inside)
    else:
        bucket = F.lit(0)
    keyed = keyed.withColumn("bucket", bucket.cast("int")).withColumn("real", F.lit(True))
    tops = materialise(keyed.groupBy("bucket").agg(F.max("key").alias("key")), "bucket-tops")  # a row a bucket
    heads = keyed.join(F.broadcast(tops), ["bucket", "key"]).groupBy("bucket", "key").agg(F.first("doc_id").alias("doc_id"), F.min("t").alias("t"))
    order = Window.orderBy("bucket")
    ends = tops.select("bucket", F.lead("bucket").over(order).alias("upper"), F.max("bucket").over(Window.partitionBy()).alias("last"), F.min("bucket").over(Window.partitionBy()).alias("first"))
    ends = ends.select(F.col("bucket").alias("source"), F.coalesce("upper", "first").alias("bucket"))
    follows = heads.withColumnRenamed("bucket", "source").join(F.broadcast(ends), "source").select("bucket", "key", "doc_id", "t", F.lit(False).alias("real"))
    both = keyed.select("bucket", "key", "doc_id", "t", "real").unionByName(follows)
    w = Window.partitionBy("bucket").orderBy(F.col("real").desc(), F.col("key").desc(), F.col("t"))
    return both.withColumn("place", F.row_number().over(w)).withColumn("next_t", F.lead("t").over(w)), n


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often the lambda functions in ``use`` read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signature(terms: Column) -> Column:
    """Hexadecimal hash of sorted terms; empty if there is none."""
    return F.when(F.size(terms) == 0, F.lit("")).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(terms))), 16, "0"))


def _signatures(hashes: Column, parts: int, subsets: int) -> Column:
    """One signature for each of so many subsets of a lexicon dealt into ``parts``."""
    if parts == 1:
        return F.array(_signature(hashes))
    every = F.sequence(F.lit(0), F.lit(subsets - 1))
    if parts == 2:
        return F.transform(every, lambda k: _bound(F.filter(hashes, lambda h: F.call_function("shiftright", h, k + 40).bitwiseAND(F.lit(1)) == 1), _signature))
    dealt = F.filter(hashes, lambda h: F.pmod(h, F.lit(parts)) < subsets) if subsets < parts else hashes
    return _bound(dealt, lambda some: F.transform(every, lambda k: _bound(F.filter(some, lambda h: F.pmod(h, F.lit(parts)) == k), _signature)))


def _fingerprint(of: Column) -> Column:
    return F.when(of["signatures"][0] == "", F.concat(F.lit("text:"), of["digest"])).otherwise(F.array_join(of["signatures"], ","))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two structs (signatures, digest)."""

    def share(pairs: Column) -> Column:
        return F.when(F.size(pairs) == 0, F.lit(0.0)).otherwise(F.size(F.filter(pairs, lambda v: v)) / F.size(pairs))

    pairs = F.filter(F.zip_with(a["signatures"], b["signatures"], lambda p, q: F.when((p != "") | (q != ""), p == q)), lambda v: v.isNotNull())
    return F.when(a["digest"] == b["digest"], F.lit(1.0)).otherwise(_bound(pairs, share))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last third replaced by the beginning of the next document's (descending doc_id).
    Nulls count as empty texts; repeated rows follow each other; very long texts are read whole; an empty table gives
    an empty result; further columns are not read.
    """
    frequencies = materialise(document_frequencies(docs), "term-frequencies")
    rows, n = in_order_with_next(docs)
    band = (F.col("df") >= max(2.0, least * n)) & (F.col("df") <= max(2.0, most * n))
    lexicon = materialise(frequencies.where(band).select("h", F.lit(True).alias("known")), "lexicon")
    discard(frequencies)

    size = F.length("t")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 3) as int))"), F.substring(F.coalesce("next_t", F.lit("")), F.lit(1), cut))
    about = F.struct("real", "doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.sha2("t", 256).alias("sha256"))
    texts = rows.withColumn("edited", edited).select("bucket", "place", about.alias("about"), term_hashes(F.col("t")).alias("own"), F.when(F.col("real"), term_hashes(F.col("edited"))).alias("other"))
    # a row for the document and one for each term of either text: only the first carries what is known of the document
    item = "struct<about: struct<real: boolean, doc_id: bigint, n_chars: bigint, edited_sha256: string, sha256: string>, which: int, h: bigint>"
    none = F.lit(None)

    def terms_of(hashes: str, which: int) -> Column:
        known = F.coalesce(hashes, F.array().cast("array<bigint>"))
        return F.transform(known, lambda h: F.struct(none.alias("about"), F.lit(which).alias("which"), h.alias("h")).cast(item))

    items = F.concat(F.array(F.struct("about", none.alias("which"), none.alias("h")).cast(item)), terms_of("own", 0), terms_of("other", 1))
    spread = texts.select("bucket", "place", F.explode(items).alias("x")).select("bucket", "place", "x.*")
    kept = join_checked(spread, lexicon, "h", "left").where("about is not null or known")
    found = kept.groupBy("bucket", "place").agg(F.first("about", ignorenulls=True).alias("about"), F.array_sort(F.collect_list(F.when(F.col("which").isNotNull(), F.struct("which", "h")))).alias("terms")).select("bucket", "place", "about.*", "terms")

    for i, name, digest in ((0, "own", "sha256"), (1, "other", "edited_sha256")):
        which = F.lit(i)
        found = found.withColumn("hashes", F.transform(F.filter("terms", lambda x: x["which"] == which), lambda x: x["h"]))  # noqa: B023
        signatures = F.concat(*(_signatures(F.col("hashes"), parts, subsets) for parts, subsets in LADDER))
        found = found.withColumn(name, F.struct(signatures.alias("signatures"), F.col(digest).alias("digest")))
    w = Window.partitionBy("bucket").orderBy("place")
    found = found.select("bucket", "place", "real", "doc_id", "n_chars", "edited_sha256", "own", "other").withColumn("following", F.lead("own").over(w))
    return found.where("real").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _fingerprint(F.col("own")).alias("fingerprint"),
        _fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and the likenesses."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_imatch": op5_imatch}
#: No SQL: xxhash64 is Spark's; tests compare the texts, orders and likenesses with plain Python.
ORACLE: dict[str, str] = {}
