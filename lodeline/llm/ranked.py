"""Ranked lexical search: accumulators of short lists, then document at a time over long lists (hybrid TAAT-DAAT).

1. A pass over the texts writes an inverted index in shards, each of the documents that a task meets one after the other: posting
   lists (document, occurrences) of the terms that a block of queries asks for, lengths, and counts. The counts of all
   shards give the statistics of the collection.
2. A search of a shard takes each query's short lists term at a time: their summed accumulators are one list, whose
   bound is its largest sum. Then it goes through the documents in order: blocks of documents are skipped whose bound (the
   accumulators' and the block maxima of the long lists) is below the k-th best score so far; in the others, lists too
   weak to bring a document in alone are only asked about documents that something else brought in and that can still
   make it.
3. Each shard gives k documents a query, of which the k best of all stay.

Queries are taken in blocks, each with a pass of its own, so a task holds the terms of one block only.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.skipping import BLOCK_BITS, PostingList, best_of_shard
from lodeline.plans.shared import bound_batches, discard, materialise

#: Results of a query.
BEST = 10
#: Fixed values of the score: units of a weight, of a share, of the saturation, and the share of length in percent.
WEIGHT_UNIT, SHARE_UNIT, TF_UNIT, SATURATION, LENGTH_PERCENT = 1000, 1_000_000_000, 1000, 8, 90
#: Queries of a block.
QUERY_BLOCK = 1000
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000

#: A-Z to a-z, what is no part of a term to a space; bytes above 127 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SHARD = "docs long, words long, doc_ids array<long>, lengths array<long>, terms array<binary>, sizes array<int>, places array<int>, tfs array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of A-Z (as a-z), digits and characters above U+007F in a UTF-8 text."""
    return (text or b"").translate(_FOLD).split()


def _indexed(vocabulary: frozenset, shard_docs: int, shard_postings: int):
    """Batches of (doc_id, text) to shards, one a row. Documents of a shard are in the order of doc_id, nulls last."""

    def shard(doc_ids: list, lengths: array, lists: dict, docs: int, words: int):
        import pyarrow as pa

        order = np.array(sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0)), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, sizes, places, tfs = sorted(lists), [], [], []
        for term in terms:
            met, often = (np.frombuffer(x, np.int32) for x in lists[term])
            at = place[met]
            sizes.append(len(at))
            places.append(np.sort(at))
            tfs.append(often[at.argsort()])
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        columns = [docs, words, [doc_ids[i] for i in order], np.array(lengths, np.int64)[order], terms, sizes, joined(places), joined(tfs)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=["docs", "words", "doc_ids", "lengths", "terms", "sizes", "places", "tfs"])

    def run(batches: Iterator) -> Iterator:
        doc_ids, lengths, lists, docs, words, postings = [], array("q"), {}, 0, 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                docs, words = docs + bool(found), words + len(found)
                counts = Counter(found)
                own = vocabulary & counts.keys()
                for t in own:
                    met, often = lists.get(t) or lists.setdefault(t, (array("i"), array("i")))
                    met.append(len(doc_ids))
                    often.append(counts[t])
                if own:
                    doc_ids.append(doc_id)
                    lengths.append(len(found))
                    postings += len(own)
                if len(doc_ids) >= shard_docs or postings >= shard_postings:
                    yield shard(doc_ids, lengths, lists, docs, words)
                    doc_ids, lengths, lists, docs, words, postings = [], array("q"), {}, 0, 0, 0
        if docs:
            yield shard(doc_ids, lengths, lists, docs, words)

    return run


def weight(n: int, df: int) -> int:
    """Weight of a term that df of n documents have."""
    return math.floor(WEIGHT_UNIT * math.log((2 * n + 2) / (2 * df + 1)))


def _norms(lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    if LENGTH_PERCENT * int(lengths.max(initial=0)) * n >= 1 << 63:
        return (100 - LENGTH_PERCENT + LENGTH_PERCENT * lengths.astype(object) * n // words).astype(np.int64)
    return 100 - LENGTH_PERCENT + LENGTH_PERCENT * lengths * n // words


def _search(queries: list[frozenset], weights: dict[bytes, int], n: int, words: int, k: int):
    """Shards to (query, doc_id, score): k rows a query and shard."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, terms, sizes, places, tfs = (c[row].values for c in batch.columns)
                docs = len(doc_ids)
                if not docs:
                    continue
                norm = _norms(lengths.to_numpy(), n, words)
                places, tfs = places.to_numpy().astype(np.int64), tfs.to_numpy().astype(np.int64)
                shares = SHARE_UNIT * tfs // (TF_UNIT * tfs + SATURATION * norm[places])
                ends = np.cumsum(sizes.to_numpy())
                lists = {}
                for term, end, size in zip(terms.to_pylist(), ends.tolist(), sizes.to_pylist(), strict=True):
                    part = slice(end - size, end)
                    lists[term] = PostingList(places[part], weights[term] * shares[part], (docs >> BLOCK_BITS) + 1)
                out: list[list] = [[], [], []]
                for q, own in enumerate(queries):
                    mine = [lists[t] for t in own if t in lists]
                    if mine:
                        found, scores, _ = best_of_shard(mine, docs, k)
                        out[0].append(np.full(len(found), q))
                        out[1].append(found)
                        out[2].append(scores)
                if out[0]:
                    q, at, score = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), doc_ids.take(pa.array(at)), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return run


def _block_results(docs: DataFrame, queries: list[frozenset], k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    vocabulary = frozenset().union(*queries)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shards = materialise(texts.mapInArrow(_indexed(vocabulary, shard_docs, shard_postings), _SHARD), "ranked-shards")
    n, words = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    counted = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df"))
    weights = {bytes(r.term): weight(n, r.df) for r in counted.collect()}  # a row for each term of the block's queries
    found = shards.select("doc_ids", "lengths", "terms", "sizes", "places", "tfs").mapInArrow(_search(queries, weights, n, words, k), "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked-results")
    discard(shards)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = QUERY_BLOCK, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text), score above 0.

    Null and empty texts have no terms: such documents are never found and such items find nothing. Each row of either
    table counts, also one that repeats another's id; equal scores have the least doc_id first, null last. Very long texts
    are read whole. Empty tables give an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = items.select("item_id", F.col("text").cast("binary").alias("text"))
    count = max(1, -(-wanted.count() // block))
    dealt = materialise(wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int")), "ranked-items") if count > 1 else wanted.withColumn("block", F.lit(0))
    found = None
    for b in range(count):
        rows = dealt.where(F.col("block") == b).select("item_id", "text").collect()
        queries = [frozenset(terms_of(None if r.text is None else bytes(r.text))) for r in rows]
        if not any(queries):
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"query int, item_id {kind}")
        best = _block_results(docs, queries, k, shard_docs, shard_postings).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # ``block`` names
        found = best if found is None else found.unionByName(best)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_ranked": op13_ranked}
_FOUND = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE: dict[str, str] = {
    "op13_ranked": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND} AS t FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_FOUND}) AS t FROM benchmark),
asked AS (SELECT i, unnest(t) AS term FROM q),
lengths AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT count(*) FROM lengths) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf GROUP BY 1),
m AS (SELECT r, doc_id, 10 + (90 * n * (SELECT count(*) FROM lengths)) // (SELECT CAST(sum(n) AS BIGINT) FROM lengths) AS m FROM lengths),
s AS (SELECT i, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k JOIN q USING (i) WHERE rank <= {BEST}"""
}
