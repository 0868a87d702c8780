"""An inverted index of a corpus for lexical search: posting lists by term, in slices of the documents, with block maxima.

A slice holds the documents of a range of ids, ranges being quantiles, so a list of a term that every document has is cut into
slices too. The index is written once; a search reads the lists of the terms of a block of queries only, no text, and each
slice gives its k best documents a query, blocks of documents being skipped that cannot be among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.skipping import BLOCK_BITS, PostingList, best_of_shard
from lodeline.operators.retrieve import _SCORED, blocks, corpus_terms, query_terms, read, rounded, top_k
from lodeline.plans.shared import bound_batches, discard, join_checked, materialise, shared_dir

#: Documents of a slice, about; the most slices, whose bounds the driver holds.
SLICE_DOCS, MOST_SLICES = 8192, 65_536


def _scorer(names: np.ndarray, n: np.ndarray, terms: list[list[str]], k: int):
    """A function from the lists and the documents of a slice to each query's k best documents there."""

    def score(lists: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(lists) and len(docs):
            ids = docs["doc_ids"].iloc[0]
            blocks_here = (len(ids) >> BLOCK_BITS) + 1
            known = {t: PostingList(p.astype(np.int64), np.ones(len(p), np.int64), blocks_here) for t, p in zip(lists["term"], lists["places"], strict=True)}
            for name, least, own in zip(names, n, terms, strict=True):
                mine = [known[t] for t in own if t in known]
                if mine:
                    at, hits, _ = best_of_shard(mine, len(ids), k)
                    out.append(pd.DataFrame({"query_id": name, "doc_id": ids[at], "score": rounded(np.minimum(1.0, hits / least))}))
        return pd.concat(out)

    return score


class LexicalIndex:
    """``lists`` (slice, term, places) and ``docs`` (slice, doc_ids in order) as tables below ``path``.

    A place is a document's number in its slice. Every posting adds one to a score, so the maximum of a list's block is one
    where the list has a place in it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.lists, self.docs = path, spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/docs")

    @classmethod
    def build(cls, corpus: DataFrame, path: str, slice_docs: int = SLICE_DOCS) -> LexicalIndex:
        """Index (doc_id, terms), terms being distinct. Null ids and documents without terms are left out; ids are distinct."""
        spark = corpus.sparkSession
        bound_batches(spark)
        rows = materialise(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "terms").where("doc_id is not null and size(terms) > 0"), "lexical-rows")
        count = max(1, min(MOST_SLICES, -(-rows.count() // slice_docs)))
        inner = [i / count for i in range(1, count)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", F.lit(inner), 20 * count)).first()[0] or [])) if inner else []

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "slice": np.searchsorted(np.array(bounds, np.int64), batch["doc_id"].to_numpy(np.int64), side="right").astype(np.int32)})

        sliced = rows.select("doc_id").mapInPandas(cut, "doc_id long, slice int")
        sliced.groupBy("slice").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).write.parquet(f"{path}/docs")
        numbered = spark.read.parquet(f"{path}/docs").select("slice", F.posexplode("doc_ids").alias("place", "doc_id"))
        postings = numbered.join(rows, "doc_id").select("slice", "place", F.explode("terms").alias("term"))
        lists = postings.groupBy("slice", "term").agg(F.array_sort(F.collect_list("place")).alias("places"))
        lists.repartitionByRange("term", "slice").sortWithinPartitions("term", "slice").write.parquet(f"{path}/lists")
        discard(rows)
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank of (query_id, n, terms): terms in common / max(4, n), 1 at most; ties by the least doc_id."""
        spark, found = queries.sparkSession, None
        for part in blocks(queries):
            wanted = materialise(spark.createDataFrame([(t,) for t in sorted({t for own in part["terms"] for t in own})], "term string"), "lexical-terms")
            scorer = _scorer(part["query_id"].to_numpy(np.int64), np.maximum(4, part["n"].to_numpy()), [list(own) for own in part["terms"]], k)
            lists = join_checked(self.lists.select("slice", "term", "places"), wanted, "term", "left_semi")
            mine = lists.groupBy("slice").cogroup(self.docs.groupBy("slice")).applyInPandas(scorer, "query_id long, doc_id long, score double")
            mine = materialise(top_k(mine, k), "lexical-matches")
            discard(wanted)
            found = mine if found is None else found.unionByName(mine)
        return found.select("query_id", "doc_id", "score", "rank") if found is not None else spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")


def indexed(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    import uuid

    return LexicalIndex.build(corpus_terms(spark, sf_dir), f"{shared_dir(spark)}/lodeline/lexical-index-{uuid.uuid4().hex}")


def q_lexical_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each item by the index."""
    return indexed(spark, sf_dir).search(query_terms(spark, sf_dir), 5)


def q_lexical_index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by term over all slices of the index, for terms of every item."""
    index = indexed(spark, sf_dir)
    asked = materialise(query_terms(spark, sf_dir).select(F.explode("terms").alias("term")).distinct(), "lexical-terms")
    lists = join_checked(index.lists, asked, "term", "left_semi")
    return lists.groupBy("term").agg(F.sum(F.size("places")).alias("df"))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def q_overlap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that have any word of an item, the four with most of its words."""
    import uuid

    corpus = read(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("terms"))
    index = LexicalIndex.build(corpus, f"{shared_dir(spark)}/lodeline/word-index-{uuid.uuid4().hex}")
    items = materialise(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("terms")).withColumn("n", F.size("terms")), "item-words")
    found = index.search(items, 4).join(items.select("query_id", "n"), "query_id")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round(F.col("score") * F.greatest(F.lit(4), "n")).cast("int").alias("overlap"), "rank")


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
ORACLE = {
    "overlap_evidence": f"""WITH i AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
p AS (SELECT item_id, doc_id, CAST(count(*) AS INT) AS overlap FROM i JOIN d USING (w) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM p) WHERE rank <= 4""",
    "lexical_index_topk": f"""WITH {_SCORED}, x AS (SELECT query_id, doc_id, round(keyword, 6) AS score FROM f)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 5""",
    "lexical_index_lists": f"WITH {_SCORED} SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT unnest(t) FROM i) GROUP BY 1",
}
