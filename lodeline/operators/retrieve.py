"""Retrieval: views, lexical and vector search, hybrid scores, grading and citation of matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import terms
from lodeline.operators.scan import DOMAINS, _TERMS, _list, _with_aliases
from lodeline.plans.shared import bound_batches, discard, join_checked, materialise

#: Weights of the final score.
SEMANTIC, KEYWORD, PATTERN, CLASS, QUALITY = 0.30, 0.25, 0.25, 0.10, 0.10
#: Groups of terms that state one intent.
PATTERNS = (("the", "and", "that", "with", "from"), ("der", "und", "die", "den", "nicht"), ("les", "des", "une", "dans", "pour"), ("que", "los", "las", "una", "para"), ("license", "mit", "released", "under"))
#: Least scores of a strong and of a weak match, and of one that may be cited.
STRONG, WEAK, CITED = 0.30, 0.18, 0.25
QUERY_BLOCK = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[pd.DataFrame]:
    """A query set in blocks of about ``size`` rows, one at a time: all that the driver holds of it."""
    count = max(1, -(-queries.count() // size))
    dealt = materialise(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int")), "query-blocks")
    for b in range(count):
        part = dealt.where(F.col("_block") == b).drop("_block").toPandas()
        if len(part):
            yield part.sort_values("query_id", ignore_index=True)
    discard(dealt)


class Best:
    """The k best rows of each query of a block seen so far, by score, then the least key."""

    def __init__(self, size: int, k: int, key: str):
        self.k, self.key, self.least, self.rows = k, key, np.full(size, -np.inf), None

    def add(self, rows: pd.DataFrame) -> None:
        """``rows``: q (number of the query), the key, score, whatever else."""
        rows = rows[rows["score"].to_numpy() >= self.least[rows["q"].to_numpy()]]
        if rows.empty:
            return
        both = rows if self.rows is None else pd.concat([self.rows, rows])
        self.rows = both.sort_values(["q", "score", self.key], ascending=[True, False, True]).groupby("q").head(self.k)
        full = self.rows.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy()] = full["min"].to_numpy()


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves up."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank; ties by the least key."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), key))).where(F.col("rank") <= k)


def searched(rows: DataFrame, queries: DataFrame, k: int, schema: str, key: str, one_block) -> DataFrame:
    """The k best ``rows`` of each query: a scan of the rows for each block of queries, every task keeping k a query.

    ``one_block(part)`` returns a function from a batch of rows to the pairs it scores (q, key, score...). What is
    shuffled is k rows a query and task.
    """
    bound_batches(rows.sparkSession)
    found = None
    for i, part in enumerate(blocks(queries)):
        if i == 1:  # several blocks: work the rows out once
            rows = materialise(rows, "searched-rows")
        score, names = one_block(part), part["query_id"].to_numpy()

        def run(batches: Iterator[pd.DataFrame], score=score, names=names) -> Iterator[pd.DataFrame]:
            best = Best(len(names), k, key)
            for batch in batches:
                if len(batch):
                    best.add(score(batch))
            if best.rows is not None:
                yield best.rows.assign(query_id=names[best.rows["q"].to_numpy()]).drop(columns="q")

        mine = materialise(top_k(rows.mapInPandas(run, schema), k, key=key), "block-matches")
        found = mine if found is None else found.unionByName(mine)
    return found if found is not None else rows.sparkSession.createDataFrame([], f"{schema}, rank int")


def vector_top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) by inner product, exact: (query_id, embedding) against all (vec_id, embedding).

    A row is no match of itself. Scores are rounded to 6 places; ties by the least vec_id.
    """

    def one_block(part: pd.DataFrame):
        names, matrix = part["query_id"].to_numpy(np.int64), np.stack(part["embedding"].to_numpy()).astype(float)

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            vec = batch["vec_id"].to_numpy(np.int64)
            products = np.round(np.stack(batch["embedding"].to_numpy()).astype(float) @ matrix.T, 6)
            products[vec[:, None] == names[None, :]] = -np.inf
            row, q = np.nonzero(np.isfinite(products))
            return pd.DataFrame({"q": q, "vec_id": vec[row], "score": products[row, q]})

        return score

    return searched(rows.select("vec_id", "embedding"), queries.select("query_id", "embedding"), k, "vec_id long, score double, query_id long", "vec_id", one_block).select("query_id", "vec_id", "score", "rank")


def term_counts(part: pd.DataFrame):
    """A function from a list of term lists to the matrix (list, query) of terms in common with a block's queries."""
    wanting: dict[str, list[int]] = {}
    for q, own in enumerate(part["terms"]):
        for term in own:
            wanting.setdefault(term, []).append(q)
    index = {t: np.array(q) for t, q in wanting.items()}

    def count(lists) -> np.ndarray:
        out = np.zeros((len(lists), len(part)), np.int32)
        for row, own in zip(out, lists, strict=True):
            met = [index[t] for t in own if t in index]
            if met:
                row += np.bincount(np.concatenate(met), minlength=len(part)).astype(np.int32)
        return out

    return count


def lexical_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by shared terms: (query_id, n, terms) against all (doc_id, terms)."""

    def one_block(part: pd.DataFrame):
        count, n = term_counts(part), np.maximum(4, part["n"].to_numpy())

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            hits = count(batch["terms"])
            row, q = np.nonzero(hits)
            return pd.DataFrame({"q": q, "doc_id": batch["doc_id"].to_numpy(np.int64)[row], "score": rounded(np.minimum(1.0, hits[row, q] / n[q]))})

        return score

    return searched(corpus.select("doc_id", "terms"), queries.select("query_id", "n", "terms"), k, "doc_id long, score double, query_id long", "doc_id", one_block).select("query_id", "doc_id", "score", "rank")


def corpus_terms(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", terms(F.col("text")).alias("terms"))


def query_terms(spark, sf_dir) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms"))
    best = F.array_max(F.array(*(F.struct(F.size(F.array_intersect("terms", F.array(*map(F.lit, w)))).alias("hits"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, (n, w) in enumerate(DOMAINS.items()))))
    return items.withColumn("n", F.size("terms")).withColumn("class", F.when(best["hits"] > 0, F.substring(best["name"], 1, 2)).otherwise("un"))


def _class_of(lang: Column) -> Column:
    return F.when(lang == "de", "ge").when(lang == "es", "sp").otherwise(lang)


def canonical_terms(queries: DataFrame) -> DataFrame:
    """Queries with the terms of their class added: what a repaired or canonical query asks for."""
    words = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for n, w in DOMAINS.items() for x in (n[:2], w)))
    whole = F.array_union("terms", F.coalesce(F.try_element_at(words, F.col("class")), F.array().cast("array<string>")))
    return queries.withColumn("terms", whole).withColumn("n", F.size("terms"))


def scored_matches(spark, sf_dir, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """The k best documents of each item, or of the given (query_id, terms, n, class), with their partial scores."""
    labels = materialise(read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "qualities")
    docs = join_checked(corpus_terms(spark, sf_dir).withColumn("same", _class_of(F.col("lang"))), labels, "doc_id", "left")

    def one_block(part: pd.DataFrame):
        count, n, classes = term_counts(part), part["n"].to_numpy(), part["class"].to_numpy()
        groups = [frozenset(g) for g in PATTERNS]
        wanted = np.array([[float(not g.isdisjoint(own)) for g in groups] for own in part["terms"]])

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            hits = count(batch["terms"])
            row, q = np.nonzero(hits)
            hits = hits[row, q]
            held = np.array([[len(g.intersection(own)) / float(len(g)) for g in groups] for own in batch["terms"]])
            pattern = (held[row] * wanted[q]).max(axis=1)
            semantic = np.minimum(1.0, hits / np.maximum(5, n[q]) + np.where(batch["n_chars"].to_numpy()[row] > 1000, 0.15, 0.0))
            keyword = np.minimum(1.0, hits / np.maximum(4, n[q]))
            same = np.where(classes[q] == batch["same"].to_numpy()[row], 0.55, 0.0)
            label = batch["quality"].fillna(-1).to_numpy(float)[row]
            quality = np.minimum(1.0, np.maximum(label, 0) * 0.8 + np.where(label == 1, 0.15, 0.03))
            final = rounded(SEMANTIC * semantic + KEYWORD * keyword + PATTERN * pattern + CLASS * same + QUALITY * quality)
            return pd.DataFrame({"q": q, "doc_id": batch["doc_id"].to_numpy(np.int64)[row], "lang": batch["lang"].to_numpy()[row], "hits": hits, "n": n[q], "semantic": semantic, "keyword": keyword, "pattern": pattern, "class_score": same, "quality_score": quality, "score": final})

        return score

    schema = "doc_id long, lang string, hits int, n int, semantic double, keyword double, pattern double, class_score double, quality_score double, score double, query_id long"
    return searched(docs.select("doc_id", "lang", "same", "n_chars", "quality", "terms"), query_terms(spark, sf_dir) if queries is None else queries, k, schema, "doc_id", one_block)


def graded(matches: DataFrame) -> DataFrame:
    """Grade of each query's matches: good (two strong ones), weak (any of WEAK or more) or bad."""
    strong = (F.col("score") >= STRONG) & (F.col("class_score") > 0) & (F.col("hits") >= 2)
    top = F.array_sort(F.collect_list(F.when(strong, -F.col("score"))))
    found = matches.groupBy("query_id").agg(F.count_if(strong).alias("strong"), F.max(F.when(F.col("score") >= WEAK, F.col("score"))).alias("weak"), top.alias("top"))
    mean = F.least(F.lit(1.0), -F.aggregate(F.slice("top", 1, 3), F.lit(0.0), lambda s, x: s + x) / 3)
    return found.select("query_id", "strong", F.when(F.col("strong") >= 2, "good").when(F.col("weak").isNotNull(), "weak").otherwise("bad").alias("grade"), F.round(F.when(F.col("strong") >= 2, mean).when(F.col("weak").isNotNull(), F.col("weak")).otherwise(0.05), 4).alias("grade_score"))


def critiqued(matches: DataFrame) -> DataFrame:
    """Whether a match may be cited, and what speaks against it."""
    same, overlap = F.col("class_score") > 0, F.col("hits") >= 2
    against = F.array_compact(F.array(F.when(~same, F.concat(F.lit("class differs: "), F.col("lang"))), F.when(~overlap, F.lit("no term overlap")), F.when(F.col("score") < CITED, F.lit("score below citation"))))
    return matches.select("query_id", "doc_id", "rank", "score", (same & overlap & (F.col("score") >= CITED)).alias("safe"), F.array_join(against, "; ").alias("differences"))


def metrics(labelled: DataFrame, k: int = 10) -> DataFrame:
    """precision at 5, reciprocal rank, nDCG of each query of (query_id, rank, label)."""
    gain = F.col("label") / F.log2(F.col("rank") + 1)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"), "rank"))
    rows = labelled.where(F.col("rank") <= k).withColumn("gain", gain).withColumn("best", F.col("label") / F.log2(ideal + 1))
    agg = rows.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= 5, F.col("label"))).alias("top5"), F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first"), F.sum("gain").alias("dcg"), F.sum("best").alias("ideal"))
    return agg.select("query_id", (F.col("top5") / 5).alias("precision5"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 6).alias("ndcg"))


def q_multi_view_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_replace(F.substring("text", 1, 1200), r"\s+", " ").alias("t"))
    views = F.array(*(F.struct(F.lit(n).alias("view"), F.concat_ws(" ", *parts).alias("body")) for n, parts in (("summary", ["source", "t"]), ("root_cause", ["lang", F.substring("t", 1, 1000)]), ("impact", [F.substring("t", 1, 900)]), ("recommendation", ["source", "lang"]), ("precondition", [F.substring("t", 1, 100), "lang"]))))
    return docs.select("doc_id", F.explode(views).alias("v")).select("doc_id", "v.view", F.md5("v.body").alias("body_md5"))


def q_class_derivation(spark, sf_dir):
    low = F.lower("text")
    kind = F.when(low.contains("license"), "licensing").when(low.rlike("token|password"), "secret").when(low.rlike(r"[^\s@]+@[a-z0-9]+[.]"), "contact").when(low.contains(" | "), "table").otherwise("prose")
    return read(spark, sf_dir, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


def q_lexical_topk(spark, sf_dir):
    return lexical_top_k(corpus_terms(spark, sf_dir), query_terms(spark, sf_dir), 5)


def q_hybrid_rank(spark, sf_dir):
    return scored_matches(spark, sf_dir).select("query_id", "doc_id", "hits", "score", "rank")


def q_retrieval_grade(spark, sf_dir):
    return graded(scored_matches(spark, sf_dir))


def q_critique_safe(spark, sf_dir):
    return critiqued(scored_matches(spark, sf_dir)).select("query_id", "doc_id", "safe", "differences")


def q_rag_bundle(spark, sf_dir):
    found = critiqued(scored_matches(spark, sf_dir))
    safe = F.array_sort(F.collect_list(F.when(F.col("safe"), F.struct("rank", "doc_id"))))
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("safe").alias("n_safe"), F.array_join(F.transform(F.slice(safe, 1, 3), lambda x: x["doc_id"].cast("string")), ",").alias("safe_docs"))


def q_repair_choose_better(spark, sf_dir):
    """A second search by the repaired query, the terms of the class added, for eight matches; its grade counts where the first is weak or bad and it scores no less."""
    asked = materialise(query_terms(spark, sf_dir), "item-queries")
    first = graded(scored_matches(spark, sf_dir, 5, asked))
    weak = materialise(first.where("grade != 'good'").select("query_id"), "weak-queries")
    second = graded(scored_matches(spark, sf_dir, 8, canonical_terms(join_checked(asked, weak, "query_id", "left_semi"))))
    joined = first.join(second.select("query_id", F.col("grade").alias("grade2"), F.col("grade_score").alias("score2")), "query_id", "left")
    better = F.coalesce(F.col("score2") >= F.col("grade_score"), F.lit(False))
    return joined.select("query_id", F.when(better, F.col("grade2")).otherwise(F.col("grade")).alias("grade"), F.when(better, F.col("score2")).otherwise(F.col("grade_score")).alias("grade_score"), better.alias("repaired"))


def mode_metrics(matches: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: means over all ``queries`` of the measures of their ten best ``matches``.

    ``relevant`` (query_id, doc_id) are the given documents of a query; one without any counts matches of its class, and then reaches a recall
    of 1 by one of them.
    """
    given = relevant.groupBy("query_id").agg(F.count("*").alias("given"))
    rows = matches.join(relevant.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left").join(given, "query_id", "left")
    same = (F.col("class_score") > 0).cast("int")
    rows = rows.withColumn("label", F.when(F.col("given").isNotNull(), F.coalesce("hit", F.lit(0))).otherwise(same)).withColumn("safe", same * ((F.col("hits") >= 2) & (F.col("score") >= CITED)).cast("int"))
    upto = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("label"))), F.lit(0))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"), "rank"))
    rows = rows.withColumn("gain", F.col("label") / F.log2(F.col("rank") + 1)).withColumn("ideal", F.col("label") / F.log2(best + 1))
    total = F.coalesce(F.max("given"), F.lit(1))
    each = rows.groupBy("query_id").agg(
        F.least(F.lit(1.0), upto(5) / total).alias("recall5"), F.least(F.lit(1.0), upto(10) / total).alias("recall10"), (upto(5) / 5).alias("precision5"), (upto(10) / 10).alias("precision10"),
        F.coalesce(1 / F.min(F.when(F.col("label") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr10"), F.coalesce(F.try_divide(F.sum("gain"), F.sum("ideal")), F.lit(0.0)).alias("ndcg10"),
        F.avg(same).alias("class_rate"), F.avg("safe").alias("safe_rate"), F.max("score").alias("top_score"),
    )
    measures = [c for c in each.columns if c != "query_id"]
    every = queries.select("query_id").join(each, "query_id", "left").fillna(0.0, measures)
    strict = relevant.agg((F.count("*") > 0).alias("strict"))
    return every.agg(*(F.round(F.avg(c), 4).alias(c) for c in measures), F.count("*").alias("queries")).crossJoin(strict)  # one row by one row


def q_query_modes(spark, sf_dir):
    """Measures of searches by the items' own terms and by their canonical queries; relevant are the documents that hold an item whole."""
    from lodeline.operators.containment import q_containment

    asked = materialise(query_terms(spark, sf_dir), "item-queries")
    relevant = materialise(q_containment(spark, sf_dir).where("holds = 'row'").select(F.col("item_id").alias("query_id"), "doc_id"), "relevant")
    raw = mode_metrics(scored_matches(spark, sf_dir, 10, asked), relevant, asked).withColumn("mode", F.lit("raw_query"))
    canonical = mode_metrics(scored_matches(spark, sf_dir, 10, canonical_terms(asked)), relevant, asked).withColumn("mode", F.lit("canonical_query"))
    return raw.unionByName(canonical)


def q_two_tier_retrieval(spark, sf_dir):
    """Labelled documents first, the rest only fills up."""
    labels = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("tier", F.lit(0))
    found = scored_matches(spark, sf_dir, 10).join(labels, "doc_id", "left").withColumn("tier", F.coalesce("tier", F.lit(1)))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank"))).where("place <= 5").select("query_id", "doc_id", "tier", "place")


def q_merge_best(spark, sf_dir):
    """Best score of each document over all items, the ten best."""
    best = scored_matches(spark, sf_dir).groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("items"))
    return best.orderBy(F.desc("score"), "doc_id").limit(10)


def q_vector_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return vector_top_k(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows, 10)


def _labelled(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = q_vector_topk(spark, sf_dir).join(rows.select("vec_id", F.col("label").alias("l")), "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return found.withColumn("label", (F.col("l") == F.col("ql")).cast("int"))


def q_retrieval_metrics(spark, sf_dir):
    return metrics(_labelled(spark, sf_dir))


def q_mode_eval(spark, sf_dir):
    """Mean metrics over two depths of search, and the balanced score."""
    found = materialise(_labelled(spark, sf_dir).select("query_id", "rank", "label"), "labelled")
    both = metrics(found, 10).withColumn("mode", F.lit("k10")).unionByName(metrics(found, 5).withColumn("mode", F.lit("k5")))
    means = both.groupBy("mode").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("precision5", "mrr", "ndcg")))
    return means.withColumn("balanced", F.round(F.greatest(F.lit(0.0), 0.45 * F.col("ndcg") + 0.25 * F.col("mrr") + 0.2 * F.col("precision5")), 4))


def q_recall_funnel(spark, sf_dir):
    """Items by length band: found by a long word, quoted whole, and how far the quoting documents came.

    A document that quotes an item has all its long words but two (its ends may be cut), so one of any three: pairs come
    from each item's three rarest words only.
    """
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    long = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z]{8,})"), 1))
    wanted = materialise(items.select(F.col("item_id").alias("query_id"), F.lower("text").alias("item"), F.length("text").alias("size"), long("text").alias("terms")), "items")
    words = wanted.select("query_id", F.explode("terms").alias("term"))
    held = docs.select("doc_id", F.explode(long("text")).alias("term"))
    frequency = materialise(join_checked(held, materialise(words.select("term").distinct(), "item-terms"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), "item-term-frequencies")
    known = words.join(frequency, "term")
    rarest = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    keys = materialise(known.withColumn("nth", rarest).where("nth <= 3").select("term", "query_id"), "item-keys")
    pairs = join_checked(held, keys, "term").select("query_id", "doc_id").distinct()
    near = pairs.join(wanted.select("query_id", "item"), "query_id").join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    stage = F.when(F.col("quality").isNull(), 0).when(F.col("quality") == 0, 1).otherwise(2)
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    quoted = near.where(F.contains("low", "item")).join(labels, "doc_id", "left").groupBy("query_id").agg(F.max(stage).alias("stage"))
    state = wanted.select("query_id", "size").join(known.select("query_id").distinct().withColumn("touched", F.lit(1)), "query_id", "left").join(quoted, "query_id", "left")
    band = F.when(F.col("size") < 175, "low").when(F.col("size") < 300, "medium").otherwise("high")
    return state.groupBy(band.alias("severity")).agg(F.count("*").alias("total"), F.count("touched").alias("touched"), F.count_if(F.col("stage") >= 0).alias("candidate"), F.count_if(F.col("stage") >= 1).alias("reviewed"), F.count_if(F.col("stage") >= 2).alias("delivered"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}

_ITEM_TERMS = _with_aliases(f"(SELECT item_id AS doc_id, NULL AS lang, {_TERMS} AS t FROM benchmark)")
_GROUPS = "[" + ", ".join(_list(g) for g in PATTERNS) + "]"
_SCORED = f"""d AS (SELECT t.doc_id, t.lang, t.t, x.n_chars, (SELECT max(quality) FROM labels l WHERE l.doc_id = t.doc_id) AS quality
  FROM {_with_aliases(f"(SELECT doc_id, lang, {_TERMS} AS t FROM documents)")} t JOIN documents x ON x.doc_id = t.doc_id),
i0 AS (SELECT doc_id AS query_id, t, len(t) AS n, [{', '.join(f"len(list_intersect(t, {_list(w)}))" for w in DOMAINS.values())}] AS h FROM {_ITEM_TERMS}),
i AS (SELECT query_id, t, n, CASE WHEN list_max(h) = 0 THEN 'un' ELSE substring({_list(DOMAINS)}[list_position(h, list_max(h))], 1, 2) END AS class FROM i0),
p AS (SELECT query_id, doc_id, class, lang, n, n_chars, quality, len(list_intersect(i.t, d.t)) AS hits,
        list_max(list_transform({_GROUPS}, lambda g: CASE WHEN list_has_any(i.t, g) THEN len(list_intersect(d.t, g)) / CAST(len(g) AS DOUBLE) ELSE 0.0 END)) AS pattern
      FROM i, d WHERE list_has_any(i.t, d.t)),
s AS (SELECT *, CASE WHEN class = CASE lang WHEN 'de' THEN 'ge' WHEN 'es' THEN 'sp' ELSE lang END THEN 0.55 ELSE 0.0 END AS class_score,
        least(1.0, hits / CAST(greatest(5, n) AS DOUBLE) + CASE WHEN n_chars > 1000 THEN 0.15 ELSE 0.0 END) AS semantic, least(1.0, hits / CAST(greatest(4, n) AS DOUBLE)) AS keyword,
        least(1.0, coalesce(quality, 0) * 0.8 + CASE WHEN quality = 1 THEN 0.15 ELSE 0.03 END) AS quality_score FROM p),
f AS (SELECT *, round(CAST(0.30 AS DOUBLE) * semantic + CAST(0.25 AS DOUBLE) * keyword + CAST(0.25 AS DOUBLE) * pattern + CAST(0.10 AS DOUBLE) * class_score + CAST(0.10 AS DOUBLE) * quality_score, 6) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"""


_I = _SCORED[_SCORED.index("i AS (") : _SCORED.index("p AS (")]
_CLASS_WORDS = "CASE class " + " ".join(f"WHEN '{n[:2]}' THEN {_list(w)}" for n, w in DOMAINS.items()) + " ELSE [] END"
#: The same for canonical queries.
_CANONICAL = _SCORED.replace(_I, _I.replace("i AS (", "raw AS (", 1) + f"""i AS (SELECT query_id, t, len(t) AS n, class FROM (SELECT query_id, list_distinct(list_concat(t, {_CLASS_WORDS})) AS t, class FROM raw)),
""")


def _grades(most: int, name: str) -> str:
    return f"""{name}0 AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.30 AND class_score > 0 AND hits >= 2) AS strong, max(score) FILTER (WHERE score >= 0.18) AS weak,
  list_slice(list_sort(list(score) FILTER (WHERE score >= 0.30 AND class_score > 0 AND hits >= 2), 'DESC'), 1, 3) AS top FROM r WHERE rank <= {most} GROUP BY 1),
{name} AS (SELECT query_id, strong, CASE WHEN strong >= 2 THEN 'good' WHEN weak IS NOT NULL THEN 'weak' ELSE 'bad' END AS grade,
  round(CASE WHEN strong >= 2 THEN least(1.0, list_sum(top) / 3) WHEN weak IS NOT NULL THEN weak ELSE 0.05 END, 4) AS grade_score FROM {name}0)"""


_SAFE = "(class_score > 0 AND hits >= 2 AND score >= 0.25)"
_VECTORS = """v AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label AS l, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v) WHERE rank <= 10)"""


def _metrics(k: int, name: str) -> str:
    return f"""{name}0 AS (SELECT query_id, rank, CAST(l = ql AS INT) AS label, row_number() OVER (PARTITION BY query_id ORDER BY CAST(l = ql AS INT) DESC, rank) AS b FROM k WHERE rank <= {k}),
{name} AS (SELECT query_id, sum(label) FILTER (WHERE rank <= 5) / 5.0 AS precision5, coalesce(1.0 / min(rank) FILTER (WHERE label = 1), 0.0) AS mrr,
  round(coalesce(sum(label / log2(rank + 1)) / nullif(sum(label / log2(b + 1)), 0), 0.0), 6) AS ndcg FROM {name}0 GROUP BY 1)"""


ORACLE = {
    "multi_view_docs": """WITH t AS (SELECT doc_id, lang, source, regexp_replace(substring(text, 1, 1200), '\\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, view, md5(body) AS body_md5 FROM (SELECT doc_id, unnest(['summary','root_cause','impact','recommendation','precondition']) AS view,
unnest([concat_ws(' ', source, t), concat_ws(' ', lang, substring(t, 1, 1000)), substring(t, 1, 900), concat_ws(' ', source, lang), concat_ws(' ', substring(t, 1, 100), lang)]) AS body FROM t)""",
    "class_derivation": """SELECT CASE WHEN contains(lower(text), 'license') THEN 'licensing' WHEN regexp_matches(lower(text), 'token|password') THEN 'secret' WHEN regexp_matches(lower(text), '[^\\s@]+@[a-z0-9]+[.]') THEN 'contact'
WHEN contains(lower(text), ' | ') THEN 'table' ELSE 'prose' END AS class, count(*) AS n, sum(n_chars) AS n_chars, min(doc_id) AS first_doc FROM documents GROUP BY 1""",
    "lexical_topk": f"""WITH {_SCORED}, x AS (SELECT query_id, doc_id, round(keyword, 6) AS score FROM f)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 5""",
    "hybrid_rank": f"WITH {_SCORED} SELECT query_id, doc_id, hits, score, rank FROM r WHERE rank <= 5",
    "retrieval_grade": f"WITH {_SCORED}, {_grades(5, 'g')} SELECT * FROM g",
    "critique_safe": f"""WITH {_SCORED} SELECT query_id, doc_id, {_SAFE} AS safe, array_to_string(list_filter([CASE WHEN class_score = 0 THEN 'class differs: ' || lang END, CASE WHEN hits < 2 THEN 'no term overlap' END,
CASE WHEN score < 0.25 THEN 'score below citation' END], lambda x: x IS NOT NULL), '; ') AS differences FROM r WHERE rank <= 5""",
    "rag_bundle": f"""WITH {_SCORED} SELECT query_id, count(*) AS n, count(*) FILTER (WHERE {_SAFE}) AS n_safe, coalesce(array_to_string(list_slice(list(doc_id ORDER BY rank) FILTER (WHERE {_SAFE}), 1, 3), ','), '') AS safe_docs FROM r WHERE rank <= 5 GROUP BY 1""",
    "repair_choose_better": f"""WITH r AS (WITH {_SCORED} SELECT * FROM r), {_grades(5, 'g')}, r2 AS (WITH {_CANONICAL} SELECT * FROM r WHERE rank <= 8), {_grades(8, 'h').replace("FROM r WHERE", "FROM r2 WHERE")}
SELECT query_id, CASE WHEN better THEN g2 ELSE g1 END AS grade, CASE WHEN better THEN s2 ELSE s1 END AS grade_score, better AS repaired
FROM (SELECT g.query_id, g.grade AS g1, h.grade AS g2, g.grade_score AS s1, h.grade_score AS s2, g.grade <> 'good' AND coalesce(h.grade_score >= g.grade_score, false) AS better FROM g LEFT JOIN h USING (query_id))""",
    "query_modes": f"""WITH m AS (SELECT 'raw_query' AS mode, * FROM (WITH {_SCORED} SELECT query_id, doc_id, hits, score, class_score, rank FROM r WHERE rank <= 10)
  UNION ALL SELECT 'canonical_query', * FROM (WITH {_CANONICAL} SELECT query_id, doc_id, hits, score, class_score, rank FROM r WHERE rank <= 10)),
rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(lower(d.text), lower(b.text))),
g AS (SELECT query_id, count(*) AS given FROM rel GROUP BY 1),
l AS (SELECT m.*, given, CAST(CASE WHEN given IS NOT NULL THEN rel.doc_id IS NOT NULL ELSE class_score > 0 END AS INT) AS label, CAST({_SAFE} AS INT) AS safe FROM m LEFT JOIN rel ON rel.query_id = m.query_id AND rel.doc_id = m.doc_id LEFT JOIN g ON g.query_id = m.query_id),
x AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY label DESC, rank) AS best FROM l),
e AS (SELECT mode, query_id, least(1.0, coalesce(sum(label) FILTER (WHERE rank <= 5), 0) / CAST(coalesce(max(given), 1) AS DOUBLE)) AS recall5, least(1.0, sum(label) / CAST(coalesce(max(given), 1) AS DOUBLE)) AS recall10, coalesce(sum(label) FILTER (WHERE rank <= 5), 0) / CAST(5 AS DOUBLE) AS precision5, sum(label) / CAST(10 AS DOUBLE) AS precision10,
  coalesce(1 / CAST(min(rank) FILTER (WHERE label = 1) AS DOUBLE), 0.0) AS mrr10, coalesce(sum(label / log2(rank + 1)) / nullif(sum(label / log2(best + 1)), 0), 0.0) AS ndcg10, avg(CAST(class_score > 0 AS INT)) AS class_rate, avg(safe) AS safe_rate, max(score) AS top_score FROM x GROUP BY ALL),
n AS (SELECT count(*) AS queries FROM benchmark)
SELECT mode, {", ".join(f"round(sum({c}) / max(queries), 4) AS {c}" for c in ("recall5", "recall10", "precision5", "precision10", "mrr10", "ndcg10", "class_rate", "safe_rate", "top_score"))}, max(queries) AS queries, (SELECT count(*) > 0 FROM rel) AS strict FROM e CROSS JOIN n GROUP BY mode""",
    "two_tier_retrieval": f"""WITH {_SCORED}, t AS (SELECT query_id, doc_id, rank, CAST(doc_id NOT IN (SELECT doc_id FROM labels) AS INT) AS tier FROM r WHERE rank <= 10)
SELECT * FROM (SELECT query_id, doc_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS place FROM t) WHERE place <= 5""",
    "merge_best": f"WITH {_SCORED} SELECT doc_id, max(score) AS score, count(*) AS items FROM r WHERE rank <= 5 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10",
    "vector_topk": f"WITH {_VECTORS} SELECT query_id, vec_id, score, rank FROM k",
    "retrieval_metrics": f"WITH {_VECTORS}, {_metrics(10, 'm')} SELECT * FROM m",
    "mode_eval": f"""WITH {_VECTORS}, {_metrics(10, 'a')}, {_metrics(5, 'b')}, u AS (SELECT 'k10' AS mode, * FROM a UNION ALL SELECT 'k5' AS mode, * FROM b),
w AS (SELECT mode, round(avg(precision5), 4) AS precision5, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM u GROUP BY 1)
SELECT *, round(greatest(0.0, 0.45 * ndcg + 0.25 * mrr + 0.2 * precision5), 4) AS balanced FROM w""",
    "recall_funnel": """WITH d AS (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS t, (SELECT max(quality) FROM labels l WHERE l.doc_id = documents.doc_id) AS quality FROM documents),
i AS (SELECT item_id, lower(text) AS item, length(text) AS size, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS t FROM benchmark),
p AS (SELECT item_id, bool_or(list_has_any(i.t, d.t)) AS touched, max(CASE WHEN list_has_any(i.t, d.t) AND contains(low, item) THEN CASE WHEN quality IS NULL THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END END) AS stage FROM i, d GROUP BY 1)
SELECT CASE WHEN size < 175 THEN 'low' WHEN size < 300 THEN 'medium' ELSE 'high' END AS severity, count(*) AS total, count(*) FILTER (WHERE touched) AS touched, count(*) FILTER (WHERE stage >= 0) AS candidate,
count(*) FILTER (WHERE stage >= 1) AS reviewed, count(*) FILTER (WHERE stage >= 2) AS delivered FROM i JOIN p USING (item_id) GROUP BY 1""",
}
