"""Toxicity: a counterfactual-regularised linear classifier.

A document's features are the selected character n-grams (and so words and stems) that occur anywhere in its
lower-cased words, found by one automaton pass over the whole text. Only those that speak for toxicity are
selected, with weights of 0 or more: the absence of ordinary words is no evidence. The loss is the class-balanced log loss of
the labelled sample, plus a penalty on what swapping an identity term does to the score: for every labelled
sentence that names a group, the term is swapped for others of its kind (a neutral word among them) and the
squared change of the logit is added. Terms the sample never names are swapped in carrier sentences, so a group
has no weight of its own whatever the sample holds. A held-back fifth of the sample then sets scale and offset so
that 0.7 is the threshold.

Training rows: labels.toxic of documents whose crc32(doc_id) mod 3 is not 1, at most SAMPLE_A_CLASS of each class
by a hash of the id. Only text enters a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.llm.chunks import text_chunks
from lodeline.plans.shared import bound_batches, join_checked, materialise

SAMPLE_A_CLASS = 3000
FEATURES = 1500
GRAM_SIZES = range(3, 9)
LEAST_DOCUMENTS = 4
THRESHOLD = 0.7
RIDGE = 2e-4
COUNTERFACTUAL = 1.0

#: Identity terms by kind; the first of a kind is neutral.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "mothers", "fathers"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("people", "gays", "lesbians", "straights", "transgender", "queer", "bisexuals"),
    ("people", "blacks", "whites", "asians", "latinos", "africans", "europeans", "arabs"),
    ("people", "immigrants", "refugees", "foreigners", "natives", "elderly", "disabled"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "schwule", "lesben", "ausländer", "flüchtlinge"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "gays", "lesbiennes", "étrangers", "réfugiés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "gays", "lesbianas", "extranjeros", "refugiados"),
)
#: Sentences for terms that the sample never names.
CARRIERS = ("we met the {} in town", "many {} live here", "das sind {} aus der stadt", "ce sont des {} de la ville", "son {} de la ciudad")

_WORDS = re.compile(r"\w+").findall
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+").split


def normalised(text: str | None) -> str:
    """The lower-cased words of a text, each between single spaces."""
    return f" {' '.join(_WORDS((text or '').lower()))} "


def grams(text: str) -> set[str]:
    """All n-grams of a normalised text that lie within a word and its two spaces."""
    found = set()
    for word in set(text.split()):
        padded = f" {word} "
        for size in GRAM_SIZES:
            found.update(padded[i : i + size] for i in range(len(padded) - size + 1))
    return found


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """(sentence, sentence with another term of the same kind) for each identity term in a text."""
    out = []
    for sentence in _SENTENCES(text or ""):
        words = _WORDS(sentence.lower())
        for kind in IDENTITY_TERMS:
            for term in set(words).intersection(kind):
                swapped = kind[0] if term != kind[0] else kind[1 + len(words) % (len(kind) - 1)]
                out.append((f" {' '.join(words)} ", f" {' '.join(swapped if w == term else w for w in words)} "))
    return out


def held_out() -> Column:
    """The documents whose labels are never learned."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_A_CLASS) -> DataFrame:
    """doc_id, toxic, text of the bounded sample. Conflicting labels of a document count as toxic."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = usable.groupBy("toxic").agg(F.count("*").alias("n"))
    near = usable.join(F.broadcast(sizes), "toxic").where(F.col("draw") * F.col("n") <= F.lit(1.5 * per_class * (1 << 30)))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "doc_id")))
    chosen = materialise(ranked.where(F.col("rank") <= per_class).select("doc_id", "toxic"), "toxic-sample")
    return join_checked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen, "doc_id").select("doc_id", "toxic", "text")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """gram, toxic and other documents that hold it; each task sums its own first."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for toxic, text in zip(part["toxic"], part["text"], strict=True):
                    seen[toxic].update(grams(normalised(text)))
                names = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"gram": names, "other": [seen[0][x] for x in names], "toxic": [seen[1][x] for x in names]})

    return sample.mapInPandas(run, "gram string, other long, toxic long").groupBy("gram").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


class Presence:
    """Which of the selected n-grams a normalised text holds."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.automaton.add_word(name, i)
        if names:
            self.automaton.make_automaton()
        self.size = len(names)

    def of(self, text: str) -> list[int]:
        return sorted({i for _, i in self.automaton.iter(text)}) if self.size else []

    def matrix(self, texts: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, found in zip(out, texts, strict=True):
            row[found] = 1
        return out

    def change(self, before: str, after: str) -> list[tuple[int, int]]:
        """(n-gram, +1 or -1) of those that only one of two texts holds."""
        old, new = set(self.of(before)), set(self.of(after))
        return sorted([(i, 1) for i in new - old] + [(i, -1) for i in old - new])


def swap_products(sample: DataFrame, names: list[str]) -> DataFrame:
    """i, j, total: sums of the products of two n-grams' changes over every swap of every labelled sentence.

    With them the penalty, the mean squared change of the logit, is a quadratic form of the weights, so no swap leaves
    its task. The row (-1, -1) holds the number of swaps that change anything. At most FEATURES ** 2 + 1 rows.
    """

    def run(batches: Iterator) -> Iterator:
        presence = Presence(names)
        for batch in batches:
            sums: Counter = Counter()
            for text in batch["text"]:
                for swap, times in Counter(counterfactuals(text)).items():
                    change = presence.change(*swap)
                    sums[-1, -1] += times * bool(change)
                    for i, a in change:
                        for j, b in change:
                            sums[i, j] += times * a * b
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["i", "j", "total"])

    return sample.mapInPandas(run, "i int, j int, total long").groupBy("i", "j").agg(F.sum("total").alias("total"))


def _fit(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated projected gradient on balanced log loss + ridge + the quadratic form ``swaps`` of the weights."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32)
    w, b, w_at, b_at = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    bound = 0.25 * float(weight @ (x**2).sum(axis=1) + weight.sum()) + 2 * RIDGE + 2 * COUNTERFACTUAL * float(np.trace(swaps))
    step = 1.0 / bound
    for k in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ w_at + b_at, -30, 30))) - y)
        g = x.T @ error + 2 * RIDGE * w_at + 2 * COUNTERFACTUAL * (swaps @ w_at)
        new, new_b = np.maximum(w_at - step * g, 0), b_at - step * float(error.sum())
        momentum = k / (k + 3)
        w_at, b_at = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    return w, b


class Classifier:
    """Selected n-grams, their weights and the offset of the logit."""

    def __init__(self, names: list[str], weights: np.ndarray, offset: float):
        self.names, self.weights, self.offset = names, weights, offset

    def scorer(self):
        presence = Presence(self.names)
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.weights[presence.of(normalised(text))].sum() + self.offset, -30, 30))))


def _calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset that put the best-separating threshold of held-back rows at THRESHOLD."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    order = np.argsort(logit)
    value, truth = logit[order], y[order]
    # errors when everything from i on is called toxic; a false alarm counts double
    errors = np.append(0, np.cumsum(truth)) + 2 * np.append(np.cumsum((1 - truth)[::-1])[::-1], 0)
    best = np.flatnonzero(errors == errors.min())
    cut = best[len(best) // 2]
    low, high = value[max(0, cut - 1)], value[min(len(value) - 1, cut)]
    spread = max(float(value[truth == 1].mean() - value[truth == 0].mean()), 1e-3)
    scale = 8.0 / spread
    return scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * (low + high) / 2)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of the bounded sample.

    The driver receives the feature numbers of its 2 * SAMPLE_A_CLASS rows and the sums of ``swap_products``, never texts.
    Without labels of both classes, or without tables' rows, it has no features and one score.
    """
    bound_batches(docs.sparkSession)
    sample = materialise(training_rows(docs, labels), "toxic-texts")
    counts = _feature_counts(sample)
    positive, total = sample.agg(F.sum("toxic"), F.count("*")).first()
    positive, negative = float(positive or 0), float((total or 0) - (positive or 0))
    if not positive or not negative:
        return Classifier([], np.zeros(0, np.float32), -4.0 if not positive else 4.0)
    p, q = (F.col("toxic") + 0.5) / (positive + 1), (F.col("other") + 0.5) / (negative + 1)
    pooled = (F.col("toxic") + F.col("other") + 1) / (positive + negative + 2)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / negative) + F.lit(1e-9))
    common = counts.where(F.col("toxic") + F.col("other") >= LEAST_DOCUMENTS)
    names = [r["gram"] for r in common.withColumn("z", z).where("z > 0").orderBy(F.desc("z"), "gram").limit(FEATURES).collect()]

    def run(batches: Iterator) -> Iterator:
        presence = Presence(names)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "found": [presence.of(normalised(t)) for t in batch["text"]]})

    presence = Presence(names)
    labelled = sample.mapInPandas(run, "doc_id long, toxic int, found array<int>").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    x, y = presence.matrix([list(v) for v in labelled["found"]]), labelled["toxic"].to_numpy(np.float32)
    products = swap_products(sample, names).toPandas()
    swaps, n = np.zeros((len(names), len(names)), np.float32), int(products["total"][products["i"] < 0].sum())
    products = products[products["i"] >= 0]
    swaps[products["i"], products["j"]] = products["total"]
    for term, neutral in ((t, kind[0]) for kind in IDENTITY_TERMS for t in kind[1:]):
        for carrier in CARRIERS:
            change = presence.change(f" {carrier.format(term)} ", f" {carrier.format(neutral)} ")
            n += bool(change)
            at = [i for i, _ in change]
            swaps[np.ix_(at, at)] += np.outer([v for _, v in change], [v for _, v in change])
    back = np.arange(len(y)) % 5 == 4
    w, b = _fit(x[~back], y[~back], swaps / max(1, n))
    scale, offset = _calibrated(x[back] @ w + b, y[back])
    return Classifier(names, w * np.float32(scale), b * scale + offset)


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its text alone.

    Null and empty texts get the score of a text without features. Repeated rows score alike; further columns are
    not read; a null doc_id is not held out.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.offset))  # FEATURES entries

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Classifier(*shared.value).scorer()
        for batch in batches:
            yield pd.Series([of(text) for chunk in text_chunks(batch) for text in chunk], dtype=float)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_toxicity": op6_toxicity}
#: No SQL: a trained model; tests measure held-out accuracy.
ORACLE: dict[str, str] = {}
