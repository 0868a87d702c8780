"""Language identification by bit-sliced Bloom filters over character n-grams.

Every cell of the filter has one bit a language, in 64-bit words, so one lookup (the AND of the n-gram's
cells) returns the languages that hold the n-gram, all at once. A document's popcount for a language is the
number of its n-grams with that bit. A language whose slice is filled to f answers "yes" to a foreign
n-gram with probability p = f ** hashes; the corrected count is (popcount - p * n) / (1 - p). The language
of the greatest corrected count wins; its share of the n-grams is the score.

Training reads text and lang only: documents whose crc32(doc_id) mod 4 is not 2, at most SAMPLE_A_LANGUAGE of
each language by a hash of the id. A language contains an n-gram if it has it at LEAST_SHARE or more of the rate of the
language that has it most, so words that a document quotes from another language are not its own. Spark ORs the bits of
each cell; the driver receives cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.llm.chunks import code_points, indexed_words, text_chunks
from lodeline.plans.shared import bound_batches, discard, join_checked, materialise

NGRAM = 4
SAMPLE_A_LANGUAGE = 3000
LEAST_SHARE = 0.05
HASHES = 3
#: Languages a word of a cell holds.
WORD_BITS = 64
#: Cells (a power of two) of up to MODEL_BYTES together; beyond (512 languages), they are halved until they fit.
CELLS, MODEL_BYTES = 1 << 20, 64 << 20
UNDETERMINED = "und"
#: Documents whose score is below are rejected by ``accepted``.
REJECT_BELOW = 0.05

_LETTERS = re.compile(r"[^\W\d_]+").findall


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def ngram_hashes(words: list[str], size: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between its two boundaries, and the word each is of.

    A shorter word's n-gram reaches over its end into the next word; it is cut there, so that it has the word alone.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points, owner = code_points(words)
    points = np.concatenate([points, np.full(size, 32, np.uint64)])
    n = len(owner) - 1  # the last space begins nothing
    begins = np.where(points[:n] == 32, np.append(0, owner[1:n] + 1) if n > 1 else 0, owner[:n])  # a space begins the next word
    ended = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for j in range(size):
            here = points[j : j + n]
            rolled = np.where(ended, rolled, rolled * np.uint64(0x100000001B3) + here + np.uint64(1))
            if j:
                ended |= here == 32
        # of a word's n-grams, those that were cut before their full size repeat its end; only a short word keeps one
        lengths = np.zeros(n, np.int64)
        stop = np.zeros(n, bool)
        for j in range(size):
            lengths += ~stop
            if j:
                stop |= points[j : j + n] == 32
        keep = (lengths == size) | (points[:n] == 32)
        return _mixed(rolled[keep]), begins[keep]


def letter_words(text: str) -> list[str]:
    """Runs of letters of a text, in lower case; none if there is no letter."""
    words = _LETTERS(text.lower())
    if words and not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
        return []
    return words


def held_out() -> Column:
    """The documents that no language may learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, per_language: int = SAMPLE_A_LANGUAGE) -> DataFrame:
    """lang, text of the bounded sample.

    The hash threshold that leaves about ``per_language`` documents comes from the languages' counts, so
    the ranking within a language touches only a little more than the sample.
    """
    usable = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    drawn = usable.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"), F.xxhash64("text").alias("text"))
    languages = materialise(drawn.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    near = join_checked(drawn, languages, "lang").where(F.col("draw") * F.col("n") <= F.lit(1.5 * per_language * (1 << 30)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    ids = near.select("lang", "doc_id", "draw", "text").withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = materialise(ids.select("lang", "doc_id").distinct(), "language-sample")
    return join_checked(usable.select("lang", "doc_id", "text"), chosen, ["lang", "doc_id"], "left_semi").select("lang", "text")


def _counted(rows: DataFrame) -> DataFrame:
    """lang, h, n: occurrences of n-grams; each task sums its own before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for chunk in text_chunks(texts):
                    numbers, words = indexed_words(chunk, letter_words)
                    seen = np.bincount(np.concatenate(numbers), minlength=len(words))
                    h, word = ngram_hashes(words)
                    grams, place = np.unique(h, return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "h": grams.view(np.int64), "n": np.bincount(place, seen[word], len(grams)).astype(np.int64)})

    return rows.mapInPandas(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def cells_for(languages: int) -> int:
    """Cells of a filter of so many languages."""
    cells = CELLS
    while cells * 8 * -(-languages // WORD_BITS) > MODEL_BYTES and cells > 1:
        cells //= 2
    return cells


class LanguageFilters:
    """The bit-sliced filter: words by (word, cell), the languages of the bits, and each slice's false-positive rate."""

    def __init__(self, languages: list[str], cells: np.ndarray, hashes: int = HASHES):
        self.languages, self.cells, self.hashes = languages, cells, hashes
        filled = np.array([np.count_nonzero(self._slice(cells, i)) for i in range(len(languages))], float) / cells.shape[1]
        self.false_rate = np.minimum(filled**hashes, 0.999)

    @staticmethod
    def _slice(words: np.ndarray, language: int) -> np.ndarray:
        word, bit = divmod(language, WORD_BITS)
        return (words[word] >> np.uint64(bit)) & np.uint64(1)

    @classmethod
    def empty(cls, languages: list[str]) -> LanguageFilters:
        return cls(languages, np.zeros((max(1, -(-len(languages) // WORD_BITS)), cells_for(len(languages))), np.uint64))

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for j in range(self.hashes):
            yield ((first + np.uint64(j) * step) & np.uint64(self.cells.shape[1] - 1)).astype(np.int64)

    def insert(self, h: np.ndarray, language: int) -> None:
        word, bit = divmod(language, WORD_BITS)
        for place in self.places(h):
            self.cells[word, place] |= np.uint64(1 << bit)

    def holders(self, h: np.ndarray) -> np.ndarray:
        """(word, hash): the bits of all languages that hold each hash."""
        found = np.full((len(self.cells), len(h)), np.uint64((1 << 64) - 1))
        for place in self.places(h):
            found &= self.cells[:, place]
        return found

    def popcounts(self, words: list[str]) -> np.ndarray:
        """A row a word: its n-grams by language, then their number."""
        h, word = ngram_hashes(words)
        bits = self.holders(h)
        one = [np.bincount(word, self._slice(bits, i), len(words)) for i in range(len(self.languages))]
        return np.stack([*one, np.bincount(word, minlength=len(words))], axis=1)

    def judge(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        """The language of each text and the share of its n-grams that remain after correction."""
        numbers, words = indexed_words(texts, letter_words)
        table, p = self.popcounts(words), self.false_rate
        for own in numbers:
            if not len(own) or not self.languages:
                yield UNDETERMINED, 0.0
                continue
            total = table[own].sum(axis=0)
            corrected = np.maximum(total[:-1] - p * total[-1], 0.0) / (1 - p)
            best = int(corrected.argmax())
            yield self.languages[best], float(min(1.0, corrected[best] / total[-1]))


def entering_ngrams(counts: DataFrame) -> DataFrame:
    """lang, h of the n-grams that a language contains, from (lang, h, n)."""
    rated = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    return rated.join(rated.groupBy("h").agg(F.max("rate").alias("top")), "h").where(F.col("rate") >= LEAST_SHARE * F.col("top")).select("lang", "h")


def filled_cells(entering: DataFrame, languages: list[str], filters: LanguageFilters) -> DataFrame:
    """word, place, bits: the cells of an empty filter after all n-grams are in; at most one row a cell."""
    numbers = entering.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    first, step = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1))
    places = F.array(*((first + j * step).bitwiseAND(F.lit(filters.cells.shape[1] - 1)) for j in range(filters.hashes)))
    bits = F.expr(f"shiftleft(1L, number % {WORD_BITS})")
    spread = entering.join(numbers, "lang").select((F.col("number") / WORD_BITS).cast("int").alias("word"), F.explode(places).alias("place"), bits.alias("bits"))
    return spread.groupBy("word", "place").agg(F.bit_or("bits").alias("bits"))


def train(docs: DataFrame) -> LanguageFilters:
    """Filters of the bounded sample; the driver receives the languages and the filled cells."""
    bound_batches(docs.sparkSession)
    counts = materialise(_counted(training_rows(docs)), "language-ngrams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    filters = LanguageFilters.empty(languages)
    found = filled_cells(entering_ngrams(counts), languages, filters).toPandas()
    filters.cells[found["word"].to_numpy(np.int64), found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    discard(counts)
    return LanguageFilters(languages, filters.cells)


def judged(spark: SparkSession, filters: LanguageFilters):
    """A Pandas UDF: text -> (lang_pred, score)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((filters.languages, filters.cells))  # MODEL_BYTES at most

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = LanguageFilters(*shared.value)
        for batch in batches:
            found = [x for chunk in text_chunks(batch) for x in model.judge(chunk)]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return judge


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is everything if no language was learned.
    Repeated rows are judged alike; further columns are not read; a null doc_id is not held out.
    """
    judge = judged(docs.sparkSession, filters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), judge("text").alias("judged"))
    return rows.select("doc_id", "held_out", "judged.lang_pred", "judged.score")


def accepted(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """The rows of ``docs``, as they are, that have a language: those with letters, of score REJECT_BELOW or more."""
    return docs.where(judged(docs.sparkSession, filters)(F.col("text"))["score"] >= REJECT_BELOW)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))


QUERIES = {"op7_language_id": op7_language_id}
#: No SQL: a trained model; tests measure held-out accuracy.
ORACLE: dict[str, str] = {}
