"""Joins of texts by containment, both ways, against a stated set of texts taken in blocks.

A block of the set is one automaton of all its texts, so one pass over a text finds every one that it holds. The other way
round, a text lies within one of the set if its first GRAM characters do, which an index of the block's grams tells; shorter
texts are looked up in indexes of grams of their own length. Nothing is compared that has no gram in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.retrieve import read
from lodeline.plans.shared import bound_batches, materialise

#: Characters of a gram of the index, and of the texts of a block, about.
GRAM, BLOCK_CHARS = 12, 4_000_000


class Block:
    """Texts of the stated set, as an automaton and as an index of grams; both grow with the block's characters only."""

    def __init__(self, names: list, texts: list[str]):
        import ahocorasick

        self.texts: dict[str, list] = {}
        for name, text in zip(names, texts, strict=True):
            self.texts.setdefault(text, []).append(name)
        self.automaton = ahocorasick.Automaton()
        for text in self.texts:
            self.automaton.add_word(text, text)
        self.automaton.make_automaton()
        self.grams: dict[int, dict[str, set[str]]] = {}

    def within(self, text: str) -> set[str]:
        """Texts of the block that this one holds."""
        return {found for _, found in self.automaton.iter(text)}

    def around(self, text: str) -> set[str]:
        """Texts of the block that hold this one."""
        size = min(len(text), GRAM)
        if size not in self.grams:
            index = self.grams[size] = {}
            for t in self.texts:
                for i in range(len(t) - size + 1):
                    index.setdefault(t[i : i + size], set()).add(t)
        return {t for t in self.grams[size].get(text[:size], ()) if text in t}


def contained(rows: DataFrame, given: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """name, id, holds: pairs of ``rows`` (id, text) and the stated set ``given`` (name, text) where one text holds the other.

    ``holds`` is 'row' if the row's text holds the given one, else 'given'; equal texts are a row that holds. Null and empty texts
    meet nothing; repeated rows and names come out each. The set is taken in blocks of about ``block_chars`` characters by a hash of
    the name, with a pass over the rows for each.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    given = materialise(given.where("text != ''").select("name", "text"), "containment-given")
    count = max(1, -(-(given.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    found = None
    kind = given.schema["name"].dataType.simpleString()
    for b in range(count):
        part = given.where(F.pmod(F.xxhash64("name"), F.lit(count)) == b).toPandas()
        if part.empty:
            continue
        names, texts = part["name"].tolist(), part["text"].tolist()

        def run(batches: Iterator[pd.DataFrame], names=names, texts=texts) -> Iterator[pd.DataFrame]:
            block = Block(names, texts)
            for batch in batches:
                out = []
                for i, text in zip(batch["id"], batch["text"], strict=True):
                    inner = block.within(text)
                    out += [(n, i, "row") for t in inner for n in block.texts[t]]
                    out += [(n, i, "given") for t in block.around(text) - inner for n in block.texts[t]]
                yield pd.DataFrame(out, columns=["name", "id", "holds"])

        pairs = rows.where("text != ''").select("id", "text").mapInPandas(run, f"name {kind}, id long, holds string")
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], f"name {kind}, id long, holds string")


def q_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents of which one holds the other, in lower case."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), F.lower("text").alias("text"))
    return contained(docs, items).select(F.col("name").alias("item_id"), F.col("id").alias("doc_id"), "holds")


def q_containment_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by length band: those that a document holds whole, those that hold a document, and the pairs of either kind."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.length("text") < 175, "short").when(F.length("text") < 300, "medium").otherwise("long").alias("band"))
    met = materialise(q_containment(spark, sf_dir), "containment-pairs")
    per_item = met.groupBy("item_id").agg(F.count_if(F.col("holds") == "row").alias("whole"), F.count_if(F.col("holds") == "given").alias("cut"))
    joined = items.join(per_item, "item_id", "left").fillna(0, ["whole", "cut"])
    return joined.groupBy("band").agg(F.count("*").alias("items"), F.count_if(F.col("whole") > 0).alias("items_whole"), F.count_if(F.col("cut") > 0).alias("items_cut"), F.sum("whole").alias("whole"), F.sum("cut").alias("cut"))


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}
_PAIRS = """p AS (SELECT item_id, doc_id, CASE WHEN contains(lower(d.text), lower(b.text)) THEN 'row' ELSE 'given' END AS holds FROM benchmark b JOIN documents d
  ON d.text <> '' AND b.text <> '' AND (contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text))))"""
ORACLE = {
    "containment": f"WITH {_PAIRS} SELECT * FROM p",
    "containment_recall": f"""WITH {_PAIRS}, i AS (SELECT item_id, CASE WHEN length(text) < 175 THEN 'short' WHEN length(text) < 300 THEN 'medium' ELSE 'long' END AS band FROM benchmark),
m AS (SELECT item_id, count(*) FILTER (WHERE holds = 'row') AS whole, count(*) FILTER (WHERE holds = 'given') AS cut FROM p GROUP BY 1)
SELECT band, count(*) AS items, count(*) FILTER (WHERE whole > 0) AS items_whole, count(*) FILTER (WHERE cut > 0) AS items_cut, CAST(coalesce(sum(whole), 0) AS BIGINT) AS whole, CAST(coalesce(sum(cut), 0) AS BIGINT) AS cut FROM i LEFT JOIN m USING (item_id) GROUP BY 1""",
}
