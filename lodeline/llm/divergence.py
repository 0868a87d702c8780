"""Divergence of each source from the other sources of its language, and of its terms from the language.

1. Single-pass in-memory indexing: a task counts the terms of its documents, by language and source, in a block. When
   the block has counted BLOCK_TERMS terms it leaves as a run in the order of its terms, and the next one begins. So
   a term leaves a task once a block and source, however frequent it is.
2. Runs are dealt into shards by the hash of term and language, and each shard merges its runs in the order of terms and adds
   up: one row a term, with its occurrences in every source that has it. Terms in fewer than LEAST_DOCUMENTS documents of
   the language go.
3. A pair's value is a sum over all kept terms of the language, most of which either source lacks. It is formed
   as the value of a term that neither has, times the number of terms, plus corrections: one for each term of either source
   (by the number of its occurrences, of which few different ones occur), and one for each term that both have, which stream
   off the table of terms and leave a task as one sum a pair.

The driver holds a count for each (language, source); the result has a row for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.plans.shared import bound_batches, discard, join_checked, materialise

#: Documents of a language that have a term, at least, if it is kept.
LEAST_DOCUMENTS = 3
#: Ranks of terms that are reported for a group.
REPORTED = 200
#: Terms, repeats included, whose entries (language, source, term) a task holds as a block.
BLOCK_TERMS = 1_500_000
#: Shares are counted in units of this part of all.
UNIT = 1_000_000_000
#: Rows of a batch that leaves a task; elements of pairs that are worked out at once.
RUN_ROWS, PAIR_ELEMENTS = 20_000, 1_000_000

_RUN = "key string, source string, n long, docs long"
_TERMS = "lang string, term string, total long, sources array<string>, counts array<long>"

#: A-Z to a-z, what is no part of a term to a space; bytes above 127 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)


def split_terms(texts):
    """The terms of an Arrow array of UTF-8 texts (binary, null: empty) in order, and the number of the text that each is in."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, b"")
    _, offsets, data = texts.buffers()
    folded = _FOLDED[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    pieces = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset))
    found, at = pieces.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy())
    known = pc.greater(pc.binary_length(found), 0)  # a text that begins or ends with a space has an empty piece there
    return found.filter(known), at[known.to_numpy(zero_copy_only=False)]


def _runs(block_terms: int):
    """Batches of (lang, text, source) to runs of (key, source, n, docs) in the order of keys.

    A key is a term, a NUL (which no term holds) and the language. Each group (lang, source) of a block also has a row of the
    empty term, so groups without terms are not lost.
    """

    def spilled(terms: list, at: list[np.ndarray], groups: list[np.ndarray], names: dict[tuple[str, str], int]) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode()
        size = len(coded.dictionary) + 1
        starts = np.cumsum([0, *(len(g) for g in groups)])
        rows, code = np.concatenate([x + s for x, s in zip(at, starts, strict=False)]), coded.indices.to_numpy().astype(np.int64)
        in_text, often = np.unique(rows * size + code, return_counts=True)
        entry = np.concatenate(groups)[in_text // size] * size + in_text % size
        order = entry.argsort(kind="stable")
        first = np.flatnonzero(np.diff(entry[order], prepend=-1))
        entry, n, docs = entry[order][first], np.add.reduceat(often[order], first) if len(first) else often[:0], np.diff(np.append(first, len(order)))
        langs, sources = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
        group = np.concatenate([entry // size, np.arange(len(names))])
        words = pa.concat_arrays([coded.dictionary.take(pa.array(entry % size)), pa.array([""] * len(names), pa.string())])
        nothing = np.zeros(len(names), np.int64)
        keys = pc.binary_join_element_wise(words, langs.take(pa.array(group)), "\0")
        run = pa.table([keys, sources.take(pa.array(group)), pa.array(np.concatenate([n, nothing])), pa.array(np.concatenate([docs, nothing]))], names=["key", "source", "n", "docs"])
        yield from run.sort_by([("key", "ascending"), ("source", "ascending")]).to_batches(max_chunksize=RUN_ROWS)

    def run(batches: Iterator) -> Iterator:
        terms, at, groups, names, held = [], [], [], {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found, where = split_terms(batch.column(1))
            own = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            terms.append(found)
            at.append(where)
            groups.append(np.fromiter((names.setdefault(x, len(names)) for x in own), np.int64, batch.num_rows))
            held += len(found)
            if held >= block_terms:
                yield from spilled(terms, at, groups, names)
                terms, at, groups, names, held = [], [], [], {}, 0
        if groups:
            yield from spilled(terms, at, groups, names)

    return run


def _merged(least: int):
    """Sorted rows of runs to one row a term; of the last term of a batch only its sums are carried on."""

    def firsts(*columns) -> np.ndarray:
        """Where a row differs from the one before."""
        import pyarrow.compute as pc

        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        return np.flatnonzero(new)

    def added(table):
        """One row for each (key, source)."""
        import pyarrow as pa

        at = firsts(table["key"], table["source"])
        if len(at) == table.num_rows:
            return table
        sums = [pa.array(np.add.reduceat(table[c].to_numpy(), at)) for c in ("n", "docs")]
        return pa.table([*(table[c].take(pa.array(at)) for c in ("key", "source")), *sums], names=["key", "source", "n", "docs"])

    def finished(table) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not table.num_rows:
            return
        at = firsts(table["key"])
        ends = np.append(at[1:], table.num_rows)
        unnamed = pc.starts_with(table["key"].take(pa.array(at)), "\0").to_numpy(zero_copy_only=False).astype(bool)
        keep = np.flatnonzero((np.add.reduceat(table["docs"].to_numpy(), at) >= least) | unnamed)
        if not len(keep):
            return
        rows = np.concatenate([np.arange(at[i], ends[i]) for i in keep])
        offsets = pa.array(np.concatenate(([0], np.cumsum((ends - at)[keep]))), pa.int32())
        whole = table.take(pa.array(rows))
        lists = [pa.ListArray.from_arrays(offsets, whole[c].combine_chunks()) for c in ("source", "n")]
        totals = pa.array(np.add.reduceat(table["n"].to_numpy(), at)[keep])
        parts = [k.split("\0", 1) for k in table["key"].take(pa.array(at[keep])).to_pylist()]
        out = pa.table([pa.array([x[1] for x in parts], pa.string()), pa.array([x[0] or None for x in parts], pa.string()), totals, *lists], names=["lang", "term", "total", "sources", "counts"])
        yield from out.to_batches(max_chunksize=RUN_ROWS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = added(table if held is None else pa.concat_tables([held, table]).combine_chunks())
            last = int(firsts(table["key"])[-1])
            yield from finished(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from finished(held)

    return run


def term_table(docs: DataFrame, least: int = LEAST_DOCUMENTS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, term, total, sources, counts: the kept terms of each language, and a row of a null term with all its sources."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("binary").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    runs = rows.mapInArrow(_runs(block_terms), _RUN)
    return runs.repartition("key").sortWithinPartitions("key", "source").mapInArrow(_merged(least), _TERMS)


def _share(count: Column, n: Column, v: Column) -> Column:
    """p of so many occurrences; decimals, as counts of 10^10 times 10^9 leave a long."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(11,0)") * (count + 1).cast("decimal(20,0)"), (n + v).cast("decimal(20,0)"))).cast("long")


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(sizes: dict[str, tuple[int, dict[str, int]]]):
    """Rows of terms to (lang, source, item, value): sums of the corrections for terms that two sources have.

    ``sizes``: for each language V and N by source.
    """

    def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if counts.max(initial=0) < 9_000_000_000:
            return 1 + (UNIT * (counts + 1)) // whole
        return (1 + (UNIT * (counts.astype(object) + 1)) // whole.astype(object)).astype(np.int64)

    def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict = {}
        order = {lang: {s: i for i, s in enumerate(sorted(of))} for lang, (_, of) in sizes.items()}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                at = order[lang]
                v, of = sizes[lang]
                total = np.array([of[s] + v for s in sorted(of)], np.int64)
                nothing = shares(np.zeros(len(total), np.int64), total)
                neither = value(nothing[:, None], nothing[None, :])
                rows = np.flatnonzero(langs == lang)
                sources, counts = (batch.column(c).take(pa.array(rows)) for c in (3, 4))
                lengths = np.diff(sources.offsets.to_numpy())
                index = np.fromiter((at[s] for s in sources.flatten().to_pylist()), np.int64, int(lengths.sum()))
                number, starts = counts.flatten().to_numpy(), np.cumsum(lengths) - lengths
                for k in np.unique(lengths[lengths > 1]):
                    alike = starts[lengths == k]
                    step = max(1, PAIR_ELEMENTS // int(k * k))
                    for i in range(0, len(alike), step):
                        place = alike[i : i + step, None] + np.arange(k)
                        s = index[place]
                        p, none = shares(number[place], total[s]), nothing[s]
                        a, b, a0, b0 = p[:, :, None], p[:, None, :], none[:, :, None], none[:, None, :]
                        pair = (s[:, :, None] * len(total) + s[:, None, :]).ravel()
                        x = (value(a, b) - value(a, b0) - value(a0, b)).ravel() + neither.ravel()[pair]
                        # sums of 31 bits of a million values are exact in doubles
                        low, high = (np.bincount(pair, y, len(total) ** 2) for y in (x & 0x7FFFFFFF, x >> 31))
                        for j in np.flatnonzero((low != 0) | (high != 0)):
                            sums[lang, int(j)] = sums.get((lang, int(j)), 0) + int(low[j]) + (int(high[j]) << 31)
        out = [(lang, *divmod(j, len(order[lang])), x) for (lang, j), x in sums.items()]
        names = {lang: sorted(of) for lang, of in order.items()}
        rows = [(lang, names[lang][a], names[lang][b], str(x)) for lang, a, b, x in out if a != b]
        for i in range(0, len(rows), RUN_ROWS):
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "item", "value"), r, strict=True)) for r in rows[i : i + RUN_ROWS]], pa.schema([(c, pa.string()) for c in ("lang", "source", "item", "value")]))

    return run


def _pairs(terms: DataFrame, groups: DataFrame, entries: DataFrame, sizes: dict) -> DataFrame:
    """lang, source, item, value of every two sources of a language."""
    a = groups.select("lang", "source", F.col("n").alias("n"), "v")
    b = groups.select("lang", F.col("source").alias("item"), F.col("n").alias("m"))
    pairs = a.join(b, "lang").where("source != item")
    zero = F.lit(0)
    p0, q0 = _share(zero, F.col("n"), F.col("v")), _share(zero, F.col("m"), F.col("v"))
    pairs = materialise(pairs.where("v > 0").withColumn("p0", p0).withColumn("q0", q0).withColumn("none", _value(F.col("p0"), F.col("q0"))), "divergence-pairs")
    often = materialise(entries.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")), "divergence-counts")
    exact = lambda x: x.cast("decimal(38,0)")
    about_source = join_checked(often, pairs, ["lang", "source"]).select("lang", "source", "item", exact(F.col("terms") * exact(_value(_share(F.col("count"), F.col("n"), F.col("v")), F.col("q0")) - F.col("none"))).alias("value"))
    about_item = join_checked(often.withColumnRenamed("source", "item"), pairs, ["lang", "item"]).select("lang", "source", "item", exact(F.col("terms") * exact(_value(F.col("p0"), _share(F.col("count"), F.col("m"), F.col("v"))) - F.col("none"))).alias("value"))
    base = pairs.select("lang", "source", "item", exact(exact(F.col("v")) * F.col("none")).alias("value"))
    both = terms.where("term is not null").mapInArrow(_both(sizes), "lang string, source string, item string, value string").select("lang", "source", "item", exact(F.col("value")).alias("value"))
    nothing = a.join(b, "lang").where("source != item and v = 0").select("lang", "source", "item", exact(zero).alias("value"))
    every = base.unionByName(about_source).unionByName(about_item).unionByName(both).unionByName(nothing)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, reported: int = REPORTED) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources, and the terms that a source has more often than its language.

    Null text, lang and source count as empty; each row is a document, so repeated rows count again; very long texts are
    counted whole; ties have the item of least UTF-8 first; an empty table, or one without groups of two, gives no
    pairs; further columns are not read.
    """
    bound_batches(docs.sparkSession)
    terms = materialise(term_table(docs, least), "divergence-terms")
    entries = terms.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    counted = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    languages = terms.groupBy("lang").agg(F.count("term").alias("v"), F.sum("total").alias("whole"))
    groups = materialise(counted.join(languages, "lang"), "divergence-groups")
    sizes: dict = {}
    for g in groups.collect():
        sizes.setdefault(g.lang, (g.v, {}))[1][g.source] = g.n
    kept = entries.where("term is not null")
    pairs = _pairs(terms, groups, kept, sizes)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shares = join_checked(kept.where("count > 0"), groups, ["lang", "source"])
    shares = shares.withColumn("p", _share(F.col("count"), F.col("n"), F.col("v"))).withColumn("q", _share(F.col("total"), F.col("whole"), F.col("v"))).where("p > q")
    top = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= reported)
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(top)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of ``documents``."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_divergence": op12_divergence}
_P = "CAST(1 + (1000000000::HUGEINT * ({c} + 1)) // ({n} + v) AS HUGEINT)"
ORACLE: dict[str, str] = {
    "op12_divergence": f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
tokens AS (SELECT lang, source, r, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
langs AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS whole FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept k USING (lang) GROUP BY 1),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM tokens t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, v, whole, coalesce((SELECT sum(c) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_P.format(c="coalesce(c.c, 0)", n="g.n")} AS p, {_P.format(c="k.total", n="g.whole")} AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {REPORTED}"""
}
