"""Byte-level BPE: exact merges by backtracking over longest matches, and decoding.

A piece is a match of the split pattern. Its bytes are read as Latin-1 text, so that one
pyahocorasick automaton over the vocabulary finds every token at every start. The encoder walks
from left to right with the longest token; two neighbours are accepted only if the merges leave
exactly these two tokens of their joint bytes (remembered per pair). When no token fits, the start
is marked dead and the walk steps back, so each start is left for good once: linear time.

Nulls and empty texts encode to no ids. Extra columns stay unless they clash with a result column,
which then replaces them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.plans.shared import bound_batches

#: Pieces longer than this are encoded each time; shorter ones are remembered.
REMEMBERED_CHARS = 40
#: Pieces a worker remembers before it starts afresh.
REMEMBERED_PIECES = 200_000
#: Pairs a worker remembers before it starts afresh.
REMEMBERED_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """Encoder and decoder for one vocabulary and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The plain definition: merge the neighbours of least rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            joined = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(joined)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joint bytes leave exactly these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        starts: list[list[tuple[int, int]]] = [[] for _ in data]  # tokens by start, shortest first
        for end, found in self.automaton.iter(data.decode("latin-1")):
            starts[end + 1 - found[0]].append(found)
        size, at, chosen = len(data), 0, []
        dead = bytearray(size + 1)
        untried = [len(x) for x in starts]  # how many tokens of a start may still be taken
        while at < size:
            while untried[at]:
                untried[at] -= 1
                length, rank = starts[at][untried[at]]
                if not dead[at + length] and (not chosen or self.compatible(chosen[-1][1], rank)):
                    chosen.append((at, rank))
                    at += length
                    if at < size:
                        untried[at] = len(starts[at])
                    break
            else:
                if not chosen:
                    raise ValueError("the vocabulary lacks a single byte")
                dead[at] = 1
                at, _ = chosen.pop()
        return tuple(rank for _, rank in chosen)

    def encode(self, text: str) -> list[int]:
        pieces, known = self.split(text), self.pieces
        for piece in set(pieces).difference(known):
            if len(piece) <= REMEMBERED_CHARS:
                if len(known) >= REMEMBERED_PIECES:
                    known.clear()
                known[piece] = self.encode_piece(piece)
        try:
            return list(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:  # long pieces, or the memory was cleared meanwhile
            return list(chain.from_iterable(known.get(x) or self.encode_piece(x) for x in pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def encode_column(path: str, pattern: str):
    """A Pandas UDF: text -> array of ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _worker(path, pattern)
        for batch in texts:
            yield batch.map(lambda x: bpe.encode(x or ""))

    return encode


def decode_column(path: str, pattern: str):
    """A Pandas UDF: array of ids -> bytes."""

    @F.pandas_udf(T.BinaryType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _worker(path, pattern)
        for batch in ids:
            yield batch.map(lambda x: bpe.decode([] if x is None else list(x)))

    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of each whole text (null: none) in ``out``."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, encode_column(path, pattern)(F.col(text)))


def round_trip(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """Encode each text, decode the ids again, and keep the digests of both, by document, with the columns ``keep``.

    Ids leave the worker only as their digest: at corpus scale they are several times the text.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *(docs.schema[c] for c in keep),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = _worker(path, pattern)
        decimal = {rank: str(rank) for rank in bpe.token}
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string()), *batch.columns[2:]],
                names=schema.names,
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every document, by the public 50k byte-level ranks."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op1_bpe": op1_bpe}
#: No SQL: merges are iterative; tests compare with the tiktoken library.
ORACLE: dict[str, str] = {}
