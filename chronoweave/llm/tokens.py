"""Encoding a corpus with a public tokenizer by content-defined chunk reuse.

A rolling hash over the bytes of a text sets its chunk borders, so equal passages of different documents become
equal chunks. Every distinct chunk is encoded once. Then each document is put together from its chunks: at every
join the last pieces before it are taken back and the text is re-encoded until a piece border agrees with a
border of the next chunk, from where on the chunk's own ids hold. The result equals encoding whole texts.

Defined cases: null and empty texts have an empty list of ids; strings of special tokens are ordinary text; a
document id that occurs in several rows is one document (the largest of its texts); very long texts are encoded
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from chronoweave.operators.skew import largest_by_key, parallel, salted_lookup
from chronoweave.sources.tables import cut

WINDOW = 16
#: A border follows a byte whose window hash has these bits clear: one in 64 bytes on average.
BORDER_MASK = np.uint32(0x3F << 20)
#: Pieces taken back at a join. What follows a piece can change it and the one before, no more.
TAKE_BACK = 3
HOT_ROWS = 100_000
SALTS = 32
_POWERS = np.array([pow(0x01000193, WINDOW - 1 - k, 1 << 32) for k in range(WINDOW)], dtype=np.uint32)
_BYTE_VALUES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def chunk_borders(data: bytes) -> list[int]:
    """Byte offsets of the chunk borders inside ``data``, none inside a character."""
    if len(data) <= WINDOW:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    values = _BYTE_VALUES[raw]
    hashes = np.zeros(len(raw) - WINDOW, dtype=np.uint32)
    for k in range(WINDOW):
        hashes += values[k : len(raw) - WINDOW + k] * _POWERS[k]
    starts = raw[WINDOW:] & 0xC0 != 0x80
    return (np.flatnonzero((hashes & BORDER_MASK == 0) & starts) + WINDOW).tolist()


def chunks(text: str) -> list[str]:
    data = text.encode("utf-8", "surrogatepass")
    cuts = [0, *chunk_borders(data), len(data)]
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:], strict=False)]


@F.pandas_udf(ArrayType(StringType()))
def _chunk_batch(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)


class PieceEncoder:
    """Pieces of the tokenizer's pattern and the ids of each piece, from a rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ids = lru_cache(maxsize=200_000)(self._ids)

    def _ids(self, piece: str) -> tuple[int, ...]:
        return tuple(self.encoding.encode_ordinary(piece))

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def join(self, parts: list[tuple[list[int], list[int], str]]) -> list[int]:
        """Ids of the text whose chunks are ``parts``: (ids, ids of each piece, chunk)."""
        ids: list[int] = []
        tail: list[tuple[str, int]] = []  # the last pieces and their numbers of ids
        for chunk_ids, counts, chunk in parts:
            pieces = self.pieces(chunk)
            if not ids:
                ids, tail = list(chunk_ids), list(zip(pieces, counts, strict=True))[-TAKE_BACK:]
                continue
            back = "".join(piece for piece, _ in tail)
            del ids[len(ids) - sum(count for _, count in tail) :]
            borders, at = {0: 0}, 0
            for k, piece in enumerate(pieces, 1):
                at += len(piece)
                borders[at] = k
            text, at, redone = back + chunk, 0, []
            while at < len(text) and borders.get(at - len(back)) is None:
                piece = self.pattern.match(text, at).group()
                redone.append((piece, len(self.ids(piece))))
                ids += self.ids(piece)
                at += len(piece)
            agreed = borders.get(at - len(back), len(pieces))
            ids += chunk_ids[sum(counts[:agreed]) :]
            tail = (redone + list(zip(pieces, counts, strict=True))[agreed:])[-TAKE_BACK:]
        return ids


def tokenizer_source(name: str, module: str = "public_tokenizers") -> tuple[str, str]:
    """(path of the rank file, pattern) of a public tokenizer, from the installed package that describes them."""
    package = importlib.import_module(module)
    return package.path(f"{name}.tiktoken"), package.PATTERN


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(path, pattern)


_ENCODED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType()))])


def encode_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) with one row a document."""
    path, pattern = tokenizer_source(tokenizer)

    @F.pandas_udf(_ENCODED)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            found = [[encoder.ids(piece) for piece in encoder.pieces(chunk)] for chunk in batch]
            yield pd.DataFrame({"ids": [[i for ids in pieces for i in ids] for pieces in found], "counts": [[len(ids) for ids in pieces] for pieces in found]})

    @F.pandas_udf(ArrayType(IntegerType()))
    def put_together(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            yield batch.map(lambda parts: encoder.join([(list(p["ids"]), list(p["counts"]), p["chunk"]) for p in parts]))

    rows = largest_by_key(documents, "doc_id", "text")
    spread = cut(parallel(rows.where("text <> ''")).select("doc_id", F.posexplode(_chunk_batch("text")).alias("at", "chunk")))
    once = spread.select("chunk").distinct().select("chunk", encode("chunk").alias("code"))
    coded = salted_lookup(spread, once, "chunk", HOT_ROWS, SALTS)
    part = F.struct("at", F.col("code.ids").alias("ids"), F.col("code.counts").alias("counts"), "chunk")
    whole = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = whole.select("doc_id", put_together("parts").alias("ids"))
    none = rows.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(none)


def count_tokens(texts: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """``texts`` with a column n_tokens, the number of tokens of its column text (0 for null)."""
    path, pattern = tokenizer_source(tokenizer)

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoder(path, pattern).encoding
        for batch in batches:
            yield pd.Series([0 if text is None else len(encoding.encode_ordinary(text)) for text in batch], dtype="int32")

    return texts.withColumn("n_tokens", count("text"))
