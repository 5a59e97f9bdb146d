"""Embedders: sparse hashed tokens, or any callable, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..functions.python import grouped, with_python
from ..functions.text import hash_tokens

DIMS = 512


class Embedder(Protocol):
    """Vectors of a list of texts; an empty list gives an empty one."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class CallableEmbedder:
    """A function from texts to vectors as an embedder."""

    def __init__(self, function: Callable[[list[str]], list[list[float]]]):
        self.function = function

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.function(texts) if texts else []


class ModelEmbedder(CallableEmbedder):
    """An object with ``embed_documents`` (the usual adapter of model libraries) as an embedder."""

    def __init__(self, model):
        super().__init__(model.embed_documents)


def hash_index(token: Column, dims: int = DIMS) -> Column:
    """The first four bytes of the token's MD5, little-endian, modulo ``dims``."""
    digest = F.md5(token.cast("binary"))
    turned = F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)])
    return (F.conv(turned, 16, 10).cast("long") % dims).cast("int")


def sparse_vectors(texts: DataFrame, key: str = "doc_id", text: str = "text", dims: int = DIMS) -> DataFrame:
    """Sparse unit vectors of hashed token counts as arrays (key, idx, w) of one row, idx ascending.

    Tokens are found by Spark and counted in Arrow batches: a function of one row, so
    nothing is shuffled.  A text without tokens has empty arrays.
    """
    schema = texts.select(key).schema.add("idx", ArrayType(IntegerType())).add("w", ArrayType(DoubleType()))

    def place(known: pa.Array) -> np.ndarray:
        return np.fromiter((int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little") % dims for t in known.to_pylist()), dtype=np.int64, count=len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, counts, offsets, _ = grouped(batch.column(1), place)
            squares = np.bincount(row, weights=counts.astype(np.float64) ** 2, minlength=batch.num_rows)
            w = counts / np.sqrt(squares[row])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w, pa.float64()))], names=[key, "idx", "w"])

    return texts.select(key, hash_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).mapInArrow(run, schema)


def hash_vectors(texts: DataFrame, key: str = "doc_id", text: str = "text", dims: int = DIMS) -> DataFrame:
    """``sparse_vectors`` a row for each index: (key, idx, w)."""
    return sparse_vectors(texts, key, text, dims).select(key, F.explode(F.arrays_zip("idx", "w")).alias("e")).select(key, "e.idx", "e.w")


def embed_texts(texts: DataFrame, embedder: Embedder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Dense vectors (key, v), a call of the embedder for each Arrow batch."""

    def vectors(batch: list) -> list:
        return [[float(x) for x in v] for v in embedder.embed([t or "" for t in batch])]

    return with_python(texts.select(key, text), "v", F.col(text), vectors, ArrayType(DoubleType())).select(key, "v")
