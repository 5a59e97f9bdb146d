"""Columns computed by Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StringType


def with_python(df: DataFrame, name: str, given: Column, call: Callable[[list], list], kind: DataType) -> DataFrame:
    """``df`` with column ``name``: ``call`` on the list of ``given`` values of each batch.

    A map over batches, not a UDF expression, so no optimizer rule can move it into a join.
    """
    columns = [c for c in df.columns if c != name]
    arrow = to_arrow_type(kind)
    schema = df.select(*columns).schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(call(batch.column(batch.num_columns - 1).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*columns, name])

    return df.select(*columns, given.alias("_given")).mapInArrow(run, schema)


def grouped(tokens: pa.ListArray, place: Callable[[pa.Array], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct tokens of each row of a batch: (row, place, count, rows' offsets, distinct tokens of the batch).

    ``place`` maps the batch's distinct tokens to integers; without it a token's place
    is its position among them.
    """
    coded = tokens.flatten().dictionary_encode()
    codes, known = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    places = np.arange(len(known)) if place is None else place(known)
    rows = np.repeat(np.arange(len(tokens)), np.diff(np.asarray(tokens.offsets)))
    width = int(places.max(initial=0)) + 1
    pairs, counts = np.unique(rows * width + places[codes], return_counts=True)
    row, at = np.divmod(pairs, width)
    return row, at, counts, np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32), known


def counted_tokens(df: DataFrame, tokens: Column) -> DataFrame:
    """``df`` with the distinct ``tokens`` of each row and their counts, as arrays ``terms`` and ``counts``: no shuffle."""
    columns = [c for c in df.columns if c not in ("terms", "counts")]
    schema = df.select(*columns).schema.add("terms", ArrayType(StringType())).add("counts", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, counts, offsets, known = grouped(batch.column(batch.num_columns - 1))
            terms = pa.ListArray.from_arrays(offsets, known.take(pa.array(at)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], terms, pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=[*columns, "terms", "counts"])

    return df.select(*columns, tokens.alias("_tokens")).mapInArrow(run, schema)


def first_k(scores: np.ndarray, seqs: list, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``scores`` the ``k`` best columns, ties in order of ``seqs``: (rows, columns) of those above ``least``."""
    by_seq = np.array(sorted(range(len(seqs)), key=lambda i: (seqs[i] is None, seqs[i])), dtype=np.int64)
    steady = np.round(scores[:, by_seq], 9)
    best = np.argsort(-steady, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(scores)), best.shape[1])
    columns = by_seq[best.ravel()]
    if least is not None:
        above = scores[rows, columns] > least
        rows, columns = rows[above], columns[above]
    return rows, columns
