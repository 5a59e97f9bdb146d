"""Exact top-k search without random access.

Rows and queries are dealt into blocks, and a query block and a row block make a cell,
so no task ever holds more than two blocks.  A cell sorts every dimension once.  For a
query each dimension is a list of contributions to the score, best first, and the lists
are read side by side, a slice of each at a time, once for all queries of the cell.  Of
every row two bounds are kept from what was read: the sum of its contributions seen so far, plus, for each list where
it has not come up yet, the worst entry of that list (lower bound) or the last one
read (upper bound).  Reading stops when the rows whose upper bound reaches the k-th
lower bound are few; only those get final scores.

The k-th best score of blocks that are done is a lower bound for all others.  Blocks
are therefore searched in levels, first one, then 16 times as many at a time, and a
query takes its k-th score along to the next level.  Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize

SCHEMA = "query_id long, vec_id long, score long"
GROWTH = 16  #: row blocks of a level for each block of the one before


def quantized(embedding: Column, factor: int = 256) -> Column:
    """Components as floor(factor * x) with x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(embedding: Column) -> Column:
    """Whether a vector is neither null nor empty and has finite components only."""
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


#: parts of the lists' length after which bounds are drawn up
DEPTHS = (1 / 8, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8, 15 / 16, 1)


def no_random_access(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, k: int, floors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per query the rows that can be among its top k, and the list entries read for it.

    ``allowed`` tells for (query, row) whether the row is a candidate at all; ``floors``
    holds a score that the k-th best of each query is known to reach, or -inf.

    A weight only scales a list or turns it round, so the two ways through a dimension
    are read once for all queries.  What was read stands in two matrices of rows by
    dimensions; with the last entry read in all other places their products with the
    weights are the upper bounds, with the list's worst entry the lower ones.
    """
    n, dims = rows.shape
    up = np.argsort(rows, axis=0, kind="stable")
    ascending = np.take_along_axis(rows, up, axis=0).astype(np.float32)
    every = np.arange(dims)
    # single precision is enough for bounds that give way by this much: final scores are integers
    slack = 1e-5 * (np.abs(queries).astype(np.float64) @ np.abs(ascending[[0, -1]]).max(axis=0))
    plus, minus = np.maximum(queries, 0).astype(np.float32), np.minimum(queries, 0).astype(np.float32)
    lists = (queries != 0).sum(axis=1)
    top, bottom = np.full((n, dims), np.nan, dtype=np.float32), np.full((n, dims), np.nan, dtype=np.float32)
    candidates, read = allowed.copy(), np.zeros(len(queries), dtype=np.int64)
    few, start = max(4 * k, 16), 0
    open_ = np.flatnonzero((candidates.sum(axis=1) > few) & (lists > 0))
    for stop in sorted({max(1, round(n * d)) for d in DEPTHS}):
        if not len(open_):
            break
        top[up[n - stop : n - start], every] = ascending[n - stop : n - start]
        bottom[up[start:stop], every] = ascending[start:stop]
        start = stop
        unread = np.isnan(top), np.isnan(bottom)

        def bound(high: np.ndarray, low: np.ndarray, of: np.ndarray = open_, unread: tuple = unread) -> np.ndarray:
            return plus[of] @ np.where(unread[0], high, top).T + minus[of] @ np.where(unread[1], low, bottom).T

        kth = floors[open_]
        if n >= k and not np.isfinite(kth).all():
            lower = np.where(allowed[open_], bound(ascending[0], ascending[-1]), -np.inf)
            kth = np.maximum(kth, np.partition(lower, n - k, axis=1)[:, n - k])
        candidates[open_] &= bound(ascending[n - stop], ascending[stop - 1]) >= (kth - 2 * slack[open_])[:, None]
        read[open_] = stop * lists[open_]
        open_ = open_[candidates[open_].sum(axis=1) > few]
    return [np.flatnonzero(c) for c in candidates], read


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as rows."""
    whole = vectors.combine_chunks()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(whole), -1)


def search_cell(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The up to ``k`` best rows of ``held`` (vec_id, v) for each query of ``asked`` (vec_id, v, floor)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    queries, rows = matrix(asked.column("v")), matrix(held.column("v"))
    own = asked.column("vec_id").to_numpy()
    # ids stay integers: a null is marked apart
    null = held.column("vec_id").is_null().to_numpy()
    ids = held.column("vec_id").fill_null(0).to_numpy()
    floors = asked.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy()
    found, _ = no_random_access(queries, rows, null[None, :] | (ids[None, :] != own[:, None]), k, floors)
    which, at, scores = [], [], []
    for i, candidates in enumerate(found):
        score = rows[candidates] @ queries[i]
        best = np.lexsort((ids[candidates], null[candidates], -score))[:k]
        which.append(np.full(len(best), own[i]))
        at.append(candidates[best])
        scores.append(score[best])
    at = np.concatenate(at)
    return pa.table([pa.array(np.concatenate(which)), pa.array(ids[at], mask=null[at]), pa.array(np.concatenate(scores))], schema=schema)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, cell_values: int = 1 << 18, queries_per_block: int = 512, first_queries: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest inner products of every query.

    ``vectors`` and ``queries`` have (vec_id, v) with v an array of integers; a query
    does not return rows of its own id.  A row block holds about ``cell_values``
    components.  Cases: null vectors and vectors of another length than the query's take
    no part; a query without an id is not asked, a row without one is found like any
    other and returned with a null vec_id; ties go to the smaller vec_id, null last;
    repeated rows are ranked each; of queries with one id the least vector is asked; a
    query without other rows has no result; further columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("v is not null").select("vec_id", "v", F.size("v").alias("dims"))
    asked, asked_path = materialize(queries.where("v is not null and vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")), "asked")
    total = vectors.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0]
    across, n_asked = max(1, -(-total // cell_values)), asked.count()
    # dealt by place too, so that one vector in very many rows fills no block
    block = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(across)).cast("int")
    dealt, dealt_path = materialize(vectors.withColumn("r", block), "dealt")
    best, best_path = spark.createDataFrame([], SCHEMA), None
    start, width = 0, 1
    by = ["dims", "q", "r"]
    while start < across and n_asked:
        stop = min(across, start + width)
        down = max(1, -(-n_asked // (queries_per_block if start else first_queries)))
        floors = best.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        left = asked.join(floors, F.col("vec_id") == F.col("id"), "left")
        left = left.select("vec_id", "v", "floor", "dims", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int").alias("q"), F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("r"))
        right = dealt.where((F.col("r") >= start) & (F.col("r") < stop)).select("vec_id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"), "r")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, h: search_cell(a, h, k), SCHEMA)
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        top = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best, path = materialize(top.select("query_id", "vec_id", "score"), "best")
        if best_path:
            drop(spark, best_path)
        best_path, start, width = path, stop, width * GROWTH
    drop(spark, asked_path, dealt_path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score")
