"""Shared pieces: small Arrow batches, sums along an order, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import drop, materialize, new_path, shared_dir

__all__ = ["connected_components", "drop", "materialize", "new_path", "running_sum", "shared_dir", "small_batches", "utf8", "with_least"]

#: a key with more rows than both is met by broadcast: this many, and this share of all
HOT_ROWS, HOT_SHARE = 256, 1 / 1024


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written meanwhile: its rows can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def running_sum(df: DataFrame, by: list[Column], value: Column, name: str, group: str | None = None) -> tuple[DataFrame, str]:
    """``df`` with ``name``: the sum of ``value`` over its rows up to this one in the order ``by``; and its path.

    With ``group`` (the first column of the order) sums are of that group's rows.  Rows
    are cut into ranges of the order; each range sums its own rows, and a table of one
    line for each group and range tells what lies before it.  No task orders all rows.
    """
    spark = df.sparkSession
    held = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    held, held_path = materialize(held, "ranges")
    key = F.col(group) if group else F.lit(0)
    per = held.groupBy(key.alias("_group"), F.col("_range").alias("_at")).agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("_group", "_at", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(*([group] if group else []), "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = held.withColumn("_inside", inside).join(per, key.eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    out, path = materialize(joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_value", "_inside", "_group", "_at", "_before"), name)
    drop(spark, held_path)
    return out, path


def with_least(df: DataFrame, key: str, value: str, spread: str, rows: int) -> DataFrame:
    """``df`` with ``low``: the least ``value`` of the rows that share its ``key``.

    ``rows`` is at least the number of rows.  Keys with more than ``HOT_SHARE`` of that
    number (so fewer than 1 / HOT_SHARE keys) and ``HOT_ROWS`` rows are broadcast with
    their minima, and their rows are dealt out by ``spread``; all others meet by key.  No
    task gets the rows of a hub, whatever their size, and minima are combined before
    they are shuffled.  Nulls of ``value`` count for nothing; a null key has a null low.
    """
    per = df.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_low"), F.count("*").alias("_n"))
    hot = per.where((F.col("_n") > max(HOT_ROWS, int(rows * HOT_SHARE))) & F.col("_key").isNotNull()).select(F.col("_key").alias("_hot"), F.col("_low").alias("_hot_low"))
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # the second hash agrees with no key's own: those rows find nothing there, and need nothing
    by = F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(key, spread))
    met = marked.withColumn("_by", by).join(per.select("_key", "_low"), (F.col("_by") == F.xxhash64("_key")) & (F.col(key) == F.col("_key")), "left")
    return met.select(*df.columns, F.coalesce("_hot_low", "_low").alias("low"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest reachable node.

    Alternating large and small stars: each round hangs a node's larger neighbours
    and then its smaller ones on the smallest, until nothing changes.  A node with very
    many edges costs one row a task for its minimum, and ``with_least`` takes that back
    to its edges without bringing them together.  Each round is written to the shared
    folder.  Edges with a null end and loops are ignored.
    """
    spark = edges.sparkSession
    now, path = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = _digest(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = with_least(both, "a", "b", "b", 2 * before[0]).withColumn("low", F.least("a", "low"))
        large = low.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large, large_path = materialize(large, name)
        least = with_least(large, "a", "b", "b", before[0])
        small = least.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        after, new = materialize(small.where("a <> b").distinct(), name)
        drop(spark, path, large_path)
        now, path, was = after, new, before
        before = _digest(now)
        if before == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Row count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
