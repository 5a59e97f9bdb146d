"""Block stores and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_SCHEMA = "doc_id string, source string, seq array<bigint>, section_idx int, para_idx int, kind string, section string, content string, markdown string, headers array<string>, rows array<array<string>>, source_format string, context_notes string"


def save_blocks(blocks: DataFrame, path: str, kind: str = "parquet") -> None:
    blocks.write.mode("overwrite").format(kind).save(path)


def load_blocks(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).format(kind).load(path)


def upsert(blocks: DataFrame, new: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """``blocks`` with ``new`` put in: a key's last row stays."""
    both = blocks.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at", "_new")


def get(blocks: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks of the keys; missing ones have no row."""
    return blocks.join(keys.select(key), key, "left_semi")


def remaining(questions: DataFrame, done: DataFrame, key: str = "question") -> DataFrame:
    """Questions that a run can go on with: those not in its output yet."""
    return questions.join(done.select(key), key, "left_anti")


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)
