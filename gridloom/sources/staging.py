"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets an own folder; a cluster is refused,
    because its driver's temporary folders are out of the executors' reach.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        key = spark.sparkContext.applicationId
        found = _own.setdefault(key, _own.get(key) or tempfile.mkdtemp(prefix="gridloom-"))
    return f"{found.rstrip('/')}/gridloom"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables through Spark's own file system layer."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: makes Spark delete a query's shuffle files when it ends, not when the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


SPLIT_BYTES = 128 << 20  #: what one task reads of files


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files are too small to fill them.

    A table below ``SPLIT_BYTES`` a core may lie in a single row group, which one task
    would read and compute on; dealing that little out costs less.  Larger tables are
    left as they are: their splits keep every core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
