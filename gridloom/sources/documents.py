"""Reading documents, raw tables and question lists.

A document is (source, text, doc_seq, doc_key): ``doc_key`` is its identity, from which
its blocks get their ids, ``source`` only its name.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, trim

INLINE = "(inline)"
PATH_CHARS = 4096  #: a longer string is no path


def text_key(source, text):
    """Identity of a text that has no path: its source and a hash of the text."""
    return F.concat_ws("\x1f", F.coalesce(source, F.lit("")), F.sha2(F.coalesce(text, F.lit("")), 256))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files; the full path is a file's identity, its name the source, and files are ordered by a hash of the path.

    A missing path raises when the plan is made.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_key"), F.col("value").alias("text"))
    return files.select(F.element_at(F.split("doc_key", "/"), -1).alias("source"), "text", F.shiftrightunsigned(F.xxhash64("doc_key"), 24).alias("doc_seq"), "doc_key")


def inline_documents(spark: SparkSession, texts: list[str], source: str = INLINE) -> DataFrame:
    """Texts at hand, also a list of raw tables; a text that occurs again is the same document."""
    once = dict.fromkeys(texts)
    rows = [(source, t, i, f"{source}\x1f{hashlib.sha256(t.encode('utf-8', 'surrogatepass')).hexdigest()}") for i, t in enumerate(once)]
    return spark.createDataFrame(rows, "source string, text string, doc_seq long, doc_key string")


def is_path(spark: SparkSession, given: str) -> bool:
    """Whether a string names something on the session's file systems."""
    if not given.strip() or len(given) >= PATH_CHARS or "\n" in given:
        return False
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(given)
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))
    except Exception:  # not a well-formed path, or of an unknown file system: a text
        return False


def documents_of(spark: SparkSession, given: DataFrame | os.PathLike | str, source: str = INLINE) -> DataFrame:
    """A DataFrame as it is, a path object or an existing path as its files, any other string as one text."""
    if isinstance(given, DataFrame):
        return given
    if isinstance(given, os.PathLike):
        return read_documents(spark, os.fspath(given))
    return read_documents(spark, given) if is_path(spark, given) else inline_documents(spark, [given], source)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question) of one file: its lines that are neither blank nor comments; qid is the line's number from 0."""
    listed = spark.read.text(path, wholetext=True).select(F.posexplode(lines(F.col("value"))).alias("qid", "line"))
    return listed.select(F.col("qid").cast("long").alias("qid"), trim(F.col("line")).alias("question")).where("question <> '' and not startswith(question, '#')")
