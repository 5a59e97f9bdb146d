"""The TF-IDF baseline: chunks, sparse vectors, cosine by equi-join on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python import counted_tokens
from ..functions.text import lines, plain_tokens, trim, word_tokens
from ..sources.staging import drop, materialize
from .index import ranked, steady


def chunks(text: Column, separator: str = "\n---\n") -> Column:
    """Parts between separators, else paragraphs, else the whole text."""
    cut = lambda by: F.filter(F.transform(F.split(text, by, -1), trim), lambda p: p != "")
    parts, blocks = cut(separator), cut("\n\n")
    return F.when(F.size(parts) > 1, parts).when(F.size(blocks) > 0, blocks).otherwise(F.array(trim(text)))


def preview(chunk: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(lines(chunk), 1, n), "\n")


def counted(texts: DataFrame, text: str = "text", scikit: bool = False) -> DataFrame:
    """``texts`` with arrays ``terms`` and ``counts`` in place of the text; ``scikit`` takes tokens of two letters or more."""
    tokens = (word_tokens if scikit else plain_tokens)(F.coalesce(F.col(text), F.lit("")))
    return counted_tokens(texts, tokens).drop(text)


def term_idf(counts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1, of ``counted`` texts."""
    return counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def weighed(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w): counts times idf, unseen terms left out.

    The share of a text's tokens and the raw count differ by a factor that cancels in the norm.
    """
    each = counts.select(key, F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(key, F.col("e.terms").alias("term"), F.col("e.counts").alias("n"))
    return each.join(weights.select("term", "idf"), "term").select(key, "term", (F.col("n") * F.col("idf")).alias("w"))


def retrieve(questions: DataFrame, texts: DataFrame, k: int | None = 3, scikit: bool = False) -> DataFrame:
    """(qid, rank, doc_id, score) for questions (qid, question) over texts (doc_id, seq, text).

    Texts without a shared term score 0 and follow in order of ``seq`` (only as many as
    can be in the top k).  Texts are counted once and written; norms are one aggregation
    over a text's terms, and only terms of the questions meet them.
    """
    counts, counts_path = materialize(counted(texts.select("doc_id", "seq", "text"), scikit=scikit), "counts")
    weights, weights_path = materialize(term_idf(counts, counts.count()), "idf")
    q = weighed(counted(questions.select("qid", "question"), "question", scikit), weights, "qid")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    q = q.join(q.groupBy("qid").agg(norm.alias("norm")), "qid").select("qid", "term", (F.col("w") / F.col("norm")).alias("qw"))
    q, q_path = materialize(q, "asked")
    # one pass over terms: the norm of each text, and its weights of terms that are asked for
    d = weighed(counts, weights, "doc_id").join(q.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left")
    wanted = F.when(F.col("asked"), F.struct("term", "w"))
    d = d.groupBy("doc_id").agg(norm.alias("norm"), F.collect_list(wanted).alias("terms")).where(F.size("terms") > 0)
    d = d.select("doc_id", "norm", F.explode("terms").alias("e")).select("doc_id", F.col("e.term").alias("term"), (F.col("e.w") / F.col("norm")).alias("w"))
    scored = d.join(q, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    order = counts.select("doc_id", "seq")
    fill = (order if k is None else order.orderBy("seq").limit(k)).select("doc_id").crossJoin(questions.select("qid")).withColumn("score", F.lit(0.0))
    both = scored.unionByName(fill.select("qid", "doc_id", "score")).groupBy("qid", "doc_id").agg(F.max("score").alias("score")).join(order, "doc_id")
    found, _ = materialize(ranked(both, k, steady("score"), F.col("seq")).select("qid", "rank", "doc_id", "score"), "ranked")
    drop(texts.sparkSession, counts_path, weights_path, q_path)
    return found
