"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, bucket) are summed in numpy in the tasks that read the texts
and merged by one small aggregation; the log-probability matrix (languages by
``2**bits``; the number of languages is bounded by a parameter) is broadcast.  Texts are
scored in batches: the n-grams of all texts of a batch are one sparse matrix, multiplied
with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd multipliers, one for each position
STEP = 1 << 20  # code points hashed at once


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def sparse_rows(texts: list[str], bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of a batch of texts as parts of a sparse matrix: rows (not descending) and buckets, an entry each.

    Texts are lower-cased whole; runs of non-letters are one space.  All texts of the
    batch are hashed as one array, ``STEP`` code points at a time; no n-gram crosses from
    one text to the next.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    codes = np.where(letters()[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    for at in range(0, len(codes), STEP):
        for order in orders:
            piece, of = codes[at : at + STEP + order - 1], row[at : at + STEP + order - 1]
            n = len(piece) - order + 1
            if n <= 0:
                continue
            hashed = np.full(n, order, dtype=np.uint32)
            for i in range(order):
                hashed = (hashed ^ piece[i : n + i]) * np.uint32(MIX[i % 3])
                hashed ^= hashed >> np.uint32(15)
            within = of[:n] == of[order - 1 :]
            yield of[:n][within], (hashed >> np.uint32(32 - bits))[within].astype(np.int64)


def score_batch(texts: list[str], log_p: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (text, language) of a batch, and the number of n-grams of each text.

    The batch's sparse matrix of n-grams times the dense one of log probabilities, a
    language at a time: its entries are gathered and summed by row.
    """
    likely, n = np.zeros((len(texts), len(log_p))), np.zeros(len(texts), dtype=np.int64)
    for row, bucket in sparse_rows(texts, bits):
        n += np.bincount(row, minlength=len(texts))
        for i, of_language in enumerate(log_p):
            likely[:, i] += np.bincount(row, weights=of_language[bucket], minlength=len(texts))
    return likely, n


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


BATCH_CHARS = 1 << 20  #: characters scored at once; a longer text is a batch of its own


def in_batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``BATCH_CHARS`` characters."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fit(labelled: DataFrame, bits: int = 14, rows: int = 20_000, seed: int = 11, most_langs: int = 1024) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log probabilities, from (doc_id, text, lang).

    At most about ``rows`` labelled rows, spread by a hash of doc_id and text (so that
    rows without a doc_id are spread too), are read: the bound of the training sample.
    Add-one smoothing; the prior is uniform.  The sample may name at most ``most_langs`` languages, the bound of the matrix that comes
    to the driver; more are an error, as none could be left out without loss.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n = labelled.count()
    share = min(1.0, rows / n) if n else 1.0
    sample = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = sorted(set(names))
            of = np.array([known.index(x) for x in names], dtype=np.int64)
            for a, b in in_batches(texts):
                for row, bucket in sparse_rows(texts[a:b], bits):
                    found = np.bincount((of[a:b][row] << bits) + bucket, minlength=len(known) << bits).reshape(len(known), -1)
                    for i, lang in enumerate(known):
                        if found[i].any():
                            sums[lang] = sums.get(lang, 0) + found[i]
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total], pa.list_(pa.int64()))], names=["lang", "counts"])

    rows_of = sample.select("text", "lang").mapInArrow(count, "lang string, counts array<long>")
    n_langs = sample.select("lang").distinct().limit(most_langs + 1).count()
    if n_langs > most_langs:
        raise ValueError(f"more than {most_langs} languages in the training sample")
    split = rows_of.select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    merged = split.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).orderBy("lang").collect()
    langs = [r.lang for r in merged]
    matrix = np.ones((len(langs), 1 << bits))
    for i, r in enumerate(merged):
        matrix[i, np.array(r.buckets, dtype=np.int64)] += np.array(r.counts, dtype=np.int64)
    return langs, np.log(matrix / matrix.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray, bits: int = 14) -> DataFrame:
    """``docs`` (any columns, with ``text``) with lang_pred and score in front of them.

    Cases: null text and text without a letter are ``und`` with score 0, as is every
    text where nothing was learned; clashing names are replaced; an empty table gives
    no rows.  The score is the posterior of the prediction with the evidence of a text
    counted as that of at most 64 n-grams, so that long texts do not all score 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, log_p))
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns
    text_at = columns.index("text")
    schema = "lang_pred string, score double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            said, scores = ["und"] * len(texts), [0.0] * len(texts)
            for a, b in in_batches(texts) if names else ():
                at = [i for i in range(a, b) if texts[i] is not None and has_letter(texts[i])]
                if not at:
                    continue
                likely, n = score_batch([texts[i] for i in at], matrix, bits)
                best = likely.argmax(axis=1)
                odds = np.exp((likely - likely.max(axis=1, keepdims=True)) * (np.minimum(n, 64) / n)[:, None])
                for i, name, score in zip(at, best.tolist(), (1 / odds.sum(axis=1)).tolist(), strict=True):
                    said[i], scores[i] = names[name], score
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(scores, pa.float64()), *batch.columns], names=["lang_pred", "score", *columns])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, rows: int = 20_000, bits: int = 14) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Cases: labels of held-out rows are never read, nor are null ones; rows without a
    doc_id are not held out; a null text and one without a letter are ``und`` with score
    0, and so is every text where no label can be learned from; very long texts are read
    whole, part by part; repeated rows are predicted alike; an empty table gives no rows;
    further columns are ignored.
    """
    langs, log_p = fit(docs.where(~held_out(F.col("doc_id"))), bits, rows)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), langs, log_p, bits).select("doc_id", "held_out", "lang_pred", "score")
