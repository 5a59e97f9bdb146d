"""IDF-weighted overlap of questions and documents, with prefix matches.

Prefix matches are found between question tokens and the vocabulary, by their first
three letters, and only then joined to postings: no document token is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.python import first_k, grouped
from ..functions.text import lexical_tokens

LEAST, SHARE = 3, 0.8  #: letters for a prefix match, and its share of the token's weight


def forward(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with their distinct ``tokens`` as an array in place of the text."""
    tokens = F.array_distinct(lexical_tokens(F.coalesce(F.col(text), F.lit(""))))
    return texts.select(*[c for c in texts.columns if c not in (text, "tokens")], tokens.alias("tokens"))


def postings(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token), each pair once; distinct within the row, so without a shuffle."""
    return texts.select(key, F.explode(F.array_distinct(lexical_tokens(F.coalesce(F.col(text), F.lit(""))))).alias("token"))


def idf(posted: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 0.5)) of ``n_docs`` documents, those without tokens among them."""
    n = F.lit(n_docs)
    return posted.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 0.5)))


def match_weights(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """(asked, token, weight, exact) between distinct question tokens and the vocabulary."""
    vocabulary = weights.select("token", "idf")
    exact = asked.join(vocabulary, F.col("asked") == F.col("token")).select("asked", "token", F.col("idf").alias("weight"), F.lit(True).alias("exact"))
    front = lambda c: F.substring(c, 1, LEAST)
    a = asked.where(F.length("asked") >= LEAST).withColumn("front", front("asked"))
    v = vocabulary.where(F.length("token") >= LEAST).withColumn("front", front("token"))
    either = F.startswith("token", F.col("asked")) | F.startswith("asked", F.col("token"))
    near = a.join(v, "front").where(either & (F.col("asked") != F.col("token"))).select("asked", "token", (SHARE * F.col("idf")).alias("weight"), F.lit(False).alias("exact"))
    return exact.unionByName(near)


def lexical_scores(questions: DataFrame, posted: DataFrame, weights: DataFrame, pairs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(qid, key, lexical) for pairs that match at all; ``pairs`` (qid, key) restricts them.

    An exact match counts the token's idf, even where a prefix match would weigh more.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(lexical_tokens(F.coalesce("question", F.lit(""))))).alias("asked"))
    top = weights.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("top"))
    total = asked.join(weights, F.col("asked") == F.col("token"), "left").crossJoin(F.broadcast(top)).groupBy("qid").agg(F.sum(F.coalesce("idf", "top")).alias("total"))
    matches = match_weights(asked.select("asked").distinct(), weights)
    if pairs is not None:
        posted = posted.join(pairs.select(key).distinct(), key, "left_semi")
    # once for each distinct question token, however many questions hold it
    per_token = matches.join(posted, "token").groupBy("asked", key).agg(F.max(F.when(F.col("exact"), F.col("weight"))).alias("same"), F.max("weight").alias("best"))
    weighed = asked.join(per_token.select("asked", key, F.coalesce("same", F.greatest("best", F.lit(0.0))).alias("w")), "asked")
    if pairs is not None:
        weighed = weighed.join(pairs.select("qid", key), ["qid", key], "left_semi")
    summed = weighed.groupBy("qid", key).agg(F.sum("w").alias("matched"))
    return summed.join(total, "qid").select("qid", key, F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0).alias("lexical"))


#: what one task may hold of a search: questions, and matches of their tokens with the vocabulary
HELD_QUESTIONS, HELD_MATCHES, CELLS = 2048, 1 << 20, 1 << 22


def lexical_top(questions: DataFrame, documents: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, lexical): for each question the ``k`` best of ``documents`` (doc_id, tokens), ties to the smaller doc_id.

    Documents without a match have no rank.  Where the questions and the matches of
    their tokens are few (checked), they go with the tasks, and each batch of documents
    passes on its own first ``k``: documents are read once and not shuffled.  Otherwise
    matches are joined to postings.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(lexical_tokens(F.coalesce("question", F.lit(""))))).alias("asked"))
    n = questions.select("qid").distinct().limit(HELD_QUESTIONS + 1).count()
    held = match_weights(asked.select("asked").distinct(), weights).limit(HELD_MATCHES + 1).toArrow() if n <= HELD_QUESTIONS else None
    if held is None or held.num_rows > HELD_MATCHES:
        posted = documents.select("doc_id", F.explode("tokens").alias("token"))
        scores = lexical_scores(questions, posted, weights).where("lexical > 0")
    else:
        scores = _lexical_held(questions, asked, documents, weights, held, k)
    order = Window.partitionBy("qid").orderBy(F.round("lexical", 6).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "lexical")


def _lexical_held(questions: DataFrame, asked: DataFrame, documents: DataFrame, weights: DataFrame, held: pa.Table, k: int) -> DataFrame:
    known = asked.join(weights.select("token", "idf"), F.col("asked") == F.col("token"), "left").select("qid", "asked", "idf").collect()
    top = weights.agg(F.coalesce(F.max("idf"), F.lit(1.0))).first()[0]
    qids = sorted({r.qid for r in known})
    words = {w: i for i, w in enumerate(sorted({r.asked for r in known}))}
    holds = np.zeros((len(words), len(qids)))
    total = np.zeros(len(qids))
    at = {q: i for i, q in enumerate(qids)}
    for r in known:
        holds[words[r.asked], at[r.qid]] = 1
        total[at[r.qid]] += top if r.idf is None else r.idf
    found = held.sort_by("token")
    tokens = found.column("token").combine_chunks()
    first = tokens.dictionary_encode()
    starts = np.searchsorted(np.asarray(first.indices), np.arange(len(first.dictionary) + 1))
    places = dict(zip(first.dictionary.to_pylist(), range(len(first.dictionary)), strict=True))
    word = np.array([words[a] for a in found.column("asked").to_pylist()], dtype=np.int64)
    weight, exact = found.column("weight").to_numpy(), found.column("exact").to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast((qids, holds, total, starts, places, word, weight, exact))
    rows = documents.select("doc_id", "tokens")
    schema = T.StructType().add("qid", questions.schema["qid"].dataType).add("lexical", "double").add("doc_id", rows.schema["doc_id"].dataType)
    qid_arrow = to_arrow_schema(schema).field("qid").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, holds, total, starts, places, word, weight, exact = shared.value
        if not qids:
            return
        step = max(1, CELLS // max(len(holds), len(qids)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                row, code, _, _, seen = grouped(batch.column(1))
                known = np.array([places.get(t, -1) for t in seen.to_pylist()], dtype=np.int64)[code] if len(seen) else code
                row, known = row[known >= 0], known[known >= 0]
                sizes = starts[known + 1] - starts[known]
                # each token's run of matches, one after the other
                match = np.repeat(starts[known] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(known) else known
                row = np.repeat(row, sizes)
                best = np.zeros((batch.num_rows, len(holds)))
                np.maximum.at(best, (row, word[match]), weight[match])
                same = exact[match]
                best[row[same], word[match[same]]] = weight[match[same]]
                scores = (best @ holds / total).T
                q, d = first_k(np.round(scores, 6), batch.column(0).to_pylist(), k, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q], qid_arrow), pa.array(scores[q, d], pa.float64()), batch.column(0).take(pa.array(d))], names=["qid", "lexical", "doc_id"])

    return rows.mapInArrow(run, schema)
