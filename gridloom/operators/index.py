"""The dual index: vectors over summaries, lexical re-ranking, blocks as results."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.python import first_k
from ..functions.text import lexical_tokens
from ..functions.vector import metric
from ..sources.staging import drop, materialize
from .embed import DIMS, Embedder, embed_texts, sparse_vectors
from .lexical import HELD_QUESTIONS, idf, lexical_scores
from .summary import summarize

MULTIPLE, LEAST = 4, 50


def pool_size(k: int) -> int:
    """Candidates that the first phase hands to the second."""
    return max(MULTIPLE * k, LEAST)


def steady(score: str) -> Column:
    """A score to order by: rounded, so that ties do not hang on the order in which doubles were added."""
    return F.round(score, 9).desc()


def ranked(scored: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """Rows of each qid numbered in ``order``, the first ``k`` of them."""
    numbered = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return numbered if k is None else numbered.where(F.col("rank") <= k)


def dense_search(questions: DataFrame, vectors: DataFrame, similarity: str = "cosine", k: int | None = 3, seq: str = "seq") -> DataFrame:
    """(qid, rank, doc_id, semantic): every vector scored for every question, ties in order of ``seq``.

    Questions (qid, v) are a batch of a user, so that side is the one Spark may broadcast.
    """
    score = metric(similarity)(F.col("qv"), F.col("v"))
    both = vectors.crossJoin(questions.select("qid", F.col("v").alias("qv"))).select("qid", "doc_id", seq, score.alias("semantic"))
    return ranked(both, k, steady("semantic"), F.col(seq)).select("qid", "rank", "doc_id", seq, "semantic")


def sparse_search(questions: DataFrame, documents: DataFrame, similarity: str = "cosine", k: int | None = 3, dims: int = DIMS) -> DataFrame:
    """``dense_search`` for sparse unit vectors: questions (qid, idx, w) and documents (doc_id, seq, idx, w) with arrays below ``dims``.

    Documents that share no index with a question score as zeros.  Up to
    ``HELD_QUESTIONS`` questions (counted) go with the tasks as one matrix, and each
    batch of documents passes on its own first ``k`` per question: documents are not
    shuffled.  More questions are joined to documents on shared indices.
    """
    metric(similarity)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot")))
    semantic = 1 / (1 + apart) if similarity == "euclidean" else F.col("dot")
    held = questions.select("qid", "idx", "w").limit(HELD_QUESTIONS + 1).collect() if k is not None else []
    if k is not None and len(held) <= HELD_QUESTIONS:
        dots = _scored(held, questions.schema["qid"].dataType, documents, k, dims)
    else:
        dots = _joined(questions, documents, k)
    return ranked(dots.withColumn("semantic", semantic), k, steady("semantic"), F.col("seq")).select("qid", "rank", "doc_id", "seq", "semantic")


def _joined(questions: DataFrame, documents: DataFrame, k: int | None) -> DataFrame:
    """(qid, doc_id, seq, dot) of documents with a shared index, and of the first others."""
    each = lambda df, key, w: df.select(key, F.explode(F.arrays_zip("idx", "w")).alias("e")).select(key, F.col("e.idx").alias("idx"), F.col("e.w").alias(w))
    dots = each(documents, "doc_id", "dw").join(each(questions, "qid", "qw"), "idx").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("dot"))
    everyone = documents.select("doc_id", "seq")
    fill = everyone if k is None else everyone.orderBy("seq").limit(k)
    ids = questions.select("qid").distinct()
    filled = dots.select("qid", "doc_id", "dot").unionByName(fill.select("doc_id").crossJoin(ids).select("qid", "doc_id", F.lit(0.0).alias("dot")))
    return filled.groupBy("qid", "doc_id").agg(F.max("dot").alias("dot")).join(everyone, "doc_id")


def _scored(held: list, qid_type: T.DataType, documents: DataFrame, k: int, dims: int) -> DataFrame:
    """(qid, dot, doc_id, seq): of each batch of documents the first ``k`` for every question."""
    matrix = np.zeros((len(held), dims))
    for i, r in enumerate(held):
        matrix[i, np.array(r.idx, dtype=np.int64)] = r.w
    ids = [r.qid for r in held]
    rows = documents.select("seq", "doc_id", "idx", "w")
    schema = T.StructType().add("qid", qid_type).add("dot", "double").add("doc_id", rows.schema["doc_id"].dataType).add("seq", rows.schema["seq"].dataType)
    qid_arrow = to_arrow_schema(schema).field("qid").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                idx, w = batch.column(2), batch.column(3)
                dense = np.zeros((batch.num_rows, dims))
                dense[np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(idx.offsets))), np.asarray(idx.flatten())] = np.asarray(w.flatten())
                dots = matrix @ dense.T
                q, d = first_k(dots, batch.column(0).to_pylist(), k)
                picked = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], qid_arrow), pa.array(dots[q, d]), batch.column(1).take(picked), batch.column(0).take(picked)], names=["qid", "dot", "doc_id", "seq"])

    return rows.mapInArrow(run, schema)


class DualIndex:
    """Summaries searched by meaning and by words; the blocks themselves are returned.

    ``add_blocks`` summarizes, tokenizes and embeds its blocks once and writes them as a
    segment of the index; searches read segments.  A block whose doc_id is known
    replaces the older one; of rows with one doc_id in a call one stays.  Document
    frequencies are of the whole index, counted by the first search after an addition.
    """

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, lexical_weight: float = 0.5, backend=None, similarity: str = "cosine", summarizer: Column | Callable[[str], str] | None = None, dims: int = DIMS):
        metric(similarity)
        self.spark, self.embedder, self.lexical_weight, self.backend, self.similarity, self.summarizer, self.dims = spark, embedder, lexical_weight, backend, similarity, summarizer, dims
        self.segments: list[tuple[DataFrame, str]] = []
        self._weights: tuple[DataFrame, str] | None = None

    @property
    def blocks(self) -> DataFrame | None:
        """All blocks with summary, tokens and vectors; None where nothing was added."""
        return functools.reduce(DataFrame.unionByName, (df for df, _ in self.segments)) if self.segments else None

    def add_blocks(self, blocks: DataFrame) -> None:
        new = summarize(blocks.dropDuplicates(["doc_id"]), self.summarizer)
        new = new.withColumn("tokens", F.array_distinct(lexical_tokens(F.coalesce("summary", F.lit("")))))
        # vectors are computed row by row, so they join nothing: the block goes along as one column
        packed = new.select(F.struct(*new.columns).alias("block"), F.col("summary").alias("text"))
        if self.backend is None:
            packed = sparse_vectors(packed, "block", "text", self.dims) if self.embedder is None else embed_texts(packed, self.embedder, "block")
        written, path = materialize(packed.select("block.*", *[c for c in packed.columns if c not in ("block", "text")]), "index")
        kept = []
        for df, old in self.segments:
            if df.join(written.select("doc_id"), "doc_id", "left_semi").isEmpty():
                kept.append((df, old))
                continue
            kept.append(materialize(df.join(written.select("doc_id"), "doc_id", "left_anti").select(*df.columns), "index"))
            drop(self.spark, old)
        self.segments = [*kept, (written, path)]
        if self._weights is not None:
            drop(self.spark, self._weights[1])
            self._weights = None
        if self.backend is not None:
            self.backend.add(written.select("doc_id", "summary"))

    def __len__(self) -> int:
        return sum(df.count() for df, _ in self.segments)

    def close(self) -> None:
        """Delete the written segments."""
        drop(self.spark, *[path for _, path in self.segments], *([self._weights[1]] if self._weights else []))
        self.segments, self._weights = [], None

    def weights(self) -> DataFrame:
        """(token, df, idf) of the whole index."""
        if self._weights is None:
            self._weights = materialize(idf(self.blocks.select(F.explode("tokens").alias("token")), len(self)), "weights")
        return self._weights[0]

    def _candidates(self, questions: DataFrame, k: int | None) -> DataFrame:
        asked = questions.select("qid", F.col("question").alias("text"))
        if self.backend is not None:
            return self.backend.search(questions, k).join(self.blocks.select("doc_id", "seq"), "doc_id")
        if self.embedder is None:
            return sparse_search(sparse_vectors(asked, "qid", "text", self.dims), self.blocks, self.similarity, k, self.dims)
        return dense_search(embed_texts(asked, self.embedder, "qid"), self.blocks, self.similarity, k)

    def search(self, questions: DataFrame, k: int | None = 3) -> DataFrame:
        """(qid, rank, score, semantic, lexical) and the columns of blocks, for questions (qid, question)."""
        w = self.lexical_weight
        found = self._candidates(questions, None if k is None else pool_size(k))
        blocks = self.blocks.drop("idx", "w", "v")
        if w > 0:
            # only candidates' tokens become postings
            among = blocks.select("doc_id", "tokens").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
            posted = among.select("doc_id", F.explode("tokens").alias("token"))
            scores = lexical_scores(questions, posted, self.weights(), found.select("qid", "doc_id"))
            found = found.join(scores, ["qid", "doc_id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
        else:
            found = found.withColumn("lexical", F.lit(0.0))
        found = found.withColumn("score", (1 - w) * F.col("semantic") + w * F.col("lexical")).drop("rank")
        top = ranked(found, k, steady("score"), steady("semantic"), F.col("seq")).drop("seq")
        return top.join(blocks.drop("tokens"), "doc_id")

    def all_scores(self, questions: DataFrame) -> DataFrame:
        return self.search(questions, None)

    def summary_for(self, doc_id: str) -> str:
        row = self.blocks.where(F.col("doc_id") == doc_id).select("summary").first() if self.segments else None
        return row.summary if row else ""


class StoreBackend:
    """An external vector store, called from the driver.

    ``search`` asks for relevance scores, else for the store's raw scores, else for
    documents alone, which score 0; a store may refuse the first with NotImplementedError
    or ValueError.  Hits without a doc_id of ours are left out.
    """

    def __init__(self, store):
        self.store = store

    def add(self, summaries: DataFrame) -> None:
        """Hand over summaries and doc_ids, a batch of rows at a time."""
        batch: list = []

        def send() -> None:
            self.store.add_texts([r.summary for r in batch], metadatas=[{"doc_id": r.doc_id} for r in batch])
            batch.clear()

        for r in summaries.toLocalIterator():
            batch.append(r)
            if len(batch) == 1000:
                send()
        if batch:
            send()

    def hits(self, question: str, k: int, relevance: bool = True) -> list[tuple]:
        """(document, score or None) as the store gives them; ``relevance`` asks for scores of 0 to 1 first."""
        scored = [("similarity_search_with_relevance_scores", (NotImplementedError, AttributeError, ValueError))] if relevance else []
        for name, refusals in [*scored, ("similarity_search_with_score", (NotImplementedError, AttributeError))]:
            try:
                return list(getattr(self.store, name)(question, k=k))
            except refusals:
                continue
        return [(found, None) for found in self.store.similarity_search(question, k=k)]

    def search(self, questions: DataFrame, k: int | None) -> DataFrame:
        """(qid, rank, doc_id, semantic); questions are asked one by one, as the store has no other way."""
        rows = [(q.qid, 0, hit.metadata["doc_id"], float(score or 0.0)) for q in questions.toLocalIterator() for hit, score in self.hits(q.question, k or 1 << 30) if hit.metadata.get("doc_id")]
        return questions.sparkSession.createDataFrame(rows, f"qid {questions.schema['qid'].dataType.simpleString()}, rank int, doc_id string, semantic double")
