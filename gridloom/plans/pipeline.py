"""The pipeline: ingest documents, answer questions, evaluate; and the retriever for other frameworks."""

from __future__ import annotations

import functools
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.match import answer_match
from ..operators.chunk import chunk_blocks
from ..operators.embed import CallableEmbedder, Embedder
from ..operators.evaluate import hit_ranks, report
from ..operators.index import DualIndex, StoreBackend
from ..operators.parse import parse_documents
from ..operators.route import choose_route, classify
from ..operators.summary import rendered
from ..operators.tfidf import chunks, retrieve
from ..sources.documents import INLINE, documents_of, inline_documents, read_documents
from ..sources.staging import materialize
from .agent import SQLAgent
from .generate import CallableGenerator, Generator, MissingGenerator, baseline_prompt, build_prompt, named_function
from .sandbox import TableSandbox


@dataclass
class QueryResult:
    query: str
    answer: str
    route: str
    retrieved: list = field(default_factory=list)
    sql: str | None = None
    sql_result: list[dict] | None = None
    prompt: str = ""
    model: str = ""


@dataclass(frozen=True)
class Budgets:
    """Sizes of the slices that are indexed."""

    table_rows: int = 50
    table_overlap: int = 0
    table_words: int | None = None
    text_words: int = 300
    text_overlap: int = 0

    def cut(self, blocks: DataFrame) -> DataFrame:
        return chunk_blocks(blocks, self.table_rows, self.table_overlap, self.table_words, self.text_words, self.text_overlap)


@dataclass(frozen=True)
class Retrieval:
    """How blocks are summarized, embedded and found; ``backend`` goes before ``store``, without both the own index searches."""

    embedder: Embedder | None = None
    similarity: str = "cosine"
    lexical_weight: float = 0.5
    backend: object = None
    store: object = None
    summarizer: Column | Callable[[str], str] | None = None

    def index(self, spark: SparkSession) -> DualIndex:
        backend = self.backend or (StoreBackend(self.store) if self.store is not None else None)
        return DualIndex(spark, self.embedder, self.lexical_weight, backend, self.similarity, self.summarizer)


@dataclass(frozen=True)
class Computing:
    """The SQL side: whether tables are loaded, and what the agent is told."""

    enabled: bool = True
    instructions: str | None = None
    examples: list[tuple[str, str]] | None = None
    template: str | None = None
    retries: int = 1


@dataclass(frozen=True)
class Answering:
    """The answer prompt: its opening, or a function that builds all of it."""

    system: str | None = None
    builder: Callable[..., str] | None = None


@dataclass(frozen=True)
class Routing:
    """A classifier of questions, or patterns put to and taken from the default one."""

    classifier: Callable[[str], str] | None = None
    extra: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()

    def __call__(self, question: str) -> str:
        return self.classifier(question) if self.classifier else classify(question, self.extra, self.disabled)


class TablePipeline:
    """Parse, chunk, index and load documents; route, retrieve, compute and answer questions."""

    def __init__(self, spark: SparkSession, generator: Generator | None = None, *, budgets: Budgets = Budgets(), retrieval: Retrieval = Retrieval(), computing: Computing = Computing(), answering: Answering = Answering(), routing: Routing = Routing()):
        self.spark, self.budgets, self.answering, self.routing = spark, budgets, answering, routing
        self.generator = generator or MissingGenerator()
        self.index = retrieval.index(spark)
        self.sandbox = TableSandbox(spark) if computing.enabled else None
        self.sql_agent = SQLAgent(self.sandbox, self.generator, computing.instructions, computing.examples, computing.template, computing.retries) if computing.enabled else None
        self.calls = 0

    @classmethod
    def from_env(cls, spark: SparkSession, **options) -> TablePipeline:
        """A pipeline whose model functions are named (``module:function``) by GRIDLOOM_GENERATOR and GRIDLOOM_EMBEDDER."""
        embedder = named_function("GRIDLOOM_EMBEDDER")
        if embedder is not None:
            options["retrieval"] = replace(options.get("retrieval", Retrieval()), embedder=CallableEmbedder(embedder))
        generator = named_function("GRIDLOOM_GENERATOR")
        return cls(spark, CallableGenerator(generator) if generator else None, **options)

    def parse(self, docs: DataFrame) -> DataFrame:
        return parse_documents(docs)

    def chunk(self, blocks: DataFrame) -> DataFrame:
        return self.budgets.cut(blocks)

    def index_blocks(self, blocks: DataFrame, sandbox_tables: DataFrame | None = None) -> None:
        self.index.add_blocks(blocks)
        if sandbox_tables is not None and self.sandbox is not None:
            self.sandbox.load_tables(sandbox_tables)

    def ingest(self, given: DataFrame | os.PathLike | str, source: str = INLINE) -> DataFrame:
        """Index documents in chunks and load their whole tables; the chunks.

        ``given`` is a DataFrame (source, text), a path, or a text; documents of a later
        call come after those of earlier ones, and replace only what has their identity.
        """
        return self._ingest(documents_of(self.spark, given, source))

    def _ingest(self, docs: DataFrame) -> DataFrame:
        seq = F.col("doc_seq") if "doc_seq" in docs.columns else F.lit(0)
        blocks = self.parse(docs.withColumn("doc_seq", F.lit(self.calls << 40) + seq))
        self.calls += 1
        cut = self.chunk(blocks)
        self.index_blocks(cut, blocks)
        return cut

    def ingest_path(self, path: str) -> DataFrame:
        return self._ingest(read_documents(self.spark, path))

    def ingest_text(self, *texts: str, source: str = INLINE) -> DataFrame:
        return self._ingest(inline_documents(self.spark, list(texts), source))

    ingest_tables = ingest_text

    def retrieve(self, questions: DataFrame, top_k: int = 3) -> DataFrame:
        return self.index.search(questions, top_k)

    def query(self, question: str, top_k: int = 3, system_prompt: str | None = None, route: str | None = None) -> QueryResult:
        """Answer one question; retrieval happens on every route, the final route is hybrid or lookup."""
        tried = self._route(question, route)
        found = []
        if self.index.segments:
            asked = self.spark.createDataFrame([(0, question)], "qid int, question string")
            found = self.retrieve(asked, top_k).withColumn("rendered", rendered()).orderBy("rank").collect()
        return self._answer(question, tried, found, system_prompt)

    def _route(self, question: str, forced: str | None = None) -> str:
        return choose_route(question, len(self.sandbox) if self.sandbox is not None else 0, forced, self.routing)

    def _answer(self, question: str, tried: str, found: list, system: str | None = None) -> QueryResult:
        sql, rows = self.sql_agent.answer(question) if tried == "compute" else (None, None)
        context = "\n\n---\n\n".join(r.rendered for r in found)
        prompt = build_prompt(question, context, sql, rows, system or self.answering.system, self.answering.builder)
        answer = self.generator.generate(prompt)
        return QueryResult(question, answer, "hybrid" if sql else "lookup", found, sql, rows, prompt, getattr(self.generator, "model", ""))

    def evaluate(self, samples: DataFrame, contexts: DataFrame, top_k: int = 3, generate: bool = False, rel_tol: float = 0.01, dataset: str = "", pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
        """(results, one row of aggregates) of samples over contexts (source, text).

        All samples are retrieved in one plan; where that fails, each by itself, so that
        one sample's error stays its own.  With ``generate`` each question is answered
        from what was retrieved, with ``pause`` seconds between calls; a sample with an
        error has no answer and does not count for exact match.
        """
        self._ingest(contexts)
        found, failed = self._retrieved(samples, top_k)
        results = samples.join(hit_ranks(samples, found), "qid")
        blocks = F.array_sort(F.collect_list(F.struct("rank", "kind", "source", "section", rendered().alias("rendered"))))
        found, _ = materialize(found.groupBy("qid").agg(blocks.alias("found")), "retrieved")
        if not generate:
            said = self.spark.createDataFrame([(q, None, None, None, e) for q, e in failed], SAID)
        else:
            said = self.spark.createDataFrame(list(self._said(samples.select("qid", "question").join(found, "qid", "left"), dict(failed), pause)), SAID)
        correct = F.when(F.col("prediction").isNotNull(), answer_match(F.col("prediction"), F.col("answers"), F.col("require_all"), rel_tol))
        named = F.transform("found", lambda b: F.concat_ws(":", b["kind"], b["source"], F.substring(b["section"], 1, 50)))
        results = results.join(found.select("qid", named.alias("retrieved")), "qid", "left").join(said, "qid", "left").withColumn("answer_correct", correct)
        results, _ = materialize(results, "results")
        return results, report(results, top_k, dataset)

    def _retrieved(self, samples: DataFrame, top_k: int) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Blocks of all samples, and (qid, error) of samples whose retrieval failed."""
        asked = samples.select("qid", "question")
        try:
            return materialize(self.retrieve(asked, top_k), "found")[0], []
        except Exception:
            parts, failed = [], []
            for s in asked.toLocalIterator():
                try:
                    parts.append(materialize(self.retrieve(asked.where(F.col("qid") == s.qid), top_k), "found")[0])
                except Exception as e:
                    failed.append((s.qid, str(e)))
            if not parts:
                raise
            return functools.reduce(DataFrame.unionByName, parts), failed

    def _said(self, asked: DataFrame, failed: dict[str, str], pause: float) -> Iterator[tuple]:
        """(qid, prediction, route, sql, error) of each sample, one after the other."""
        for s in asked.toLocalIterator():
            if s.qid in failed:
                yield s.qid, None, None, None, failed[s.qid]
                continue
            try:
                r = self._answer(s.question, self._route(s.question), s.found or [])
                yield s.qid, r.answer, r.route, r.sql, None
            except Exception as e:
                yield s.qid, None, None, None, str(e)
            time.sleep(pause)


SAID = "qid string, prediction string, route string, sql string, error string"


class RetrieverManager:
    """Ingest and search without answers, results as plain dicts (the contract of retriever adapters).

    With a ``store`` the store alone ranks: its raw scores, no lexical blend, and its
    documents that are not ours are passed through.
    """

    def __init__(self, spark: SparkSession, store=None, *, budgets: Budgets = Budgets(), retrieval: Retrieval = Retrieval()):
        self.store = StoreBackend(store) if store is not None else None
        self.pipeline = TablePipeline(spark, budgets=budgets, retrieval=replace(retrieval, store=store), computing=Computing(enabled=False))

    def ingest(self, given: DataFrame | os.PathLike | str) -> DataFrame:
        return self.pipeline.ingest(given)

    def ingest_tables(self, raw: list[str]) -> DataFrame:
        return self.pipeline.ingest_text(*raw)

    def search(self, question: str, k: int = 3) -> list[dict]:
        if self.store is not None:
            return self._from_store(question, k)
        asked = self.pipeline.spark.createDataFrame([(0, question)], "qid int, question string")
        found = self.pipeline.retrieve(asked, k).withColumn("rendered", rendered()).orderBy("rank").collect()
        return [as_document(r, r.score) for r in found]

    def _from_store(self, question: str, k: int) -> list[dict]:
        hits = self.store.hits(question, k, relevance=False)
        ids = [hit.metadata.get("doc_id") for hit, _ in hits]
        blocks = self.pipeline.index.blocks
        own = {} if blocks is None else {r.doc_id: r for r in blocks.where(F.col("doc_id").isin([i for i in ids if i])).withColumn("rendered", rendered()).collect()}
        return [as_document(own[i], score) if i in own else {"page_content": hit.page_content, "metadata": dict(hit.metadata)} for i, (hit, score) in zip(ids, hits, strict=True)]

    def as_retriever(self, k: int = 3) -> Callable[[str], list[dict]]:
        return lambda question: self.search(question, k)


def as_document(block, score: float | None) -> dict:
    """A rendered block as adapters hand it on; without a score it has none."""
    metadata = {"doc_id": block.doc_id, "kind": block.kind, "section": block.section, "source": block.source}
    return {"page_content": block.rendered, "metadata": metadata | ({} if score is None else {"score": score})}


def run_baseline(spark: SparkSession, text: str, question: str, generator: Generator, k: int = 3, scikit: bool = False) -> tuple[str, list]:
    """The TF-IDF baseline on one text: chunk, retrieve, prompt, generate."""
    parts = spark.createDataFrame([(text,)], "text string").select(F.posexplode(chunks(F.col("text"))).alias("seq", "text")).withColumn("doc_id", F.col("seq"))
    asked = spark.createDataFrame([(0, question)], "qid int, question string")
    found = retrieve(asked, parts, k, scikit).join(parts.select("doc_id", "text"), "doc_id").orderBy("rank").collect()
    return generator.generate(baseline_prompt(question, [r.text for r in found])), found
