"""Command line: baseline and pipeline answers over a file, and offline evaluation."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from .operators.evaluate import format_report
from .plans.generate import CallableGenerator, EchoGenerator, Generator, named_function
from .plans.pipeline import Computing, TablePipeline, run_baseline
from .session import local_session
from .sources import evalsets
from .sources.documents import read_documents, read_questions

Answer = TypeVar("Answer")


def with_retries(call: Callable[[], Answer], attempts: int = 4, wait: float = 2.0) -> Answer:
    """Call again after a growing pause where a service limits its rate."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if "429" not in str(e) or i == attempts - 1:
                raise
            time.sleep(wait * (i + 1))
    raise AssertionError


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("ask", "baseline", "compare", "tables"):
        mode = modes.add_parser(name)
        mode.add_argument("path")
        if name in ("ask", "baseline"):
            mode.add_argument("question")
        if name == "compare":
            mode.add_argument("questions", help="a file of questions, one a line")
    evaluation = modes.add_parser("evaluate", help="score retrieval (and answers) on a set of samples")
    evaluation.add_argument("--samples", help="JSON lines of samples; without it the built-in ten questions")
    evaluation.add_argument("--contexts", help="folder of text files that the samples are about")
    evaluation.add_argument("--generate", action="store_true", help="answer the questions and match the answers")
    evaluation.add_argument("--no-compute", action="store_true", help="without the SQL route")
    evaluation.add_argument("--pause", type=float, default=0.0, help="seconds between answers")
    evaluation.add_argument("--out", help="write the report as JSON to this file")
    for mode in modes.choices.values():
        mode.add_argument("-k", type=int, default=3)
    args = parser.parse_args(argv)
    spark = local_session()
    if args.mode == "evaluate":
        return evaluate(spark, args)
    generator = generator_of_env()
    if args.mode == "baseline":
        print(with_retries(lambda: run_baseline(spark, whole_text(spark, args.path), args.question, generator, args.k)[0]))
        return 0
    pipeline = TablePipeline(spark, generator)
    pipeline.ingest_path(args.path)
    if args.mode == "tables":
        print(pipeline.sandbox.schema_description())
    elif args.mode == "ask":
        result = with_retries(lambda: pipeline.query(args.question, args.k))
        print(f"[{result.route}] {result.answer}")
    else:
        text = whole_text(spark, args.path)
        for q in read_questions(spark, args.questions).orderBy("qid").collect():
            plain = with_retries(lambda: run_baseline(spark, text, q.question, generator, args.k)[0])
            result = with_retries(lambda: pipeline.query(q.question, args.k))
            print(f"{q.question}\n  baseline: {plain}\n  pipeline [{result.route}]: {result.answer}")
    return 0


def whole_text(spark: SparkSession, path: str) -> str:
    """The text that the baseline works on: one file, or all of a folder."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def generator_of_env() -> Generator:
    named = named_function("GRIDLOOM_GENERATOR")
    return CallableGenerator(named) if named else EchoGenerator()


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.samples:
        samples, contexts = evalsets.read_samples(spark, args.samples), read_documents(spark, args.contexts)
    else:
        samples, contexts = evalsets.builtin(spark)
    pipeline = TablePipeline(spark, generator_of_env(), computing=Computing(enabled=not args.no_compute))
    results, total = pipeline.evaluate(samples, contexts, args.k, args.generate, dataset=args.samples or "orchard", pause=args.pause)
    summary, rows = total.first().asDict(), [r.asDict() for r in results.orderBy("qid").collect()]
    print(format_report(summary, rows))
    if args.out:
        with open(args.out, "w", encoding="utf-8") as out:
            json.dump(summary | {"results": rows}, out, indent=2, ensure_ascii=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
