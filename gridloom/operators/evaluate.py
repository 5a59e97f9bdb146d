"""Evaluation: hit ranks, Recall@k, MRR@k and exact match, all samples at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_hit(section: Column, source: Column, golden_sections: Column, golden_sources: Column) -> Column:
    """Golden sections decide where given (contained, any case), else golden sources."""
    by_section = F.exists(golden_sections, lambda g: F.contains(F.lower(section), F.lower(g)))
    return F.coalesce(F.when(F.size(golden_sections) > 0, by_section).otherwise(F.array_contains(golden_sources, source)), F.lit(False))


def hit_ranks(samples: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(qid, hit_rank): the first hit of each sample, or null."""
    joined = samples.select("qid", "golden_sections", "golden_sources").join(retrieved.select("qid", "rank", "section", "source"), "qid", "left")
    hit = is_hit(F.col("section"), F.col("source"), F.col("golden_sections"), F.col("golden_sources"))
    return joined.groupBy("qid").agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))


def recall_at_k(rank: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mrr_at_k(rank: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0)), F.lit(0.0))


def report(results: DataFrame, k: int, dataset: str = "") -> DataFrame:
    """One row of aggregates over results (hit_rank, answer_correct or null where not generated)."""
    made = F.count("answer_correct")
    right = F.count_if(F.col("answer_correct"))
    return results.agg(
        F.lit(dataset).alias("dataset"), F.lit(k).alias("top_k"), F.count("*").alias("num_samples"), recall_at_k(F.col("hit_rank"), k).alias("recall_at_k"), mrr_at_k(F.col("hit_rank"), k).alias("mrr_at_k"),
        made.alias("num_generated"), F.when(made > 0, right / made).alias("exact_match"),
    )


def format_report(summary: dict, results: list[dict]) -> str:
    """The report as text: aggregates, then a line for each sample."""
    rule = "-" * 60
    em = "not generated" if summary["exact_match"] is None else f"{summary['exact_match']:.1%} of {summary['num_generated']}"
    head = [f"{summary['dataset'] or 'evaluation'}: {summary['num_samples']} samples", f"recall@{summary['top_k']} {summary['recall_at_k']:.1%}, mrr@{summary['top_k']} {summary['mrr_at_k']:.3f}, exact match {em}", rule]
    body = []
    for r in results:
        place = f"hit {r['hit_rank']}" if r.get("hit_rank") else "miss"
        state = f" error {r['error'][:40]}" if r.get("error") else "" if r.get("answer_correct") is None else " right" if r["answer_correct"] else " wrong"
        body.append(f"{place}{state}: {r['question'][:80]}")
    return "\n".join([*head, *body, rule])
