"""Evaluation sets from public record schemas, as (samples, contexts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.parse import markdown

SAMPLE = "qid string, question string, answers array<string>, golden_sources array<string>, golden_sections array<string>, require_all boolean, dataset string"


def _samples(records: DataFrame, answers, source, dataset: str) -> DataFrame:
    return records.select(
        F.col("id").cast("string").alias("qid"), "question", answers.alias("answers"), F.array(source).alias("golden_sources"),
        F.array().cast("array<string>").alias("golden_sections"), F.lit(False).alias("require_all"), F.lit(dataset).alias("dataset"),
    )


def _contexts(named: DataFrame) -> DataFrame:
    """One text for each source: that of the first record by ``ord``."""
    first = named.withColumn("_at", F.row_number().over(Window.partitionBy("source").orderBy("ord")))
    return first.where("_at = 1").select("source", "text")


def wtq(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (id, question, answers, table<name, header, rows>, ord): questions on tables."""
    name = F.coalesce(F.nullif("table.name", F.lit("")), F.concat(F.lit("table-"), F.col("id").cast("string")))
    contexts = records.select(name.alias("source"), markdown(F.col("table.header"), F.col("table.rows")).alias("text"), "ord")
    return _samples(records, F.col("answers").cast("array<string>"), name, "wtq"), _contexts(contexts)


def t2_ragbench(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (id, context_id, question, program_answer, original_answer, context, ord): questions on reports."""
    original = F.nullif(trim(F.coalesce("original_answer", F.lit(""))), F.lit(""))
    answers = F.array_distinct(F.array_compact(F.array(F.col("program_answer").cast("string"), original)))
    source = F.col("context_id").cast("string")
    return _samples(records, answers, source, "t2-ragbench"), _contexts(records.select(source.alias("source"), F.col("context").alias("text"), "ord"))


def own_samples(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Samples written by hand; missing fields take their defaults."""
    full = [(r["qid"], r["question"], r.get("answers", []), r.get("golden_sources", []), r.get("golden_sections", []), r.get("require_all", False), r.get("dataset", "own")) for r in rows]
    return spark.createDataFrame(full, SAMPLE)


#: an export of an invented orchard, with a table of each form and figures that prose corrects
ORCHARD = """Export of the orchard ledger, season 2031.

========
HARVEST BY PLOT (kg)
========
Plot C was weighed twice; the figure below is the second one.

plot\tvariety\tweek\tharvest_kg\tpickers
A\tRusset\t2031-09-06\t1240.5\t6
A\tRusset\t2031-09-13\t980\t5
B\tBramley\t2031-09-06\t2010.25\t9
B\tBramley\t2031-09-13\t1764.75\t8
C\tQuince\t2031-09-13\t310\t2

========
CIDER PRESS
========
| batch | litres | sugar_pct | opened |
| --- | --- | --- | --- |
| P-11 | 820 | 11.4 | 2031-10-02 |
| P-12 | 765 | 12.1 | 2031-10-09 |
| P-13 | 540 | 9.8 | |

========
MARKET STALLS
========
stall,town,takings_eur
S1,Ludlow,1832.40
S2,Hereford,2210.00
S3,Leominster,960.10

========
FROST REPORT
========
Frost struck on 23 April and took about 15 % of the blossom on plot B. Wind machines ran for 31 hours.

========
STAFF NOTES
========
Maren leads the pickers. Otto keeps the press and orders new filters each November."""


def builtin(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Ten questions on one document: sums, extremes, single cells, text, and one that needs two figures."""
    asked = [
        ("What is the total harvest_kg of plot B?", ["3775"], ["HARVEST"]), ("How many pickers worked plot A in the week of 2031-09-06?", ["6"], ["HARVEST"]), ("Which variety grows on plot C?", ["Quince"], ["HARVEST"]),
        ("What is the average sugar_pct of the cider batches?", ["11.1"], ["CIDER"]), ("How many litres does batch P-12 hold?", ["765"], ["CIDER"]), ("Which batch has not been opened?", ["P-13"], ["CIDER"]),
        ("Which stall had the highest takings_eur?", ["S2", "Hereford"], ["MARKET"]), ("When did frost strike?", ["23 April"], ["FROST"]), ("Who keeps the press and orders filters?", ["Otto"], ["STAFF"]),
    ]
    rows = [{"qid": f"orchard-{i:02}", "question": q, "answers": a, "golden_sections": s, "golden_sources": ["orchard"], "dataset": "orchard"} for i, (q, a, s) in enumerate(asked, 1)]
    rows.append({"qid": "orchard-10", "question": "What were the takings in Ludlow and in Leominster?", "answers": ["1832.40", "960.10"], "golden_sections": ["MARKET"], "golden_sources": ["orchard"], "require_all": True, "dataset": "orchard"})
    return own_samples(spark, rows), spark.createDataFrame([("orchard", ORCHARD)], "source string, text string")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from a file of JSON lines; missing fields take their defaults."""
    rows = spark.read.schema(SAMPLE).json(path)
    empty = F.array().cast("array<string>")
    filled = {"answers": F.coalesce("answers", empty), "golden_sources": F.coalesce("golden_sources", empty), "golden_sections": F.coalesce("golden_sections", empty), "require_all": F.coalesce("require_all", F.lit(False)), "dataset": F.coalesce("dataset", F.lit("own"))}
    return rows.withColumns(filled)
