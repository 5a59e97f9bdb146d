"""Searchable summaries of blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.python import with_python

MAX_DISTINCT, MAX_CHARS = 24, 1200


def distinct_values(rows: Column, i: Column, most: int = MAX_DISTINCT) -> Column:
    """The first ``most`` distinct values of column ``i``, empty ones left out."""
    return F.slice(F.array_distinct(F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda v: v.isNotNull() & (v != ""))), 1, most)


def table_summary(max_distinct: int = MAX_DISTINCT) -> Column:
    headers, rows = F.col("headers"), F.col("rows")

    def values(header: Column, i: Column) -> Column:
        found = F.array_join(distinct_values(rows, i, max_distinct), ", ")
        return F.when(found != "", F.concat(header, F.lit(" values: "), found, F.lit(".")))

    top = F.array(F.concat(F.lit("Table from section: "), "section", F.lit(".")), F.concat(F.lit("Columns: "), F.array_join(headers, ", "), F.lit(".")), F.concat(F.size(rows).cast("string"), F.lit(" rows.")))
    notes = F.array(F.when(F.coalesce("context_notes", F.lit("")) != "", F.concat(F.lit("Notes: "), "context_notes")))
    return F.array_join(F.array_compact(F.concat(top, F.transform(headers, values), notes)), "\n")


def text_summary(max_chars: int = MAX_CHARS) -> Column:
    content = F.substring("content", 1, max_chars)
    named = (F.coalesce("section", F.lit("")) != "") & ~F.contains(content, F.col("section"))
    return F.when(named, F.concat(F.lit("Section: "), "section", F.lit(".\n"), content)).otherwise(content)


def default_summary(max_distinct: int = MAX_DISTINCT, max_chars: int = MAX_CHARS) -> Column:
    return F.when(F.col("kind") == "table", table_summary(max_distinct)).otherwise(text_summary(max_chars))


def rendered() -> Column:
    """A block as text for a prompt: its section, then table and notes, or content."""
    notes = F.when(F.coalesce("context_notes", F.lit("")) != "", F.concat(F.lit("Notes: "), "context_notes"))
    return F.when(F.col("kind") == "table", F.concat_ws("\n", F.concat(F.lit("### "), "section"), "markdown", notes)).otherwise(F.concat(F.lit("### "), F.col("section"), F.lit("\n"), F.col("content")))


SUMMARY_PROMPT = "Describe this block for a search index. Name its subject, its columns and telling values.\n\n{block}\n\nDescription:"


def summarize(blocks: DataFrame, summarizer: Column | Callable[[str], str] | None = None, generator=None, prompt: str = SUMMARY_PROMPT) -> DataFrame:
    """``blocks`` with ``summary``: by column expression, by a callable on the rendered block, or by a generator."""
    if summarizer is None and generator is None:
        return blocks.withColumn("summary", default_summary())
    if isinstance(summarizer, Column):
        return blocks.withColumn("summary", summarizer)
    call = summarizer or (lambda block: generator.generate(prompt.replace("{block}", block)).strip())

    return with_python(blocks, "summary", rendered(), lambda texts: [call(t) for t in texts], StringType())
