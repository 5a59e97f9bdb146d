"""Documents to sections to prose and table blocks.

Everything is a column expression on one document row, so parsing is a narrow
projection: no shuffle, no Python, and context notes need no join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lines, rtrim, trim
from ..sources.documents import text_key

SECTIONS = "array<struct<title:string,body:string>>"
TABLE = "struct<format:string,headers:array<string>,rows:array<array<string>>>"
#: the columns of a block
BLOCK = ["doc_id", "source", "seq", "section_idx", "para_idx", "kind", "section", "content", "markdown", "headers", "rows", "source_format", "context_notes"]


def _between(all_lines: Column, first: Column, upto: Column) -> Column:
    """Trimmed text of lines ``first`` to ``upto - 1``, counted from 0."""
    return trim(F.array_join(F.slice(all_lines, first + 1, F.greatest(upto - first, F.lit(0))), "\n"))


def _section(title: Column, body: Column) -> Column:
    return F.struct(title.alias("title"), body.alias("body"))


def banner_sections(text: Column) -> Column:
    """Sections between lines of four or more ``=``; empty where there are fewer than two.

    A fold over the banners: a pair around exactly one line of text is a title and its
    body runs to the next banner, any other pair encloses untitled text.
    """

    def of(all_lines: Column, marks: Column) -> Column:
        n = F.size(marks)
        at = lambda j: F.get(marks, j)

        def step(state: Column, i: Column) -> Column:
            start, end = at(i), at(i + 1)
            inside = F.filter(F.slice(all_lines, start + 2, F.greatest(end - start - 1, F.lit(0))), lambda x: trim(x) != "")
            titled = (F.size(inside) == 1) & (end - start <= 2)
            body = F.when(titled, _between(all_lines, end + 1, F.coalesce(at(i + 2), F.size(all_lines)))).otherwise(_between(all_lines, start + 1, end))
            title = F.when(titled, trim(F.get(inside, F.lit(0)))).otherwise("(untitled)")
            more = F.when(titled | (body != ""), F.array(_section(title, body))).otherwise(F.array().cast(SECTIONS))
            moved = F.struct((i + F.when(titled, 2).otherwise(1)).cast("int").alias("next"), F.concat(state["found"], more).alias("found"))
            return F.when(i < state["next"], state).otherwise(moved)

        before = _between(all_lines, F.lit(0), at(F.lit(0)))
        opening = F.when(before != "", F.array(_section(F.lit("(preamble)"), before))).otherwise(F.array().cast(SECTIONS))
        folded = F.aggregate(F.sequence(F.lit(0), n - 2), F.struct(F.lit(0).alias("next"), opening.alias("found")), step, lambda s: s["found"])
        return F.when(n < 2, F.array().cast(SECTIONS)).otherwise(folded)

    def marked(all_lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.size(all_lines) - 1, F.lit(0)))
        marks = F.filter(every, lambda i: F.coalesce(F.get(all_lines, i).rlike(r"(?U)^={4,}\s*$"), F.lit(False)))
        return let(marks, lambda m: of(all_lines, m))

    return let(lines(text), marked)


def rule_sections(text: Column) -> Column:
    """Sections between ``---`` lines; empty where there are fewer than two parts."""
    parts = F.filter(F.transform(F.split(text, "\n---\n", -1), trim), lambda p: p != "")

    def section(part: Column) -> Column:
        first = trim(F.get(lines(part), F.lit(0)))
        return _section(F.when(first.startswith("#"), trim(F.regexp_replace(first, "^[# ]+", ""))).otherwise(first), part)

    return let(parts, lambda p: F.when(F.size(p) < 2, F.array().cast(SECTIONS)).otherwise(F.transform(p, section)))


def sections(text: Column) -> Column:
    """Banner sections, else rule sections, else one section ``(document)``."""
    whole = F.array(_section(F.lit("(document)"), trim(text)))
    return let(banner_sections(text), lambda b: F.when(F.size(b) > 0, b).otherwise(let(rule_sections(text), lambda r: F.when(F.size(r) > 0, r).otherwise(whole))))


def paragraphs(body: Column) -> Column:
    """Runs of lines that are not blank, each an array of lines."""
    flat = F.array_join(F.transform(lines(body), lambda x: F.when(trim(x) == "", "").otherwise(x)), "\n")
    return F.transform(F.filter(F.split(F.regexp_replace(flat, r"^\n+|\n+\z", ""), r"\n\n+"), lambda p: p != ""), lambda p: F.split(p, "\n", -1))


def is_separator_row(line: Column) -> Column:
    return line.rlike(r"(?U)^[\s|:\-]+$") & line.contains("-")


def pipe_cells(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(trim(line), r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(bare, r"\|", -1), trim)


def _grid(kind: str, rows: Column, fits: Column) -> Column:
    """A table of ``rows`` if it fits, has two columns or more and is rectangular; else null."""

    def of(r: Column) -> Column:
        width = F.size(F.get(r, F.lit(0)))
        square = (width >= 2) & F.forall(r, lambda x: F.size(x) == width)
        made = F.struct(F.lit(kind).alias("format"), F.get(r, F.lit(0)).alias("headers"), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))).alias("rows"))
        return F.when(fits & (F.size(r) >= 2) & square, made)

    return let(rows, of)


def pipe_table(paragraph: Column) -> Column:
    def of(data: Column) -> Column:
        return _grid("pipe", F.transform(data, pipe_cells), F.forall(data, lambda x: x.contains("|")))

    return let(F.filter(paragraph, lambda x: ~is_separator_row(x)), of)


def tsv_table(paragraph: Column) -> Column:
    return _grid("tsv", F.transform(paragraph, lambda x: F.transform(F.split(x, "\t", -1), trim)), F.forall(paragraph, lambda x: x.contains("\t")))


def csv_table(paragraph: Column) -> Column:
    """Comma tables without quoting; header cells are short and hold no space."""
    rows = F.transform(paragraph, lambda x: F.transform(F.split(x, ",", -1), trim))
    head = F.transform(F.split(F.get(paragraph, F.lit(0)), ",", -1), trim)
    return _grid("csv", rows, F.forall(head, lambda h: (F.char_length(h) <= 40) & ~h.contains(" ")))


def table_of(paragraph: Column) -> Column:
    """The table that a paragraph is (pipe, then tab, then comma), or null."""
    cleaned = F.filter(F.transform(paragraph, rtrim), lambda x: x != "")
    return let(cleaned, lambda p: F.coalesce(pipe_table(p), tsv_table(p), csv_table(p)))


def markdown(headers: Column, rows: Column) -> Column:
    """The canonical pipe form of a table."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(headers), row(F.transform(headers, lambda _: F.lit("---")))), F.transform(rows, row)), "\n")


def parse_documents(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (source, text, and optionally doc_seq, the order of documents, and doc_key, their identity).

    ``doc_id`` is a hash of the document's identity (its source and text where no
    doc_key is given) and the block's place, so results can be computed again and
    documents of one name stay apart; ``seq`` (an array: document, section, paragraph,
    part) is the order of blocks.
    """
    if "doc_seq" not in docs.columns:
        docs = docs.withColumn("doc_seq", F.lit(0).cast("long"))
    if "doc_key" not in docs.columns:
        docs = docs.withColumn("doc_key", text_key(F.col("source"), F.col("text")))
    split = docs.select("source", "doc_key", F.col("doc_seq").cast("long").alias("doc_seq"), F.posexplode(sections(F.coalesce("text", F.lit("")))).alias("section_idx", "s"))
    pieces = F.transform(paragraphs(F.col("s.body")), lambda p: F.struct(p.alias("lines"), table_of(p).alias("table")))
    split = split.select("source", "doc_key", "doc_seq", "section_idx", F.col("s.title").alias("section"), pieces.alias("pieces"))
    prose = F.transform(F.filter("pieces", lambda x: x["table"].isNull()), lambda x: trim(F.array_join(x["lines"], "\n")))
    split = split.withColumn("notes", F.nullif(F.array_join(prose, "\n\n"), F.lit("")))
    rows = split.select("source", "doc_key", "doc_seq", "section_idx", "section", "notes", F.posexplode("pieces").alias("para_idx", "piece"))
    table, is_table = F.col("piece.table"), F.col("piece.table").isNotNull()
    return rows.select(
        F.sha2(F.concat_ws("\x1f", F.coalesce("doc_key", F.lit("")), "section_idx", "para_idx"), 256).alias("doc_id"),
        "source",
        F.array("doc_seq", F.col("section_idx").cast("long"), F.col("para_idx").cast("long"), F.lit(0).cast("long")).alias("seq"),
        "section_idx",
        "para_idx",
        F.when(is_table, "table").otherwise("text").alias("kind"),
        "section",
        F.when(~is_table, trim(F.array_join("piece.lines", "\n"))).alias("content"),
        F.when(is_table, markdown(table["headers"], table["rows"])).alias("markdown"),
        table["headers"].alias("headers"),
        table["rows"].alias("rows"),
        table["format"].alias("source_format"),
        F.when(is_table, F.coalesce("notes", F.lit(""))).alias("context_notes"),
    )
