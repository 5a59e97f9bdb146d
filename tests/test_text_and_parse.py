"""Parsing, chunking and summaries on documents with the awkward shapes."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import chunk, parse, summary
from gridloom.sources.documents import inline_documents

MIXED = """Opening words of the export.

==========
NORTH - weekly (usd)
==========
Figures below were corrected on Monday.

store\tday\tunits\trevenue
N-1\t2025-06-14\t12\t1200.50
N-2\t2025-06-14\t7\t 700.25
N-1\t2025-06-21\t\t300

key=value
other = thing, more

=====
EUROPE
=====
| store | units |
|:---|---:|
| DE-1 | 5 |
| FR-2 |  |
========
AS PLAIN
========
a,b,c
1,2,
3,4,5

a | b
no pipe here

=====
END
=====
"""


def blocks_of(spark, *texts):
    return parse.parse_documents(inline_documents(spark, list(texts))).orderBy("seq").collect()


def sections_of(spark, value):
    return [(s.title, s.body) for s in spark.createDataFrame([(value,)], "t string").select(parse.sections(F.col("t"))).first()[0]]


def test_banner_sections(spark):
    got = sections_of(spark, MIXED)
    assert [t for t, _ in got] == ["(preamble)", "NORTH - weekly (usd)", "EUROPE", "AS PLAIN", "END"]
    assert got[-1][1] == "" and got[0][1] == "Opening words of the export."


def test_untitled_between_banners(spark):
    assert sections_of(spark, "====\none\ntwo\n====\nT\n====\nbody") == [("(untitled)", "one\ntwo"), ("T", "body")]
    assert sections_of(spark, "====\n\n====\n\n====") == [("(document)", "====\n\n====\n\n====")]
    assert sections_of(spark, "=== SALES ===\nx")[0][0] == "(document)"


def test_rule_sections_and_fallback(spark):
    assert sections_of(spark, "# First\nx\n---\nSecond\ny\n---\n ") == [("First", "# First\nx"), ("Second", "Second\ny")]
    assert sections_of(spark, " only one \n") == [("(document)", "only one")]
    assert sections_of(spark, "") == [("(document)", "")]


def test_blocks_of_a_mixed_document(spark):
    got = blocks_of(spark, MIXED)
    tables = [b for b in got if b.kind == "table"]
    assert [(b.section, b.source_format, len(b.rows), len(b.headers)) for b in tables] == [("NORTH - weekly (usd)", "tsv", 3, 4), ("EUROPE", "pipe", 2, 2), ("AS PLAIN", "csv", 2, 3)]
    assert tables[0].context_notes == "Figures below were corrected on Monday.\n\nkey=value\nother = thing, more"
    assert tables[0].rows[1] == ["N-2", "2025-06-14", "7", "700.25"] and tables[1].rows[1] == ["FR-2", ""] and tables[2].rows[0] == ["1", "2", ""]
    assert tables[1].context_notes == "" and tables[2].context_notes == "a | b\nno pipe here"
    assert tables[1].markdown == "| store | units |\n| --- | --- |\n| DE-1 | 5 |\n| FR-2 |  |"
    assert len({b.doc_id for b in got}) == len(got) and [b.doc_id for b in got] == [b.doc_id for b in blocks_of(spark, MIXED)]


@pytest.mark.parametrize("lines", ["a sentence, with commas\nanother one, as well", "k=v\nl=w", "a\tb\nc", "a|b", "a,b\n1,2,3", "x y,z\n1,2"])
def test_not_a_table(spark, lines):
    assert [b.kind for b in blocks_of(spark, lines)] == ["text"]


@pytest.mark.parametrize(("lines", "kind"), [("a|b\n1|2", "pipe"), ("| a | b |\n| 1 | 2 |", "pipe"), ("a\tb\n1\t2", "tsv"), ("a,b\n1,2\n3,", "csv"), ("a|b\n---|---\n1|2", "pipe")])
def test_a_table(spark, lines, kind):
    (b,) = blocks_of(spark, lines)
    assert b.kind == "table" and b.source_format == kind and b.headers == ["a", "b"] and b.rows[0] == ["1", "2"]


def test_line_ends_and_null_text(spark):
    got = blocks_of(spark, "a,b\r\n1,2\r3,4\u20285,6")
    assert got[0].rows == [["1", "2"], ["3", "4"], ["5", "6"]]
    assert parse.parse_documents(spark.createDataFrame([("s", None)], "source string, text string")).count() == 0


def table_block(spark, n, **more):
    rows = "\n".join(f"{i},v{i}" for i in range(n))
    return parse.parse_documents(inline_documents(spark, [f"====\nT\n====\nnote\n\nid,value\n{rows}"])).where("kind = 'table'")


def test_table_slices(spark):
    got = chunk.chunk_tables(table_block(spark, 120)).orderBy("seq").collect()
    assert [b.section for b in got] == ["T (rows 1-50)", "T (rows 51-100)", "T (rows 101-120)"]
    assert all(b.headers == ["id", "value"] and b.context_notes == "note" and b.markdown.startswith("| id | value |") for b in got)
    over = chunk.chunk_tables(table_block(spark, 100), 50, 10).orderBy("seq").collect()
    assert [b.rows[0][0] for b in over] == ["0", "40", "80"] and [b.section for b in over][-1] == "T (rows 81-100)"
    assert chunk.chunk_tables(table_block(spark, 50)).first().section == "T"
    budget = chunk.chunk_tables(table_block(spark, 100), max_words=20).collect()
    assert max(len(b.rows) for b in budget) <= 9 and sum(len(b.rows) for b in budget) == 100
    with pytest.raises(ValueError):
        chunk.chunk_tables(table_block(spark, 5), 5, 5)


def test_text_slices(spark):
    words = [f"w{i}" + ("." if i % 10 == 9 else "") for i in range(900)]
    blocks = parse.parse_documents(inline_documents(spark, [" ".join(words)]))
    got = chunk.chunk_text(blocks).orderBy("seq").collect()
    assert [b.section for b in got] == [f"(document) (part {i}/3)" for i in (1, 2, 3)]
    assert " ".join(b.content for b in got).split() == words
    over = chunk.chunk_text(blocks, 300, 50).orderBy("seq").collect()
    assert over[1].content.split()[:50] == over[0].content.split()[-50:]
    assert chunk.chunk_text(blocks, 1000).first().section == "(document)"
    long = chunk.chunk_text(parse.parse_documents(inline_documents(spark, ["x " * 700]))).collect()
    assert [len(b.content.split()) for b in long] == [300, 300, 100]
    with pytest.raises(ValueError):
        chunk.chunk_text(blocks, 10, 10)


def test_summaries(spark):
    (b,) = summary.summarize(table_block(spark, 50)).collect()
    lines = b.summary.split("\n")
    assert lines[:3] == ["Table from section: T.", "Columns: id, value.", "50 rows."] and lines[-1] == "Notes: note"
    assert lines[3] == "id values: " + ", ".join(map(str, range(24))) + "."
    prose = parse.parse_documents(inline_documents(spark, ["y" * 5000]))
    assert summary.summarize(prose).first().summary == "Section: (document).\n" + "y" * 1200
    assert summary.summarize(prose, F.lit("own")).first().summary == "own"
    assert summary.summarize(prose, lambda block: block[:15]).first().summary == "### (document)\n"


def test_identifiers(spark):
    values = ["North America — rollup", "net_rev_usd", "123abc", "", "  ", "ÄÖ", "x" * 80]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.sanitized(F.col("v"))).collect()]
    assert got == [text.identifier(v) for v in values] == ["north_america_rollup", "net_rev_usd", "col_123abc", "col", "col", "col", "x" * 60]
    row = spark.createDataFrame([("NET_rev.usd x-1",)], "v string").select(text.lexical_tokens(F.col("v")), text.plain_tokens(F.col("v"))).first()
    assert row[0] == ["net_rev.usd", "net", "rev", "usd", "x-1", "x", "1"] and row[1] == ["net_rev", "usd", "x", "1"]


def test_cut_points_by_hand():
    assert chunk.cut_points([3, 5, 9], 5, 0) == [(0, 5), (5, 9)]
    assert chunk.cut_points([3, 6, 9, 12], 4, 2) == [(0, 3), (1, 6), (4, 9), (7, 12)]
    assert chunk.cut_points([4, 8, 10], 4, 0) == [(0, 4), (4, 8), (8, 10)] and chunk.cut_points([], 4, 1) == []


def test_pack_words_keeps_every_word():
    import random

    rng = random.Random(1)
    for _ in range(200):
        held = " ".join(rng.choice(["a", "bb.", "c!", "dd?", "e"]) for _ in range(rng.randint(0, 60)))
        for budget, overlap in ((5, 0), (7, 3), (1, 0)):
            parts = chunk.pack_words(held, budget, overlap)
            if not overlap:
                assert " ".join(parts) == held and all(len(p.split()) <= budget for p in parts)
            for left, right in zip(parts, parts[1:], strict=False):
                carried = left.split()[-overlap:] if overlap else []
                assert right.split()[: len(carried)] == carried
