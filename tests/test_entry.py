"""The registered queries against their SQL at the smallest scale, and the boundary around the llm subpackage."""

import ast
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from gridloom import oracles, queries

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    for path in (ROOT / "gridloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def same(df, other):
    import pandas as pd

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        cell = lambda v: "null" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:19]
        return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False))

    return sorted(df.columns) == sorted(other.columns) and rows(df) == rows(other)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in queries.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.queries()[name](spark, SMALL).toPandas()
    assert same(got, connection.execute(oracles.oracle_sql()[name]).df())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
