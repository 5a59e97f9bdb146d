"""Typed temporary views of parsed tables, and guarded SELECTs over them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier, trim
from ..sources.staging import drop, new_path
from .guard import check, missing_features

INTEGER, DECIMAL, DATE = r"^-?\d+$", r"^-?\d+\.\d+$", r"^\d{4}-\d{2}-\d{2}$"


def inferred_type(value: Column) -> Column:
    """Aggregate: the type of all values that are not blank; a value that cannot be cast makes it a string."""
    value = F.nullif(trim(value), F.lit(""))
    holds = lambda test: F.coalesce(F.bool_and(F.when(value.isNotNull(), test)), F.lit(False))
    return (
        F.when(holds(value.rlike(INTEGER) & value.try_cast("bigint").isNotNull()), "BIGINT")
        .when(holds((value.rlike(INTEGER) | value.rlike(DECIMAL)) & value.try_cast("double").isNotNull()), "DOUBLE")
        .when(holds(value.rlike(DATE) & value.try_cast("date").isNotNull()), "DATE")
        .otherwise("STRING")
    )


def column_types(blocks: DataFrame) -> DataFrame:
    """(doc_id, col, type) of all table blocks in one pass."""
    cells = blocks.where("kind = 'table'").select("doc_id", F.posexplode("headers").alias("col", "header"), "rows")
    typed = cells.select("doc_id", "col", F.explode_outer("rows").alias("row"), ).select("doc_id", "col", F.get("row", F.col("col")).alias("value"))
    return typed.groupBy("doc_id", "col").agg(inferred_type(F.col("value")).alias("type"))


def column_names(headers: list[str]) -> list[str]:
    """Identifiers of headers, repeated ones numbered; every name is used once."""
    taken: set[str] = set()
    out = []
    for i, header in enumerate(headers):
        base = name = identifier(header or "", f"col{i}")
        n = 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


@dataclass(frozen=True)
class Table:
    name: str
    section: str
    notes: str
    columns: tuple[tuple[str, str], ...]


class TableSandbox:
    """Loads parsed tables as views and answers single SELECTs over them."""

    def __init__(self, spark: SparkSession, strict: bool = True):
        self.spark, self.strict = spark, strict
        self.tables: dict[str, Table] = {}
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.tables)

    def _name(self, section: str) -> str:
        base = name = identifier(re.split(r"[—\-(]", section or "", maxsplit=1)[0], "tbl")
        n = 2
        while name in self.tables:
            name, n = f"{base}_{n}", n + 1
        return name

    def load_tables(self, blocks: DataFrame) -> list[str]:
        """Load all table blocks, in order of ``seq``.

        The rows of all tables are written once, in files by table, so that a query
        parses nothing again and reads its own tables only.  The driver keeps a line of
        each table: one view is one name in the session's catalog.
        """
        tables = blocks.where("kind = 'table'")
        types: dict[str, dict[int, str]] = {}
        for r in column_types(tables).collect():
            types.setdefault(r.doc_id, {})[r["col"]] = r.type
        listed = tables.select("doc_id", "seq", "section", "headers", "context_notes").orderBy("seq").collect()
        if not listed:
            return []
        path = new_path(self.spark, "tables")
        tables.select("doc_id", F.explode_outer("rows").alias("row")).where("row is not null").write.partitionBy("doc_id").parquet(path)
        self.paths.append(path)
        cells = self.spark.read.schema("row array<string>, doc_id string").parquet(path)
        names = []
        for b in listed:
            name, columns = self._name(b.section), column_names(b.headers)
            kinds = [types[b.doc_id].get(i, "STRING") for i in range(len(columns))]
            typed = [F.nullif(trim(F.get("row", F.lit(i))), F.lit("")).try_cast(kind.lower()).alias(c) for i, (c, kind) in enumerate(zip(columns, kinds, strict=True))]
            cells.where(F.col("doc_id") == b.doc_id).select(*typed).createOrReplaceTempView(name)
            self.tables[name] = Table(name, b.section, b.context_notes or "", tuple(zip(columns, kinds, strict=True)))
            names.append(name)
        return names

    def load_table(self, block: DataFrame) -> str:
        return self.load_tables(block)[0]

    def schema_description(self) -> str:
        """One paragraph for each view: its typed columns, where it came from, two rows and notes."""
        said = []
        for t in self.tables.values():
            rows = " and ".join(str(tuple(r)) for r in self.spark.table(t.name).limit(2).collect())
            columns = ", ".join(f"{c} {k}" for c, k in t.columns)
            said.append(f"{t.name} ({columns}), the table under '{t.section}', begins with {rows or 'no row'}." + (f" Noted there: {t.notes}" if t.notes else ""))
        return "\n\n".join(said)

    def query(self, sql: str) -> DataFrame:
        """The DataFrame of a checked SELECT."""
        if hint := missing_features(sql):
            raise ValueError(hint)
        return self.spark.sql(check(self.spark, sql, set(self.tables), self.strict))

    def execute(self, sql: str) -> list[dict]:
        """Rows of a checked SELECT as dicts; of columns with one name the last stays."""
        df = self.query(sql)
        return [dict(zip(df.columns, r, strict=True)) for r in df.collect()]

    def close(self) -> None:
        for name in self.tables:
            self.spark.catalog.dropTempView(name)
        drop(self.spark, *self.paths)
        self.tables.clear()
        self.paths.clear()
