"""Read-only guard: what a generated query may contain.

The statement is parsed by Spark and every node of the plan, subqueries and CTEs
included, must be of a listed kind; relations must be one of the given views or a CTE
of the query.  Where the parser cannot be reached the query is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Statements, functions and plan nodes.
FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|create|alter|attach|copy|install|load|pragma|set)\b", re.I)
CLOSING = re.compile(r"[\s;]+\Z")
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases Join LateralJoin AsOfJoin UnresolvedWith "
    "Union Except Intersect UnresolvedHaving WithWindowDefinition Window Generate OneRowRelation UnresolvedInlineTable LocalRelation Pivot Unpivot UnpivotTransformer Sample Expand UnresolvedTableValuedFunction UnresolvedTVFAliases".split()
)
FUNCTIONS_OFF = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length read_files schema_of_avro from_avro to_avro".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())


def banned_words(sql: str) -> set[str]:
    """Keywords of statements that write, wherever they stand in ``sql``."""
    return {found.group().lower() for found in FORBIDDEN.finditer(sql)}


def parsed(spark: SparkSession, sql: str):
    """Spark's parsed plan of one statement, closing semicolons aside; several statements do not parse."""
    try:
        parse = spark._jsparkSession.sessionState().sqlParser().parsePlan
    except AttributeError as e:
        raise ValueError("the SQL parser is out of reach, so no query can be checked") from e
    try:
        return parse(CLOSING.sub("", sql))
    except Exception as e:
        raise ValueError(f"the statement cannot be parsed: {str(e)[:300]}") from e


def check(spark: SparkSession, sql: str, allowed: set[str], strict: bool = True) -> str:
    """``sql`` without closing semicolons if it reads from ``allowed`` views only; else a ValueError.

    The parsed plan decides.  ``strict`` also refuses the keywords of writing statements
    anywhere in the text, in names and literals too.
    """
    if strict and (words := banned_words(sql)):
        raise ValueError(f"a query does not say {', '.join(sorted(words))}")
    check_plan(spark, sql, allowed)
    return CLOSING.sub("", sql)


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def check_plan(spark: SparkSession, sql: str, allowed: set[str]) -> None:
    """Raise ValueError unless the plan of ``sql`` is read-only over ``allowed`` views."""
    plan = parsed(spark, sql)
    views = {v.lower() for v in allowed}
    seen: list[str] = []

    def expression(e, ctes: frozenset[str]) -> None:
        kind = _kind(e)
        if "UnresolvedIdentifier" in kind:
            raise ValueError("IDENTIFIER() is not allowed")
        if kind == "UnresolvedFunction":
            name = ".".join(str(x).lower() for x in _all(e.nameParts()))
            if name.split(".")[-1] in FUNCTIONS_OFF or "." in name:
                raise ValueError(f"the function {name} is not allowed")
        if hasattr(e, "plan") and "Subquery" in kind or kind in ("Exists", "ListQuery", "InSubquery"):
            inner = e.query() if kind == "InSubquery" else e
            walk(inner.plan(), ctes)
        for child in _all(e.children()):
            expression(child, ctes)

    def walk(node, ctes: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in NODES:
            raise ValueError(f"{kind} is not allowed in a query")
        if kind == "UnresolvedRelation":
            parts = [str(x) for x in _all(node.multipartIdentifier())]
            seen.append(".".join(parts))
            if len(parts) != 1 or parts[0].lower() not in views | ctes:
                raise ValueError(f"the relation {'.'.join(parts)} is not allowed")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(str(x).lower() for x in _all(node.name()))
            if name not in TABLE_FUNCTIONS:
                raise ValueError(f"the table function {name} is not allowed")
        inner = ctes
        if kind == "UnresolvedWith":
            named = _all(node.cteRelations())
            for pair in named:
                walk(pair._2(), inner | ({str(pair._1()).lower()} if node.allowRecursion() else frozenset()))
                inner = inner | {str(pair._1()).lower()}
        for e in _all(node.expressions()):
            expression(e, inner)
        for child in _all(node.children()):
            walk(child, inner)

    walk(plan, frozenset())
    shown = plan.toString().count("'UnresolvedRelation [")
    if shown > len(seen):
        raise ValueError("the query has relations that could not be checked")


def missing_features(sql: str) -> str | None:
    """A hint for syntax that Spark would take for something else."""
    if re.search(r"\basof\s+join\b", sql, re.I):
        return "ASOF JOIN is read as a table alias; use a window over a union instead"
    return None
