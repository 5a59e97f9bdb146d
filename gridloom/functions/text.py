"""Text as Spark columns: white space, lines, words, tokens and identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (the built-in trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def lines(c: Column) -> Column:
    """Lines of a text, any line end; a final line end opens no further line, an empty text has none."""
    joined = F.regexp_replace(F.regexp_replace(c, LINE_END, "\n"), r"\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\n", -1))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lexical_tokens(c: Column) -> Column:
    """Identifiers of the lower-cased text, each followed by its parts if it has more than one."""

    def expand(token: Column) -> Column:
        parts = F.filter(F.split(token, r"[_\-.]"), lambda p: p != "")
        # most tokens have no part, and are not split
        return F.when(token == F.translate(token, "_-.", ""), F.array(token)).when(F.size(parts) > 1, F.concat(F.array(token), parts)).otherwise(F.array(token))

    return F.flatten(F.transform(hash_tokens(c), expand))


def hash_tokens(c: Column) -> Column:
    """Identifiers of the lower-cased text with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_\-.]+"), 0)


def plain_tokens(c: Column) -> Column:
    """Tokens of the TF-IDF baseline: no dots or hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), 0)


def word_tokens(c: Column) -> Column:
    """Runs of two or more word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), 0)


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: trim(s) != "")


def sanitized(c: Column, fallback: str = "col") -> Column:
    """A text as SQL identifier; ``identifier`` is the same for one value at the driver."""
    core = F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9_]+", "_"), r"^_+|_+\z", "")
    named = F.when(core == "", F.lit(fallback)).when(core.rlike("^[0-9]"), F.concat(F.lit(f"{fallback}_"), core)).otherwise(core)
    return F.substring(named, 1, 60)


def identifier(name: str, fallback: str = "col") -> str:
    core = re.sub("[^a-z0-9_]+", "_", name.strip().lower()).strip("_")
    if not core:
        return fallback
    return (f"{fallback}_{core}" if core[0].isdigit() else core)[:60]


def table_title(section: Column) -> Column:
    """The topic of a section title: up to the first dash or parenthesis."""
    return F.element_at(F.split(section, r"[—\-(]", 2), 1)
