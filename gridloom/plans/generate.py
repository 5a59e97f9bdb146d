"""Generators and the prompts given to them."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from typing import Protocol


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class CallableGenerator:
    """A function from prompt to text as a generator."""

    def __init__(self, function: Callable[[str], str], model: str = "callable"):
        self.function, self.model = function, model

    def generate(self, prompt: str) -> str:
        return self.function(prompt)


def named_function(variable: str) -> Callable | None:
    """The function that an environment variable names as ``module:function``; None where it is unset."""
    named = os.environ.get(variable)
    if not named:
        return None
    module, _, name = named.partition(":")
    return getattr(importlib.import_module(module), name)


class ChatGenerator:
    """A chat model with ``invoke``; content given as a list of parts is joined."""

    def __init__(self, chat, model: str = "chat"):
        self.chat, self.model = chat, model

    def generate(self, prompt: str) -> str:
        content = getattr(said := self.chat.invoke(prompt), "content", said)
        if isinstance(content, list):
            return "".join(p if isinstance(p, str) else p.get("text", "") for p in content)
        return str(content)


class EchoGenerator:
    """Answers with the last lines of its prompt: deterministic, for tests and dry runs."""

    model = "echo"

    def generate(self, prompt: str) -> str:
        return "\n".join(prompt.strip().splitlines()[-3:])


class MissingGenerator:
    """Stands for a generator that was not given; raises when it is first used."""

    model = "none"

    def generate(self, prompt: str) -> str:
        raise RuntimeError("No generator configured.")


SYSTEM = "Answer from the context below and from nothing else. If it does not hold the answer, say that you do not know."
CONTRACT = "Give the answer first, in one short sentence, with figures exactly as the context states them."
BASELINE = "Answer the question from the context alone. Simple sums, counts and averages over the rows shown are fine. If the context does not tell, say so."

DECLINED = "NO_SQL"  #: fixed value: what a generator says where no query can answer
SQL_TASK = "Translate this question into a single Spark SQL query.\nQuestion: {question}"
SQL_RULES = f"""The query is run as you write it, so reply with nothing but its text, or with {DECLINED} if the views below do not hold the answer.
It may only read (SELECT or WITH) and only from these views. Blank cells are NULL there.
Spark's dialect: regexp_extract(s, r'(\\d+)', 1) takes a raw string and a group; divide with try_divide where the divisor may be 0; read numbers in text with try_cast; QUALIFY and ASOF JOIN do not exist."""
RETRY = "{prompt}\n{sql}\n\nSpark refused that query:\n{error}\n\nThe query without this fault (or " + DECLINED + "):\nSQL:"


def build_prompt(question: str, context: str, sql: str | None = None, rows: list[dict] | None = None, system: str | None = None, builder: Callable[..., str] | None = None) -> str:
    """The answer prompt; ``builder`` replaces it as a whole."""
    system = system or SYSTEM
    if builder is not None:
        return builder(system, context, question, sql=sql, sql_result=rows)
    computed = f"\n\nExact result of a query over the complete tables (prefer it to own arithmetic):\n{sql}\n{rows}" if sql and rows is not None else ""
    return f"{system}\n\n{CONTRACT}\n\nContext:\n{context}{computed}\n\nQuestion: {question}\n\nAnswer:"


def baseline_prompt(question: str, chunks: list[str]) -> str:
    joined = "\n\n---\n\n".join(chunks)
    return f"{BASELINE}\n\nContext:\n{joined}\n\nQuestion: {question}\n\nAnswer:"
