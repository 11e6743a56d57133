"""Expressions of rules that may fail on a row, evaluated so that no row ends the job.

Casts, divisions, positions in arrays, ``raise_error`` and the like raise under ANSI rules. An attempted expression
gives its value or the note that it failed, so that a row is counted against the one rule whose expression it breaks.
Expressions that cannot fail are left as they are: they stay in generated code and reach the file reader.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(?P<text>'[^'\\]*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign><=>|<>|!=|<=|>=|=|<|>|\(|\)|,))")
_JOINS = {"and", "or"}
_WORDS = _JOINS | {"not", "in", "is", "null", "true", "false"}


@dataclass(frozen=True)
class Attempt:
    """An expression's value, and whether evaluating it failed; ``failed`` is None if it cannot."""

    value: Column
    failed: Column | None = None


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return "text" if isinstance(kind, T.StringType) else kind.simpleString()


def cannot_fail(text: str, events: DataFrame) -> bool:
    """Whether an expression only compares columns and literals of one kind with each other.

    Anything else (functions, arithmetic, casts, comparisons across kinds) may fail.
    """
    kinds = {f.name.lower(): _family(f.dataType) for f in events.schema}
    at, seen, text = 0, set(), text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            return False
        at = found.end()
        kind, token = found.lastgroup, found.group(found.lastgroup)
        word = token.lower()
        if kind == "name" and word not in kinds and word not in _WORDS:
            return False
        if kind == "name" and word in kinds:
            # a call, or a literal with a type in front
            if re.match(r"\s*['(]", text[at:]):
                return False
            seen.add(kinds[word])
        elif kind in ("text", "number"):
            seen.add(kind)
        elif word in _JOINS:
            seen = set()
        if len(seen) > 1:
            return False
    return True


def is_column(text: str, events: DataFrame, kind: type[T.DataType]) -> bool:
    return any(f.name.lower() == text.strip().lower() and isinstance(f.dataType, kind) for f in events.schema)


def _told(expr: Column) -> Column:
    """``v`` and the value's text, ``n`` for NULL; NULL if evaluating ``expr`` raises.

    The attempt is made by a conversion that answers NULL where its input cannot be had. It stands inside a
    higher-order function, because parts that several rules share must not be evaluated ahead of their attempts.
    """
    text = F.coalesce(F.concat(F.lit("v"), expr.cast("string")), F.lit("n"))
    tried = F.try_to_binary(text, F.lit("utf-8")).cast("string")
    return F.element_at(F.transform(F.array(F.lit(0)), lambda _: tried), 1)


def attempt(text: str, kind: str) -> Attempt:
    told = _told(F.expr(text).cast(kind))
    value = F.when(F.startswith(told, F.lit("v")), F.substr(told, F.lit(2)))
    return Attempt(value.cast(kind), told.isNull())


def predicate(text: str, events: DataFrame) -> Attempt:
    return Attempt(F.expr(text)) if cannot_fail(text, events) else attempt(text, "boolean")


def number(text: str, events: DataFrame) -> Attempt:
    if text.strip().lower() == "null" or is_column(text, events, T.NumericType):
        return Attempt(F.expr(text).cast("double"))
    return attempt(text, "double")


def label(text: str, events: DataFrame) -> Attempt:
    return Attempt(F.expr(text).cast("string")) if is_column(text, events, T.AtomicType) else attempt(text, "string")
