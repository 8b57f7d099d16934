"""Literals and small building blocks of SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(expr: str, values: Iterable[str]) -> str:
    items = ", ".join(lit(v) for v in values)
    return f"{expr} IN ({items})" if items else "false"


def array_of(values: Iterable[str]) -> str:
    return f"cast(array({', '.join(lit(v) for v in values)}) AS array<string>)"


def map_of(pairs: Mapping[str, str]) -> str:
    """A map literal of text to expression."""
    return f"map({', '.join(f'{lit(k)}, {v}' for k, v in pairs.items())})"


def present_only(*items: str) -> str:
    """Array of the items that are not NULL, in the order given."""
    return f"array_compact(array({', '.join(items)}))"


def when(condition: str, then: str, otherwise: str | None = None) -> str:
    tail = "" if otherwise is None else f" ELSE {otherwise}"
    return f"CASE WHEN {condition} THEN {then}{tail} END"


def exprs(**named: str) -> list[Column]:
    """Expressions as columns under the given names."""
    return [F.expr(f"{expr} AS `{name}`") for name, expr in named.items()]


def expr_map(named: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.expr(expr) for name, expr in named.items()}
