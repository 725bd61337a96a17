"""JavaScript rules (X9, X10, X14) and field access on schema-free rows kept as Variant.

The schema-bound helpers of ``expr`` look at a column's Spark type when the
plan is built; here each value's own JSON type decides, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.expr import _js_sql, _quote, _truthy_sql

_NESTED = 3  # levels of arrays inside arrays written as text; deeper ones as JSON


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _text_sql(v: str, depth: int = 0) -> str:
    x = f"e{depth}"
    items = (f"array_join(transform(try_cast({v} AS ARRAY<VARIANT>), {x} -> coalesce({_text_sql(x, depth + 1)}, '')), ',')"
             if depth < _NESTED else f"to_json({v})")
    return (f"CASE WHEN {v} IS NULL OR {_kind(v)} = 'VOID' THEN CAST(NULL AS STRING) "
            f"WHEN {_kind(v)} IN ('STRING', 'BOOLEAN') THEN try_cast({v} AS STRING) "
            f"WHEN startswith({_kind(v)}, 'ARRAY') THEN {items} "
            f"WHEN startswith({_kind(v)}, 'OBJECT') THEN '[object Object]' "
            f"ELSE {_js_sql(f'try_cast({v} AS DOUBLE)', T.DoubleType())} END")


def _is_truthy_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR {_kind(v)} = 'VOID' THEN false "
            f"WHEN {_kind(v)} = 'STRING' THEN try_cast({v} AS STRING) <> '' "
            f"WHEN {_kind(v)} = 'BOOLEAN' THEN try_cast({v} AS BOOLEAN) "
            f"WHEN startswith({_kind(v)}, 'ARRAY') OR startswith({_kind(v)}, 'OBJECT') THEN true "
            f"ELSE {_truthy_sql(f'try_cast({v} AS DOUBLE)', T.DoubleType())} END")


def fields(row: str = "row") -> Column:
    """The top-level fields of a Variant object as a map; null for other values."""
    return F.expr(f"CASE WHEN startswith({_kind(row)}, 'OBJECT') THEN CAST({row} AS MAP<STRING, VARIANT>) END")


def field_first_truthy(fields: str, names: list[str], default: str | None = None, dynamic: str | None = None) -> Column:
    """X10 over the map column ``fields``: the field that column ``dynamic`` names first, then ``names``."""
    keys = ([f"`{dynamic}`"] if dynamic else []) + [_quote(n) for n in names]
    parts = []
    for key in keys:
        v = f"try_element_at({fields}, {key})"
        parts.append(f"CASE WHEN {_is_truthy_sql(v)} THEN {_text_sql(v)} END")
    if default is not None:
        parts.append(_quote(default))
    return F.expr(f"coalesce({', '.join(parts)})") if len(parts) > 1 else F.expr(parts[0])


def field_text(fields: str, name: str) -> Column:
    """``String(v)`` of one field; null when absent or null."""
    return F.expr(_text_sql(f"try_element_at({fields}, {_quote(name)})"))


def any_string_contains(fields: str, needle: str) -> Column:
    """F9 on a row's own types: some top-level string value contains ``needle`` (lower case)."""
    return F.expr(f"coalesce(exists(map_values({fields}), x -> {_kind('x')} = 'STRING' "
                  f"AND contains(lower(try_cast(x AS STRING)), {_quote(needle)})), false)")


def string_values(fields: str) -> Column:
    """The row's top-level string values, lower-cased."""
    return F.expr(f"transform(filter(map_values({fields}), x -> {_kind('x')} = 'STRING'), x -> lower(try_cast(x AS STRING)))")
