"""Comparison of a cell with a literal of a pipeline spec.

Literals are text or null. The rules, per cell: null equals null and lies below
everything else; then as numbers if both are numbers; then as times if both are
times; else as text, character by character. A typed column settles the kind
when the plan is built, so the result is a plain comparison that reaches the
scan; only text columns carry the decision per cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.values import number_of, parse_bool, parse_number, parse_time, text_of, time_of

# Operators of a filter clause.
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=")
MEMBERSHIP = ("in", "not_in")
OPERATORS = (*COMPARISONS, *MEMBERSHIP)

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_EXACT = 2**53  # integers up to here are exact as floating-point numbers


def matches(cell: Column, dtype: str, op: str, value: object) -> Column:
    """Whether a cell satisfies one clause; never null where it matters.

    A result of null counts as false, as in a filter.
    """
    if op in MEMBERSHIP:
        found = _member(cell, dtype, value)
        return found if op == "in" else ~F.coalesce(found, F.lit(False))
    if op not in COMPARISONS:
        raise ValueError(f"unsupported filter op '{op}' (allowed: {', '.join(OPERATORS)})")
    if value is None:
        return _against_null(cell, op)
    result = _compare(cell, dtype, op, _literal_text(value))
    # A null cell lies below any literal.
    return cell.isNull() | result if op in ("<", "<=", "!=") else result


def _literal_text(value: object) -> str:
    if isinstance(value, bool):
        return "True" if value else "False"
    return str(value)


def _member(cell: Column, dtype: str, values: list) -> Column:
    with_null = any(v is None for v in values)
    texts = [_literal_text(v) for v in values if v is not None]
    tests = []
    if dtype == "string":
        # Literals that can only be compared as text share one set test.
        words = [t for t in texts if parse_number(t) is None and parse_time(t) is None]
        texts = [t for t in texts if t not in set(words)]
        if words:
            tests.append(cell.isin(words))
    tests += [_compare(cell, dtype, "==", text) for text in texts]
    if with_null:
        tests.append(cell.isNull())
    return reduce(lambda a, b: a | b, tests)


def _against_null(cell: Column, op: str) -> Column:
    if op in ("==", "<="):
        return cell.isNull()
    if op in ("!=", ">"):
        return cell.isNotNull()
    return F.lit(op == ">=")


def _apply(left: Column, op: str, right: Column) -> Column:
    return {
        "==": lambda: left == right, "!=": lambda: left != right,
        ">": lambda: left > right, ">=": lambda: left >= right,
        "<": lambda: left < right, "<=": lambda: left <= right,
    }[op]()


def _compare(cell: Column, dtype: str, op: str, text: str) -> Column:
    """Comparison of a non-null cell with a literal text."""
    number, time = parse_number(text), parse_time(text)
    if dtype == "string":
        return _compare_text(cell, op, text, number, time)
    if dtype == "boolean":
        truth = parse_bool(text)
        if truth is not None:
            return _apply(cell, op, F.lit(truth))
    elif dtype in _INTEGRAL and number is not None:
        return _compare_integer(cell, op, number)
    elif number is not None and (dtype in ("float", "double") or dtype.startswith("decimal")):
        return _compare_real(cell.cast("double") if dtype != "double" else cell, op, number)
    elif time is not None and (dtype.startswith("timestamp") or dtype == "date"):
        return _apply(cell if dtype == "timestamp_ntz" else cell.cast("timestamp_ntz"), op, _time_literal(time))
    return _apply(text_of(cell, dtype), op, F.lit(text))


def _time_literal(time) -> Column:
    return F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz")


def _compare_text(cell: Column, op: str, text: str, number: float | None, time) -> Column:
    as_text = _apply(cell, op, F.lit(text))
    if number is not None:
        parsed = number_of(cell)
        return F.when(parsed.isNotNull(), _compare_real(parsed, op, number)).otherwise(as_text)
    if time is not None:
        parsed = time_of(cell)
        return F.when(parsed.isNotNull(), _apply(parsed, op, _time_literal(time))).otherwise(as_text)
    return as_text


def _compare_real(cell: Column, op: str, number: float) -> Column:
    """NaN lies below every number and equals itself; Spark puts it on top."""
    if math.isnan(number):
        above = cell.isNotNull() & ~F.isnan(cell)
        return {
            "==": F.isnan(cell), "<=": F.isnan(cell),
            "!=": above, ">": above,
            ">=": cell.isNotNull(), "<": F.lit(False),
        }[op]
    plain = _apply(cell, op, F.lit(number))
    if op in (">", ">="):
        return plain & ~F.isnan(cell)
    if op in ("<", "<="):
        return plain | F.isnan(cell)
    return plain


def _compare_integer(cell: Column, op: str, number: float) -> Column:
    """Against an integer literal where that is exact, so that the scan can use it."""
    if not math.isfinite(number) or abs(number) >= _EXACT:
        return _compare_real(cell.cast("double"), op, number)
    if number == int(number):
        return _apply(cell, op, F.lit(int(number)))
    if op in ("==", "!="):
        return cell.isNotNull() & F.lit(op == "!=")
    # Between two integers: > and >= mean from the upper one, < and <= up to the lower.
    return cell > math.floor(number) if op in (">", ">=") else cell < math.ceil(number)
