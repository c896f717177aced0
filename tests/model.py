"""Plain-Python model of the filter comparison, cell by cell."""

from __future__ import annotations

import math
from datetime import datetime

from quire.functions.values import parse_bool, parse_number, parse_time


def compare(cell, value) -> int:
    """-1, 0 or 1 for a cell against a literal (text or None)."""
    if cell is None:
        return 0 if value is None else -1
    if value is None:
        return 1
    if isinstance(cell, bool):
        truth = parse_bool(value)
        if truth is not None:
            return _order(cell, truth)
        return _order(str(cell), value)
    if isinstance(cell, datetime):
        time = parse_time(value)
        if time is not None:
            return _order(cell, time)
        return _order(cell.strftime("%m/%d/%Y %H:%M:%S"), value)
    left = float(cell) if isinstance(cell, (int, float)) else parse_number(cell)
    right = parse_number(value)
    if left is not None and right is not None:
        return _order_numbers(left, right)
    if isinstance(cell, str):
        a, b = parse_time(cell), parse_time(value)
        if a is not None and b is not None:
            return _order(a, b)
        return _order(cell, value)
    return _order(number_text(cell), value)


def number_text(cell) -> str:
    if isinstance(cell, int):
        return str(cell)
    if math.isnan(cell):
        return "NaN"
    if math.isinf(cell):
        return "Infinity" if cell > 0 else "-Infinity"
    if cell == int(cell) and abs(cell) < 1e15:
        return str(int(cell))
    return repr(cell)


def matches(cell, op, value) -> bool:
    if op in ("in", "not_in"):
        found = any(compare(cell, v) == 0 for v in value)
        return found if op == "in" else not found
    order = compare(cell, value)
    return {
        "==": order == 0, "!=": order != 0, ">": order > 0, ">=": order >= 0, "<": order < 0, "<=": order <= 0,
    }[op]


def _order(a, b) -> int:
    return (a > b) - (a < b)


def _order_numbers(a: float, b: float) -> int:
    """NaN equals itself and lies below every number."""
    if math.isnan(a) or math.isnan(b):
        return math.isnan(b) - math.isnan(a)
    return _order(a, b)
