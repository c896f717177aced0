"""Casts of the ``cast`` transform. A cell that does not fit fails the run."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.values import INTEGER, NUMBER, SPECIAL_NUMBER, number_of, text_of, time_of

# Type names of a spec, the Spark type each becomes and, for
# integers, the range it must keep. Unsigned types become what the sinks write
# for them; uint64 exceeds every integer type.
_INTEGERS = {
    "int8": ("tinyint", -(2**7), 2**7 - 1),
    "int16": ("smallint", -(2**15), 2**15 - 1),
    "int32": ("int", -(2**31), 2**31 - 1),
    "int64": ("bigint", -(2**63), 2**63 - 1),
    "uint8": ("bigint", 0, 2**8 - 1),
    "uint16": ("bigint", 0, 2**16 - 1),
    "uint32": ("bigint", 0, 2**32 - 1),
    "uint64": ("decimal(20,0)", 0, 2**64 - 1),
}
_OTHERS = {
    "float32": "float", "float64": "double",
    "bool": "boolean", "boolean": "boolean",
    "string": "string", "str": "string", "utf8": "string",
    "date": "timestamp_ntz", "datetime": "timestamp_ntz",
}
DTYPES = (*_INTEGERS, *_OTHERS)

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def resolve_dtype(name: str) -> str:
    """Canonical (lower-case) type name; raises for an unknown one."""
    key = name.lower()
    if key not in DTYPES:
        raise ValueError(f"unknown dtype '{name}' (known: {', '.join(DTYPES)})")
    return key


def _or_fail(value: Column, source: Column, dtype: str) -> Column:
    """``value``, failing the job where it is null although the cell is not."""
    message = F.concat(F.lit("cannot cast '"), source.cast("string"), F.lit(f"' to {dtype}"))
    return F.when(source.isNull(), F.lit(None)).when(value.isNotNull(), value).otherwise(F.raise_error(message))


def cast_cell(cell: Column, source: str, dtype: str) -> Column:
    """Cast a column of Spark type ``source`` to a type of the spec."""
    dtype = resolve_dtype(dtype)
    is_time = source.startswith("timestamp") or source == "date"
    if dtype in _INTEGERS:
        return _to_integer(cell, source, dtype, is_time)
    target = _OTHERS[dtype]
    if target == source:
        return cell
    if target == "string":
        return text_of(cell, source)
    if target == "boolean":
        if source == "string":
            word = F.lower(F.trim(cell))
            value = F.when(word == "true", True).when(word == "false", False)
            return _or_fail(value, cell, dtype)
        _refuse(is_time, source, dtype)
        return cell != 0
    if target == "timestamp_ntz":
        if source == "string":
            return _or_fail(time_of(cell), cell, dtype)
        _refuse(not is_time, source, dtype)
        return cell.cast("timestamp_ntz")
    _refuse(is_time, source, dtype)
    if source == "string":
        # No sign after the number and no parentheses here, unlike in a filter.
        strict = cell.rlike(NUMBER) & ~cell.rlike(r"[()]|[+-]\s*$")
        value = F.when(strict | cell.rlike(SPECIAL_NUMBER), number_of(cell))
        return _or_fail(value, cell, dtype).cast(target)
    return cell.cast(target)


def _to_integer(cell: Column, source: str, dtype: str, is_time: bool) -> Column:
    target, low, high = _INTEGERS[dtype]
    _refuse(is_time, source, dtype)
    if source == "boolean":
        return cell.cast("int").cast(target)
    # Through a decimal, so that both ends of the range compare exactly.
    if source == "string":
        wide = F.when(cell.rlike(INTEGER), F.trim(cell).try_cast("decimal(38,0)"))
    elif source in _INTEGRAL:
        if (target, source) in (("bigint", s) for s in _INTEGRAL) and low < 0:
            return cell.cast("bigint")
        wide = cell.cast("decimal(38,0)")
    else:
        # Halves go to the even neighbour.
        wide = F.bround(cell, 0).try_cast("decimal(38,0)")
    inside = F.when(wide.between(F.lit(Decimal(low)), F.lit(Decimal(high))), wide)
    return _or_fail(inside, cell, dtype).cast(target)


def _refuse(condition: bool, source: str, dtype: str) -> None:
    if condition:
        raise ValueError(f"a {source} column cannot be cast to {dtype}")
