"""Row and column transforms of a pipeline, as DataFrame to DataFrame steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.casts import cast_cell, resolve_dtype
from quire.functions.compare import COMPARISONS, MEMBERSHIP, OPERATORS, matches


class Transform(Protocol):
    def apply(self, rows: DataFrame) -> DataFrame: ...


def quoted(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(rows: DataFrame, name: str) -> str | None:
    """Actual name of a column: exact case first, then any case."""
    if name in rows.columns:
        return name
    return next((c for c in rows.columns if c.lower() == name.lower()), None)


@dataclass(frozen=True)
class Cast:
    """Change column types; columns that are not there are skipped."""

    columns: Mapping[str, str]

    def __post_init__(self) -> None:
        for dtype in self.columns.values():
            resolve_dtype(dtype)

    def apply(self, rows: DataFrame) -> DataFrame:
        targets = {}
        for name, dtype in self.columns.items():
            if actual := find_column(rows, name):
                targets[actual] = resolve_dtype(dtype)
        types = dict(rows.dtypes)
        return rows.select([
            cast_cell(quoted(c), types[c], targets[c]).alias(c, metadata={"dtype": targets[c]})
            if c in targets else quoted(c)
            for c in rows.columns
        ])


@dataclass(frozen=True)
class Rename:
    """Rename columns one after the other; a name already taken is an error."""

    columns: Mapping[str, str]

    def apply(self, rows: DataFrame) -> DataFrame:
        names = list(rows.columns)
        for old, new in self.columns.items():
            lowered = [n.lower() for n in names]
            at = names.index(old) if old in names else (
                lowered.index(old.lower()) if old.lower() in lowered else None)
            if at is None:
                continue
            if any(n == new.lower() for i, n in enumerate(lowered) if i != at):
                raise ValueError(f"cannot rename '{old}' to '{new}': there is such a column already")
            names[at] = new
        return rows.select([quoted(c).alias(n) for c, n in zip(rows.columns, names)])


@dataclass(frozen=True)
class Select:
    """Keep the listed columns, by exact name and in their present order."""

    columns: Sequence[str]

    def apply(self, rows: DataFrame) -> DataFrame:
        keep = set(self.columns)
        return rows.select([quoted(c) for c in rows.columns if c in keep])


@dataclass(frozen=True)
class Drop:
    """Remove columns; columns that are not there are skipped."""

    columns: Sequence[str]

    def apply(self, rows: DataFrame) -> DataFrame:
        gone = {find_column(rows, name) for name in self.columns}
        return rows.select([quoted(c) for c in rows.columns if c not in gone])


@dataclass(frozen=True)
class Clause:
    col: str
    op: str
    value: object = None


def check_clause(clause: Clause) -> None:
    """Raise ``ValueError`` unless the clause is complete and well-shaped."""
    if not clause.col:
        raise ValueError("filter clause needs 'col'")
    if not clause.op:
        raise ValueError("filter clause needs 'op'")
    if clause.op not in OPERATORS:
        raise ValueError(f"unsupported filter op '{clause.op}' (allowed: {', '.join(OPERATORS)})")
    where = f"filter clause '{clause.col} {clause.op}'"
    value = clause.value
    if clause.op in COMPARISONS:
        if isinstance(value, (Mapping, Sequence)) and not isinstance(value, str):
            raise ValueError(f"{where}: value must be a scalar; use 'in' or 'not_in' for lists")
        return
    assert clause.op in MEMBERSHIP
    if isinstance(value, str):
        raise ValueError(f"{where}: value must be a list, not the text '{value}'; write [a, b]")
    if isinstance(value, Mapping) or not isinstance(value, Sequence):
        raise ValueError(f"{where}: value must be a list")
    if not value:
        raise ValueError(f"{where}: list must hold at least one value")
    if any(isinstance(v, (Mapping, Sequence)) and not isinstance(v, str) for v in value):
        raise ValueError(f"{where}: list values must be scalars, not lists or maps")


@dataclass(frozen=True)
class Filter:
    """Keep rows that satisfy all clauses; a column that is not there is an error."""

    where: Sequence[Clause]

    def __post_init__(self) -> None:
        for clause in self.where:
            check_clause(clause)

    def apply(self, rows: DataFrame) -> DataFrame:
        if not self.where:
            return rows
        types = dict(rows.dtypes)
        tests = []
        for clause in self.where:
            actual = find_column(rows, clause.col)
            if actual is None:
                raise ValueError(f"filter column '{clause.col}' does not exist")
            tests.append(matches(quoted(actual), types[actual], clause.op, clause.value))
        return rows.filter(reduce(lambda a, b: a & b, tests))


def any_column_contains(rows: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains a text, literally and in any case."""
    needle = text.strip().lower()
    if not needle:
        return rows
    hits = [
        F.coalesce(F.lower(quoted(c).cast("string")).contains(F.lit(needle)), F.lit(False))
        for c in rows.columns
    ]
    return rows.filter(reduce(lambda a, b: a | b, hits))
