"""Table sinks of a pipeline. All write a folder of part files, one per task."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from quire.functions.values import text_of
from quire.operators.transforms import quoted
from quire.session import hadoop_path


def replace_folder(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder beside ``target``, then put it in its place.

    Whatever spelling or part of the target the rows are read from, it stays intact until they are written, and a
    failing job leaves it as it was.
    """
    plain = target.rstrip("/") or target
    mark = uuid.uuid4().hex
    aside, old = f"{plain}.{mark}.new", f"{plain}.{mark}.old"
    written, fs = hadoop_path(spark, aside)
    place, replaced = hadoop_path(spark, plain)[0], hadoop_path(spark, old)[0]
    try:
        write(aside)
        if fs.exists(place) and not fs.rename(place, replaced):
            raise OSError(f"cannot move {plain} aside")
        if not fs.rename(written, place):
            fs.rename(replaced, place)
            raise OSError(f"cannot move the result to {plain}")
    finally:
        if fs.exists(written):
            fs.delete(written, True)
    if fs.exists(replaced):
        fs.delete(replaced, True)


class Sink(Protocol):
    def write(self, rows: DataFrame) -> None: ...

    def target(self) -> str: ...


@dataclass(frozen=True)
class CsvSink:
    """Delimited text with a header; null and empty text both become nothing."""

    path: str
    separator: str = ","

    def target(self) -> str:
        return self.path

    def write(self, rows: DataFrame) -> None:
        as_text = rows.select([text_of(quoted(c), dtype).alias(c) for c, dtype in rows.dtypes])
        writer = (
            as_text.write
            .option("header", True).option("sep", self.separator)
            .option("quote", '"').option("escape", '"')
            .option("nullValue", "").option("emptyValue", "")
            # Spark would trim values while writing.
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        )
        replace_folder(rows.sparkSession, self.path, writer.csv)


def widened(rows: DataFrame, single_floats: bool) -> DataFrame:
    """Columns in the types a sink stores; everything unknown becomes text."""
    return rows.select([_widen(field, single_floats).alias(field.name) for field in rows.schema])


def _widen(field: T.StructField, single_floats: bool) -> Column:
    column, dtype = quoted(field.name), field.dataType
    if field.metadata.get("dtype") == "uint64":
        return column.cast("string")
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return column.cast("int")
    if isinstance(dtype, T.DecimalType) or (isinstance(dtype, T.FloatType) and not single_floats):
        return column.cast("double")
    if isinstance(dtype, T.TimestampType):
        return column.cast("timestamp_ntz")
    kept = (
        T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
        T.TimestampNTZType, T.DateType, T.StringType,
    )
    return column if isinstance(dtype, kept) else column.cast("string")


@dataclass(frozen=True)
class ParquetSink:
    path: str

    def target(self) -> str:
        return self.path

    def write(self, rows: DataFrame) -> None:
        replace_folder(rows.sparkSession, self.path, widened(rows, single_floats=True).write.parquet)


@dataclass(frozen=True)
class TableSink:
    """A named table below ``path``, replaced or added to."""

    path: str
    table: str = "Extract"
    mode: str = "replace"

    MODES = ("replace", "append")

    def __post_init__(self) -> None:
        if self.mode.lower() not in self.MODES:
            raise ValueError(f"unsupported sink mode '{self.mode}' (allowed: {', '.join(self.MODES)})")

    def target(self) -> str:
        return f"{self.path.rstrip('/')}/{self.table}"

    def write(self, rows: DataFrame) -> None:
        out = widened(rows, single_floats=False)
        if self.mode.lower() == "append":
            self._check_same_columns(out)
            out.write.mode("append").parquet(self.target())
        else:
            replace_folder(rows.sparkSession, self.target(), out.write.parquet)

    def _check_same_columns(self, rows: DataFrame) -> None:
        path, fs = hadoop_path(rows.sparkSession, self.target())
        if not fs.exists(path):
            return
        present = rows.sparkSession.read.parquet(self.target())
        if present.dtypes != rows.dtypes:
            raise ValueError(
                f"table '{self.table}' has columns {present.dtypes}, the rows to append have {rows.dtypes}")


def export_result(rows: DataFrame, path: str) -> None:
    """Write a query result as CSV, filtered and ordered as the frame is."""
    CsvSink(path).write(rows)
