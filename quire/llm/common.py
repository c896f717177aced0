"""Tables, staging and row identity shared by the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import fresh_path, hadoop_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# A word of the contracts: a run without blank, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def python_ready(frame: DataFrame) -> SparkSession:
    """The session of a frame, whose workers can import this package."""
    spark = frame.sparkSession
    ship_package(spark)
    return spark


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame into the shared folder and read it again: cuts lineage, survives lost executors.

    The files go when the driver's JVM ends; ``discard`` removes them sooner.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, label)
    frame.write.parquet(path)
    handle, files = hadoop_path(spark, path)
    files.deleteOnExit(handle)
    kept = spark.read.parquet(path)
    kept.staged_at = path
    return kept


def discard(frame: DataFrame) -> None:
    """Remove the files of a staged frame that nothing reads any more."""
    handle, files = hadoop_path(frame.sparkSession, frame.staged_at)
    files.delete(handle, True)


def with_row_id(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a table scan, for use within one job.

    A later job may number them otherwise: how a scan is split depends on the cores there are when it is planned. What
    refers to the numbers across jobs takes ``numbered``.
    """
    return rows.withColumn(name, F.monotonically_increasing_id())


def numbered(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """The rows with an identity that every later job reads the same.

    Rows of a Parquet scan have one: their file and their place in it, whatever way the file is split. Rows of anything
    else are numbered and staged.
    """
    plan = rows._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in rows.columns:
        try:
            return rows.withColumn(name, F.concat_ws(":", "_metadata.row_index", "_metadata.file_path"))
        except AnalysisException:  # a format whose rows have no place
            pass
    return staged(with_row_id(rows, name), "numbered")


def lower_ascii(text: Column) -> Column:
    """A text (null: empty) with A-Z lower-cased and nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def kept_rows(docs: DataFrame, verdict: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` (numbered as ``name``) that ``verdict`` (the same numbers) names, with the columns of ``docs``."""
    return docs.join(verdict.select(name), name, "left_semi").drop(name)


def unused_name(frame: DataFrame, wish: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
