"""Scan a tree of workbook files into a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.upsert import EstateStore
from quire.sources.workbooks import (
    find_workbooks, ingest, readable, unreadable, with_file_facts,
)


@dataclass(frozen=True)
class ScanResult:
    """Counts of a scan; ``errors`` holds ``path, message`` of the skipped files."""

    scanned: int
    indexed: int
    skipped: int
    errors: DataFrame


def summary(parsed: DataFrame) -> DataFrame:
    """``scanned, indexed, skipped`` of parsed files, as one row."""
    return parsed.agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("error").isNull()).alias("indexed"),
        F.count_if(F.col("error").isNotNull()).alias("skipped"),
    )


def scan_files(files: DataFrame, store: EstateStore) -> ScanResult:
    """Parse files and upsert those that could be read.

    The parsed batch is written once and read back for both the counts and the
    upsert, so no file is parsed twice and a lost executor costs only its tasks.
    A file that fails keeps the rows of its last good scan. Each path may occur
    once, as in a file listing (else see ``newest_per_key``).
    """
    staged = ingest(files)
    counts = summary(staged).first()
    if counts.indexed:
        store.upsert(readable(staged))
    return ScanResult(counts.scanned, counts.indexed, counts.skipped, unreadable(staged))


def scan_tree(spark: SparkSession, root: str, store: EstateStore, through_spark: bool = False) -> ScanResult:
    """Discover, read and index all workbook files below ``root``.

    Files that have gone from the tree stay in the store, as in any upsert. See ``with_file_facts`` for ``through_spark``.
    """
    return scan_files(with_file_facts(find_workbooks(spark, root), through_spark), store)
