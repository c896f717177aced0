"""Delimited text with quoted line ends, read in parallel whatever the size of a file.

Whether a line end is inside quotes depends on all that stands before it. So a first pass packs the physical lines of
each split into chunks and notes for each chunk what it does to that state: leave it, turn it over, or set it. A running
composition over the chunks of a file (one small row each) gives every chunk its starting state and, if it starts inside
a record, the chunk in which that record begins. A second pass cuts the chunks into records; the few records that
cross chunks are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import fresh_path, hadoop_path, ship_package

# Bytes of a chunk, one line at least.
CHUNK = 1 << 20

_KEY = ["file", "block", "chunk"]
_CHUNKS = "file string, block long, chunk long, body binary, ends_0 boolean, ends_1 boolean, bounded boolean"
_PIECES = "file string, owner_block long, owner_chunk long, block long, chunk long, first boolean, whole boolean, body binary"


def inside_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open at the end of a line that starts a record, or starts inside a quoted field."""
    at = 0
    if not inside:
        if b'"' not in line:
            return False
        inside = line.startswith(b'"')
        at = 1 if inside else 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
            at, inside = at + 1, False
        # In a field that does not, or no longer, stand in quotes: only a separator ends it.
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)
        if line[at:at + 1] == b'"':
            at, inside = at + 1, True


def fields_of(record: bytes, sep: bytes) -> list[str]:
    """The cells of one record; doubled quotes inside quotes are one, everything else is kept as it is."""
    if b'"' not in record:
        return [x.decode("utf-8", "replace") for x in record.split(sep)]
    cells, at = [], 0
    while True:
        cell = b""
        if record[at:at + 1] == b'"':
            at += 1
            while True:
                end = record.find(b'"', at)
                if end < 0:
                    cell, at = cell + record[at:], len(record)
                    break
                cell, at = cell + record[at:end], end + 1
                if record[at:at + 1] != b'"':
                    break
                cell, at = cell + b'"', at + 1
        end = record.find(sep, at)
        cells.append((cell + (record[at:] if end < 0 else record[at:end])).decode("utf-8", "replace"))
        if end < 0:
            return cells
        at = end + len(sep)


def _chunks(sep: bytes):
    """Physical lines, in order, as chunks of one split with their effect on the quoting state."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, lines, size = None, 0, [], 0

        def one():
            ends, bounded = [False, True], False
            for line in lines:
                before = ends[1]
                ends = [inside_after(line, s, sep) for s in ends]
                bounded = bounded or before and not ends[1]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([number], pa.int64()),
                 pa.array([b"\n".join(lines)], pa.binary()), *(pa.array([x], pa.bool_()) for x in (*ends, bounded))],
                [*_KEY, "body", "ends_0", "ends_1", "bounded"])

        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line"))):
                if key != (file, block) or size >= CHUNK:
                    if lines:
                        yield one()
                    number = number + 1 if key == (file, block) else 0
                    key, lines, size = (file, block), [], 0
                lines.append(line)
                size += len(line) + 1
        if lines:
            yield one()

    return packed


def _starts(chunks: DataFrame) -> DataFrame:
    """For each chunk whether it starts inside quotes, and the chunk in which its first record begins."""
    order = Window.partitionBy("file").orderBy("block", "chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns, sets = F.col("ends_0") & ~F.col("ends_1"), F.col("ends_0") == F.col("ends_1")
    counted = chunks.select(*_KEY, "ends_0", "ends_1", "bounded", turns.cast("int").alias("turn")).withColumn(
        "turned", F.sum("turn").over(order))
    known = counted.select(
        "*", F.coalesce(F.last(F.when(sets, F.col("ends_0").cast("int")), ignorenulls=True).over(before), F.lit(0)).alias("set_to"),
        F.coalesce(F.last(F.when(sets, F.col("turned")), ignorenulls=True).over(before), F.lit(0)).alias("set_at"),
    ).withColumn("inside", (F.col("set_to") + F.col("turned") - F.col("turn") - F.col("set_at")) % 2 == 1)
    # A chunk opens a record that it does not end if it ends inside quotes that were opened in it.
    opens = F.when(F.col("inside"), F.col("bounded") & F.col("ends_1")).otherwise(F.col("ends_0"))
    owner = F.last(F.when(opens, F.struct("block", "chunk")), ignorenulls=True).over(before)
    return known.select(*_KEY, "inside", owner["block"].alias("owner_block"), owner["chunk"].alias("owner_chunk"))


def _pieces(sep: bytes):
    """Whole records, and the pieces of records that cross chunks."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["block"], row["chunk"])
                rows, held = [], []
                inside, owner = row["inside"], (row["owner_block"], row["owner_chunk"]) if row["inside"] else own
                lines = row["body"].split(b"\n")
                first = own == (0, 0)
                if first:
                    lines[0] = lines[0].removeprefix(b"\xef\xbb\xbf")
                for line in lines:
                    held.append(line)
                    inside = inside_after(line, inside, sep)
                    if not inside:
                        rows.append((*owner, first, owner == own, b"\n".join(held)))
                        held, owner, first = [], own, False
                if held:
                    rows.append((*owner, first, False, b"\n".join(held)))
                columns = list(zip(*rows))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * n), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array([own[0]] * n, pa.int64()), pa.array([own[1]] * n, pa.int64()),
                     pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.binary())],
                    ["file", "owner_block", "owner_chunk", "block", "chunk", "first", "whole", "body"])

    return cut


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``file, first, body`` of every record: quoted line ends are kept as they are, ``first`` marks a file's first one.

    The lines are staged as chunks, so that both passes see the same ones however a file is split.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))
    staged = fresh_path(spark, "csv")
    lines.mapInArrow(_chunks(sep.encode()), _CHUNKS).write.parquet(staged)
    handle, files = hadoop_path(spark, staged)
    files.deleteOnExit(handle)
    chunks = spark.read.parquet(staged)
    pieces = chunks.select(*_KEY, "body").join(_starts(chunks), _KEY).mapInArrow(_pieces(sep.encode()), _PIECES)
    joined = pieces.where("NOT whole").groupBy("file", "owner_block", "owner_chunk").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "chunk", "body"))).alias("parts")).select(
        "file", "first", F.array_join(F.transform("parts.body", lambda b: b.cast("string")), "\n").cast("binary").alias("body"))
    return pieces.where("whole").select("file", "first", "body").unionByName(joined)


def cells(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``file, first, cells``: records without their line end, empty lines left out."""
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = sep.encode()
        for batch in batches:
            bodies = [b.removesuffix(b"\r") for b in batch.column("body").to_pylist()]
            some = [bool(b) for b in bodies]
            kept = batch.filter(pa.array(some, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("file"), kept.column("first"),
                 pa.array([fields_of(b, mark) for b in bodies if b], pa.list_(pa.string()))], ["file", "first", "cells"])

    return records(spark, path, sep).mapInArrow(parsed, "file string, first boolean, cells array<string>")
