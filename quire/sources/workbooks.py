"""Workbook files to one nested row per file (the ingest job)."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire import schema
from quire.session import fresh_path, ship_package
from quire.sources.document import Document, document_bytes, extension, parse_document
from quire.sources.package import DocumentError, document_pieces

# Rows go back to the JVM once this much input, or this many rows, is parsed.
_FLUSH_BYTES = 16 << 20
_FLUSH_ROWS = 2000


def find_workbooks(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with a workbook extension, in any letter case.

    ``content`` is only read when a later step asks for it; ``with_file_facts`` does not.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .filter(F.lower("path").rlike(r"\.twbx?$"))
    )


def with_file_facts(files: DataFrame, through_spark: bool = False) -> DataFrame:
    """``path, sha256, mtime, size_bytes, content`` of listed files, without their content.

    Spark's listing packs the files of a task by their size; each is opened by path where it is parsed, whatever its
    size, and its digest is taken there. That needs a store ``pyarrow.fs`` reaches. ``through_spark`` lets Spark read
    the files instead, for stores that only it reaches; a file may then have 2 GiB at most.
    """
    content = F.col("content") if through_spark else F.lit(None).cast("binary")
    digest = F.sha2("content", 256) if through_spark else F.lit(None).cast("string")
    return files.select(
        "path", digest.alias("sha256"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"),
        F.col("length").alias("size_bytes"), content.alias("content"))


def parse_workbooks(files: DataFrame) -> DataFrame:
    """One nested row per file; a file that cannot be read only fills ``error``.

    ``files`` needs ``path, content``; digest, time and size are taken over
    where present and derived from the content where not. A row without content
    is read from its path, and its digest is taken there.
    """
    for column, fallback in (
        ("sha256", F.sha2("content", 256)),
        ("mtime", F.lit(None).cast("double")),
        ("size_bytes", F.length("content").cast("long")),
    ):
        if column not in files.columns:
            files = files.withColumn(column, fallback)
    ship_package(files.sparkSession)
    slim = files.select("path", "sha256", "mtime", "size_bytes", "content")
    parsed = slim.mapInArrow(_parse_batches, schema.PARSED)
    return parsed.withColumn("scanned_at", F.current_timestamp()).select(schema.WORKBOOK.fieldNames())


def ingest(files: DataFrame) -> DataFrame:
    """Parsed rows as a table in the shared folder.

    For plans that read the rows more than once: the files are parsed once, and
    each reader takes only its own columns.
    """
    path = fresh_path(files.sparkSession, "parsed")
    parse_workbooks(files).write.parquet(path)
    return files.sparkSession.read.parquet(path)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Parsed rows hold no cycles; looking for some, time and again, would take a third of the time that parsing takes.
    was_enabled = gc.isenabled()
    gc.disable()
    try:
        for parsed in _parsed(batches):
            yield parsed
            gc.collect(0)
    finally:
        if was_enabled:
            gc.enable()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    facts: list[tuple] = []
    documents: list[Document] = []
    errors: list[tuple[str, str] | None] = []
    pending = 0
    for batch in batches:
        for *known, content in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
            content = content.as_py()
            if content is None:
                document, error, known[1] = read_file(known[0])
            else:
                document, error = read_workbook(known[0], content)
            facts.append(tuple(known))
            documents.append(document)
            errors.append(error)
            pending += len(content) if content is not None else known[3] or 0
            if pending >= _FLUSH_BYTES or len(facts) >= _FLUSH_ROWS:
                yield _to_batch(facts, documents, errors)
                facts, documents, errors, pending = [], [], [], 0
    if facts:
        yield _to_batch(facts, documents, errors)


# Names that Hadoop has for stores that pyarrow knows by another.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}


def opened(path: str) -> pa.NativeFile:
    """A file as Spark names it, open at its start and seekable."""
    if path.startswith("file:/"):
        return pa.OSFile(unquote(urlsplit(path).path))
    for theirs, ours in _SCHEMES.items():
        path = path.replace(theirs, ours, 1) if path.startswith(theirs) else path
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


class _Digested:
    """A file whose digest is taken as it is read."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.sha = stream, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        piece = self.stream.read(size if size >= 0 else None)
        self.sha.update(piece)
        return piece

    def digest(self) -> str:
        """The digest of the whole file, what is unread included."""
        while self.read(1 << 20):
            pass
        return self.sha.hexdigest()


def read_file(path: str) -> tuple[Document, tuple[str, str] | None, str | None]:
    """Document, error and digest of a file by its path; never raises.

    A plain document is parsed as it is read. A package is read twice, since its directory stands at its end: once for
    the digest, once for the one member that is wanted.
    """
    try:
        with opened(path) as stream:
            whole = _Digested(stream)
            if extension(path) == ".twbx":
                digest = whole.digest()
                stream.seek(0)
                return *_document_or_error(lambda: parse_document(document_bytes(path, stream))), digest
            found = _document_or_error(lambda: parse_document(document_bytes(path, whole)))
            return *found, whole.digest()
    except Exception as problem:  # one bad file must not fail the scan
        return Document(), (type(problem).__name__, str(problem)), None


def file_document(path: str, content: bytes | None) -> bytes:
    """The document of a file, whole; one without content is opened by its path."""
    if content is not None:
        return document_bytes(path, content)
    with opened(path) as stream:
        document = document_bytes(path, stream)
        return document if isinstance(document, bytes) else document.read()


def file_pieces(path: str, content: bytes | None) -> Iterator[bytes]:
    """The document of a file piece by piece, never whole unless it came whole."""
    kind = extension(path)
    if kind not in (".twb", ".twbx"):
        document_bytes(path, b"")  # says which kinds there are
    label = path.rsplit("/", 1)[-1]
    if content is not None:
        yield from document_pieces(content, label) if kind == ".twbx" else [content]
        return
    with opened(path) as stream:
        if kind == ".twbx":
            yield from document_pieces(stream, label)
        else:
            while piece := stream.read(1 << 20):
                yield piece


def read_workbook(path: str, content: bytes) -> tuple[Document, tuple[str, str] | None]:
    """The document and no error, or an empty document and the reason; never raises."""
    return _document_or_error(lambda: parse_document(document_bytes(path, content)))


def _document_or_error(read: Callable[[], Document]) -> tuple[Document, tuple[str, str] | None]:
    try:
        return read(), None
    except DocumentError as problem:
        return Document(), ("parse", str(problem))
    except Exception as problem:  # one bad file must not fail the scan
        return Document(), (type(problem).__name__, str(problem))


def _to_batch(
    facts: list[tuple], documents: list[Document], errors: list[tuple[str, str] | None]
) -> pa.RecordBatch:
    out = to_arrow_schema(schema.PARSED)
    arrays = [pa.array(column, out.field(i).type) for i, column in enumerate(zip(*facts))]
    for name in schema.ATTRIBUTE_COLUMNS:
        arrays.append(pa.array([getattr(d, name) for d in documents], pa.string()))
    for name in schema.CHILD_COLUMNS:
        arrays.append(_child_array([getattr(d, name) for d in documents], out.field(name).type))
    arrays.append(pa.array([d.names_unique() for d in documents], pa.bool_()))
    error_type = out.field("error").type
    arrays.append(pa.array([e and dict(zip(("kind", "message"), e)) for e in errors], error_type))
    return pa.RecordBatch.from_arrays(arrays, schema=out)


def _child_array(per_document: list[list], dtype: pa.ListType) -> pa.Array:
    """List-of-struct column from child rows, built column by column."""
    offsets = [0, *accumulate(map(len, per_document))]
    rows = list(chain.from_iterable(per_document))
    columns = list(zip(*rows)) if rows else [()] * dtype.value_type.num_fields
    parts = [pa.array(c, f.type) for c, f in zip(columns, dtype.value_type)]
    structs = pa.StructArray.from_arrays(parts, fields=list(dtype.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=dtype)


def readable(workbooks: DataFrame) -> DataFrame:
    """Rows that were parsed."""
    return workbooks.filter(F.col("error").isNull())


def unreadable(workbooks: DataFrame) -> DataFrame:
    """Dead letters: ``path, message`` of files that could not be parsed."""
    return workbooks.filter(F.col("error").isNotNull()).select(
        "path", F.concat_ws(": ", "error.kind", "error.message").alias("message")
    )
