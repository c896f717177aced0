"""Bounded read of the one workbook document inside a zipped package."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

# Limits a package must keep to be opened.
MAX_UNCOMPRESSED_BYTES = 100 * 1024 * 1024
MAX_COMPRESSION_RATIO = 100

_CHUNK = 1 << 16


class DocumentError(Exception):
    """The file cannot be read as a workbook document."""


def read_document(content: bytes | BinaryIO, label: str = "package") -> bytes:
    """Bytes of the single ``.twb`` member of a package."""
    return b"".join(document_pieces(content, label))


def document_pieces(content: bytes | BinaryIO, label: str = "package") -> Iterator[bytes]:
    """The single ``.twb`` member of a package (its bytes or an open file) piece by piece, refusing oversized or
    bomb-like ones.
    """
    try:
        opened = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    except ValueError as problem:  # a store's file that is too short to look at its end
        raise zipfile.BadZipFile("File is not a zip file") from problem
    with opened as archive:
        documents = [m for m in archive.infolist() if m.filename.lower().endswith(".twb")]
        if not documents:
            raise DocumentError(f"{label} holds no workbook document")
        if len(documents) > 1:
            names = ", ".join(m.filename for m in documents)
            raise DocumentError(f"{label} holds several workbook documents: {names}")
        member = documents[0]
        if member.file_size > MAX_UNCOMPRESSED_BYTES:
            raise DocumentError(
                f"'{member.filename}' declares {member.file_size} bytes, "
                f"above the limit of {MAX_UNCOMPRESSED_BYTES}"
            )
        if member.compress_size > 0:
            ratio = member.file_size // member.compress_size
            if ratio > MAX_COMPRESSION_RATIO:
                raise DocumentError(
                    f"'{member.filename}' has a compression ratio of {ratio}:1, "
                    f"above the limit of {MAX_COMPRESSION_RATIO}:1"
                )
        # The declared size may be wrong, so the bytes are counted as they come.
        total = 0
        with archive.open(member) as stream:
            while piece := stream.read(_CHUNK):
                total += len(piece)
                if total > MAX_UNCOMPRESSED_BYTES:
                    raise DocumentError(
                        f"'{member.filename}' grew past {MAX_UNCOMPRESSED_BYTES} bytes while being read"
                    )
                yield piece
