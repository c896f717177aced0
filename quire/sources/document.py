"""One workbook document (bytes) to one nested record.

Works on bytes so that the XML declaration or byte-order mark decides the
encoding, and streams through expat, so no element tree is built. A password
value is reduced to "present or not" the moment its attribute is seen.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, BinaryIO
from xml.parsers import expat

from quire.sources.package import DocumentError, read_document

# Attribute names with a column of their own, and the class of
# a calculation that names none.
CONNECTION_ATTRIBUTES = (
    "class", "server", "dbname", "username", "password",
    "filename", "port", "authentication",
)
DEFAULT_CALCULATION_CLASS = "tableau"

_CONNECTION_ATTRIBUTES = frozenset(CONNECTION_ATTRIBUTES)
_NS = "}"
_WORKSHEET_SOURCE = ["worksheets", "worksheet", "table", "view", "datasources"]


def extension(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def document_bytes(path: str, content: bytes | BinaryIO) -> bytes | BinaryIO:
    """XML of a plain or packaged workbook, chosen by file extension; an open plain file comes back as it is."""
    kind = extension(path)
    if kind == ".twb":
        return content
    if kind == ".twbx":
        return read_document(content, path.rsplit("/", 1)[-1])
    raise DocumentError(f"unsupported extension '{kind}', expected .twb or .twbx")


def refuse_doctype(*_: Any) -> None:
    raise DocumentError("document type declarations are refused")


@dataclass
class Document:
    """One document; children are rows in the column order of the schema."""

    version: str | None = None
    source_build: str | None = None
    source_platform: str | None = None
    datasources: list[Sequence] = field(default_factory=list)
    connections: list[Sequence] = field(default_factory=list)
    fields: list[Sequence] = field(default_factory=list)
    worksheets: list[Sequence] = field(default_factory=list)
    dashboards: list[Sequence] = field(default_factory=list)
    zones: list[Sequence] = field(default_factory=list)

    def names_unique(self) -> bool:
        """Whether data sources, their connections and fields, and dashboards can
        each be told apart by what identifies them."""
        return (
            _distinct([source[1] for source in self.datasources])
            and _distinct([board[1] for board in self.dashboards])
            and _distinct([(f[1], f[3]) for f in self.fields])
            # One connection per data source needs no look at what it leads to.
            and (_distinct([c[1] for c in self.connections])
                 # Class, server, database and file; a missing one counts as empty.
                 or _distinct([(c[1], "|".join(part or "" for part in (*c[3:6], c[8]))) for c in self.connections]))
        )


def _distinct(names: list) -> bool:
    return len(set(names)) == len(names)


def parse_document(xml: bytes | BinaryIO) -> Document:
    """Record of one document; raises ``DocumentError`` if it is malformed."""
    document = Document()
    parser = expat.ParserCreate(namespace_separator=_NS)
    parser.buffer_text = True
    parser.StartDoctypeDeclHandler = refuse_doctype
    parser.StartElementHandler, parser.EndElementHandler = _handlers(document)
    try:
        if isinstance(xml, bytes):
            parser.Parse(xml, True)
        else:
            while piece := xml.read(1 << 18):
                parser.Parse(piece, False)
            parser.Parse(b"", True)
    except expat.ExpatError as problem:
        raise DocumentError(str(problem)) from problem
    for board in document.dashboards:
        board[2] = sorted(board[2])
    return document


def _handlers(document: Document) -> tuple[Callable, Callable]:
    """Handlers of start and end tags that collect the modelled elements while expat walks the document.

    The first runs once per tag of the whole estate, so what it needs is held in shared variables instead of attributes
    of an object. What an end tag would undo is undone by the next start tag, which knows its depth: no Python runs at
    an end tag, expat itself takes the innermost open tag away.
    """
    open_: deque[str] = deque()           # the open tags, innermost first
    push = open_.appendleft
    section: Callable | None = None       # what reads the elements of the open section
    source: tuple[int, str] | None = None
    connections_seen = fields_seen = 0    # in the open source
    column: list | None = None
    calculation_seen = False
    sheet_sources: list[str] = []
    on_path = 1                           # the depth down to which the open elements lead to a worksheet's sources
    board_refs: set[str] = set()
    in_zones = False                      # below an element that holds the zones of a dashboard
    zone_counts: list[int] = []           # zones so far, per open zone level
    datasources, connections, fields = document.datasources, document.connections, document.fields

    def in_datasources(name: str, depth: int, attrs: dict[str, str]) -> None:
        nonlocal source, connections_seen, fields_seen, column, calculation_seen
        get = attrs.get
        if depth == 2:
            source = None
            if name == "datasource":
                source = (len(datasources), get("name", ""))
                connections_seen = fields_seen = 0
                datasources.append((*source, get("caption"), get("version")))
            return
        if depth == 3:
            column = None
        if source is None:
            pass
        elif name == "connection":
            connections.append((
                *source, connections_seen, get("class"), get("server"), get("dbname"),
                get("username"), bool(get("password")), get("filename"), get("port"),
                get("authentication"), _other_attributes(attrs),
            ))
            connections_seen += 1
        elif depth == 3 and name == "column":
            column = [
                *source, fields_seen, get("name", ""), get("datatype"), get("role"),
                get("type"), get("caption"), get("aggregation"),
                get("hidden", "").lower() == "true", False, None, None,
            ]
            fields_seen += 1
            calculation_seen = False
            fields.append(column)
        elif depth == 4 and name == "calculation" and column is not None:
            # Only the first calculation child counts, and only with a formula.
            if not calculation_seen and "formula" in attrs:
                column[-3:] = True, attrs["formula"], get("class", DEFAULT_CALCULATION_CLASS)
            calculation_seen = True

    def in_worksheets(name: str, depth: int, attrs: dict[str, str]) -> None:
        nonlocal sheet_sources, on_path
        if depth < 6:
            if depth == 2 and name == "worksheet":
                sheet_sources = []
                document.worksheets.append((len(document.worksheets), attrs.get("name", ""), sheet_sources))
            if on_path >= depth - 1:
                on_path = depth if name == _WORKSHEET_SOURCE[depth - 1] else depth - 1
        elif depth == 6 and on_path == 5 and name == "datasource":
            if named := attrs.get("name"):
                sheet_sources.append(named)

    def in_dashboards(name: str, depth: int, attrs: dict[str, str]) -> None:
        nonlocal zone_counts, board_refs, in_zones
        if depth == 2:
            # zone_counts holds one number per dashboard, then one per open zone.
            zone_counts = [0] if name == "dashboard" else []
            board_refs = set()
            if name == "dashboard":
                boards = document.dashboards
                boards.append([len(boards), attrs.get("name", ""), board_refs])
        elif depth == 3:
            in_zones = name == "zones" and bool(zone_counts)
        elif in_zones:
            del zone_counts[depth - 3:]
            if name == "zone" and len(zone_counts) == depth - 3:
                zone(attrs)

    def zone(attrs: dict[str, str]) -> None:
        zone_counts[-1] += 1
        kind, name = attrs.get("type"), attrs.get("name")
        reference = name if kind == "worksheet" else None
        if reference:
            board_refs.add(reference)
        document.zones.append((
            len(document.dashboards) - 1, "/".join(map(str, zone_counts)),
            len(zone_counts) - 1, attrs.get("id"), kind, name, reference,
        ))
        zone_counts.append(0)

    sections = {"datasources": in_datasources, "worksheets": in_worksheets, "dashboards": in_dashboards}

    def start(tag: str, attrs: dict[str, str]) -> None:
        nonlocal section
        depth = len(open_)
        push(tag)
        if depth > 1:
            if section is not None:
                section(tag.rsplit(_NS, 1)[-1] if _NS in tag else tag, depth, attrs)
            return
        name = tag.rsplit(_NS, 1)[-1]
        if depth == 1:
            section = sections.get(name)
        else:
            if name != "workbook":
                raise DocumentError(f"root element is '{name}', expected 'workbook'")
            document.version = attrs.get("version")
            document.source_build = attrs.get("source-build")
            document.source_platform = attrs.get("source-platform")

    # An end tag names the innermost open element, which is the first that is compared.
    return start, open_.remove


def _other_attributes(attrs: dict[str, str]) -> list[tuple[str, str]]:
    """Attributes without a column of their own; nothing password-like is kept."""
    other = {}
    if attrs.keys() <= _CONNECTION_ATTRIBUTES:
        return []
    for name, value in attrs.items():
        if name in CONNECTION_ATTRIBUTES:
            continue
        local = name.rsplit(_NS, 1)[-1]
        if local not in CONNECTION_ATTRIBUTES and "password" not in local.lower():
            other[local] = value
    return list(other.items())
