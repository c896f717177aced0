"""Row types: the nested workbook document, findings and diff entries."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


# Children hang one level below the workbook row and carry their parent's position
# and name, so a scan can read single child columns (``fields.name``) on their own.
DATASOURCE = _struct(pos=_I, name=_S, caption=_S, version=_S)
CONNECTION = _struct(
    ds_pos=_I, datasource=_S, pos=_I, conn_class=_S, server=_S, dbname=_S, username=_S,
    has_password=_B, filename=_S, port=_S, authentication=_S, attrs=T.MapType(_S, _S),
)
FIELD = _struct(
    ds_pos=_I, datasource=_S, pos=_I, name=_S, datatype=_S, role=_S, type=_S, caption=_S,
    aggregation=_S, hidden=_B, is_calculated=_B, calc_formula=_S, calc_class=_S,
)
WORKSHEET = _struct(pos=_I, name=_S, datasource_names=T.ArrayType(_S))
DASHBOARD = _struct(pos=_I, name=_S, referenced_worksheets=T.ArrayType(_S))
ZONE = _struct(
    dash_pos=_I, zone_path=_S, depth=_I, id=_S, zone_type=_S, name=_S, worksheet_ref=_S,
)
ERROR = _struct(kind=_S, message=_S)

# What the parser adds to the file facts.
ATTRIBUTE_COLUMNS = dict(version=_S, source_build=_S, source_platform=_S)
CHILD_COLUMNS = dict(
    datasources=DATASOURCE, connections=CONNECTION, fields=FIELD,
    worksheets=WORKSHEET, dashboards=DASHBOARD, zones=ZONE,
)
DOCUMENT_COLUMNS = dict(
    **ATTRIBUTE_COLUMNS,
    **{name: T.ArrayType(child) for name, child in CHILD_COLUMNS.items()},
    names_unique=_B,  # no two parts of the workbook share a name that identifies one
    error=ERROR,
)
FILE_COLUMNS = dict(path=_S, sha256=_S, mtime=T.DoubleType(), size_bytes=T.LongType())

PARSED = _struct(**FILE_COLUMNS, **DOCUMENT_COLUMNS)
WORKBOOK = _struct(**FILE_COLUMNS, scanned_at=T.TimestampType(), **DOCUMENT_COLUMNS)

FINDING_COLUMNS = [
    "rule_id", "severity", "title", "message",
    "workbook_path", "location", "remediation", "properties",
]
FINDING = _struct(
    rule_id=_S, severity=_S, title=_S, message=_S, workbook_path=_S,
    location=_S, remediation=_S, properties=T.MapType(_S, _S),
)
