"""Flat views over the nested workbook rows.

Each view is a chain of narrow projections and generators, so it adds no
shuffle, and the scan below it reads only the nested columns it asks for.
Natural keys take the place of surrogate ids: ``path`` plus positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema
from quire.functions.text import references_user_identity
from quire.sources.workbooks import readable


def workbooks(estate: DataFrame) -> DataFrame:
    return readable(estate).select(
        "path", "sha256", "mtime", "size_bytes",
        "version", "source_build", "source_platform", "scanned_at",
    )


def members(child: str, *columns: str) -> Column:
    """The array ``child`` narrowed to some columns.

    Naming the columns one by one is what lets the scan skip all others;
    exploding the array of full structs would read every one of them.
    """
    return F.arrays_zip(*[F.col(f"{child}.{c}").alias(c) for c in columns])


def children(
    estate: DataFrame, child: str, columns: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """One row per child: ``path``, the carried workbook columns, ``columns``."""
    rows = readable(estate).select("path", *carried, F.explode(members(child, *columns)).alias("r"))
    return rows.select("path", *carried, *[F.col(f"r.{c}").alias(c) for c in columns])


def size_of(child: str) -> Column:
    """Number of children, read from their smallest column."""
    key = "zone_path" if child == "zones" else "pos"
    return F.size(f"{child}.{key}")


def _table(estate: DataFrame, child: str, key: str, *columns: str) -> DataFrame:
    rows = children(estate, child, ["pos", *columns])
    return rows.withColumnRenamed("pos", key)


def datasources(estate: DataFrame) -> DataFrame:
    return _table(estate, "datasources", "ds_pos", "name", "caption", "version")


def connections(estate: DataFrame) -> DataFrame:
    return _table(
        estate, "connections", "conn_pos", "ds_pos", "datasource", "conn_class", "server", "dbname",
        "username", "has_password", "filename", "port", "authentication",
    )


def fields(estate: DataFrame) -> DataFrame:
    rows = _table(
        estate, "fields", "field_pos", "ds_pos", "datasource", "name", "caption",
        "datatype", "role", "is_calculated", "calc_formula",
    )
    return rows.withColumn("references_username", references_user_identity(F.col("calc_formula")))


def worksheets(estate: DataFrame) -> DataFrame:
    return _table(estate, "worksheets", "ws_pos", "name")


def dashboards(estate: DataFrame) -> DataFrame:
    rows = _table(estate, "dashboards", "dash_pos", "name", "referenced_worksheets")
    return rows.withColumn("referenced_worksheets", F.array_join("referenced_worksheets", ","))


def zones(estate: DataFrame) -> DataFrame:
    """The zone trees, one row per zone; ``zone_path`` tells the nesting."""
    return children(estate, "zones", schema.ZONE.fieldNames())


VIEWS = {
    "workbooks": workbooks,
    "datasources": datasources,
    "connections": connections,
    "fields": fields,
    "worksheets": worksheets,
    "dashboards": dashboards,
}


def register_views(estate: DataFrame, prefix: str = "") -> None:
    """Temp views of the six tables, for ad-hoc SQL."""
    for name, build in VIEWS.items():
        build(estate).createOrReplaceTempView(prefix + name)


def query(spark: SparkSession, estate: DataFrame, sql: str, **parameters: object) -> DataFrame:
    """Ad-hoc SQL over the six tables with named parameters (``:name``)."""
    bound = {name: build(estate) for name, build in VIEWS.items()}
    return spark.sql(_with_tables(sql), args=parameters or None, **bound)


def _with_tables(sql: str) -> str:
    """Bind the table names to the given frames instead of session-wide views."""
    ctes = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in VIEWS)
    return f"WITH {ctes} {sql}"
