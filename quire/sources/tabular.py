"""Table sources of a pipeline."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.split_csv import cells


class Source(Protocol):
    # Whether the number of rows can be had without reading them.
    counts_cheaply: bool

    def read(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class CsvSource:
    """Delimited text; every column is text and an empty cell is empty text.

    A quoted field may hold separators, quotes (doubled) and line ends, which come back unchanged. Files are read by
    many tasks whatever their size (see ``split_csv``); ``multiline: false`` says that a row is a line, whatever quotes
    it holds open, and saves the first pass. Empty lines are left out; a row whose number of fields differs from that of the first row fails the run.
    """

    path: str
    has_header: bool = True
    separator: str = ","
    multiline: bool = True
    counts_cheaply = False

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.multiline:
            return self._read_lines(spark)
        rows = cells(spark, self.path, self.separator)
        top = rows.where("first").orderBy("file").select("cells").first()
        if top is None:
            return spark.createDataFrame([], "")
        width = len(top["cells"])
        names = top["cells"] if self.has_header else [f"Column{i + 1}" for i in range(width)]
        body = rows.where("NOT first") if self.has_header else rows
        checked = F.when(F.size("cells") == width, F.col("cells")).otherwise(F.raise_error(F.concat(
            F.lit(f"malformed CSV: a row of {width} fields expected, found "), F.size("cells").cast("string"), F.lit(" in "),
            F.col("file"))).cast("array<string>"))
        return body.select(checked.alias("cells")).select(*[F.col("cells")[i].alias(name) for i, name in enumerate(names)])

    def _read_lines(self, spark: SparkSession) -> DataFrame:
        rows = (
            spark.read.option("header", self.has_header).option("sep", self.separator)
            .option("inferSchema", False).option("escape", '"').option("mode", "FAILFAST")
            .csv(self.path)
        )
        if not self.has_header:
            rows = rows.toDF(*[f"Column{i + 1}" for i in range(len(rows.columns))])
        return rows.na.fill("")


@dataclass(frozen=True)
class ParquetSource:
    path: str
    counts_cheaply = True

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


# Connection string keys (SQL Server) and their JDBC properties.
_CONNECTION_KEYS = {
    "database": "databaseName", "initial catalog": "databaseName",
    "user id": "user", "uid": "user", "user": "user",
    "password": "password", "pwd": "password",
    "encrypt": "encrypt", "trustservercertificate": "trustServerCertificate",
    "integrated security": "integratedSecurity", "trusted_connection": "integratedSecurity",
    "application name": "applicationName",
}


def jdbc_url(connection_string: str) -> str:
    """JDBC address of a connection string; one that is an address is kept."""
    if connection_string.startswith("jdbc:"):
        return connection_string
    server, properties = None, []
    for part in filter(None, (p.strip() for p in connection_string.split(";"))):
        key, _, value = part.partition("=")
        key = key.strip().lower()
        if key in ("server", "data source", "address", "addr"):
            server = value.strip().removeprefix("tcp:").replace(",", ":")
        elif key in _CONNECTION_KEYS:
            name, value = _CONNECTION_KEYS[key], value.strip()
            if value.lower() in ("yes", "sspi"):
                value = "true"
            elif value.lower() == "no":
                value = "false"
            properties.append(f"{name}={value}")
    if not server:
        raise ValueError("connection string names no server")
    return ";".join([f"jdbc:sqlserver://{server}", *properties])


@dataclass(frozen=True)
class JdbcSource:
    """Result of a database query, sent as it stands.

    One query is one task. Naming a numeric or time column with its bounds
    makes it ``num_partitions`` range queries that executors run side by side.
    """

    query: str
    connection_string: str = ""
    connection_string_env: str = ""
    partition_column: str = ""
    lower_bound: str = ""
    upper_bound: str = ""
    num_partitions: str = ""
    counts_cheaply = False

    def __post_init__(self) -> None:
        if not (self.connection_string or self.connection_string_env):
            raise ValueError("the source needs 'connection_string' or 'connection_string_env'")
        split = (self.partition_column, self.lower_bound, self.upper_bound, self.num_partitions)
        if any(split) and not all(split):
            raise ValueError(
                "a partitioned read needs partition_column, lower_bound, upper_bound and num_partitions")

    def resolved_connection(self) -> str:
        if self.connection_string:
            return self.connection_string
        value = os.environ.get(self.connection_string_env, "")
        if not value:
            raise ValueError(f"environment variable '{self.connection_string_env}' is unset or empty")
        return value

    def options(self) -> dict[str, str]:
        options = {"url": jdbc_url(self.resolved_connection())}
        if not self.partition_column:
            return options | {"query": self.query}
        return options | {
            "dbtable": f"({self.query}) q", "partitionColumn": self.partition_column,
            "lowerBound": self.lower_bound, "upperBound": self.upper_bound,
            "numPartitions": self.num_partitions,
        }

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).load()
