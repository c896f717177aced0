import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import configure  # noqa: E402
from quire.sources.workbooks import parse_workbooks  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("quire-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def ingest(spark):
    """Parsed rows of ``{path: xml text or bytes}``."""
    def run(books):
        rows = [(p, bytearray(x.encode() if isinstance(x, str) else x)) for p, x in books.items()]
        return parse_workbooks(spark.createDataFrame(rows, "path string, content binary"))

    return run


def workbook(sources="", sheets="", boards="", version="18.1", extra=""):
    return (
        f'<?xml version="1.0"?><workbook version="{version}">{extra}'
        f"<datasources>{sources}</datasources><worksheets>{sheets}</worksheets>"
        f"<dashboards>{boards}</dashboards></workbook>"
    )


def source(name="sales", body="", connection='<connection class="sqlserver" server="localhost"/>'):
    return f'<datasource name="{name}">{connection}{body}</datasource>'


def column(name, formula=None, **attrs):
    more = "".join(f' {k}="{v}"' for k, v in attrs.items())
    inner = "" if formula is None else f'<calculation formula="{formula}"/>'
    return f'<column name="{name}" datatype="string" role="dimension"{more}>{inner}</column>'


def sheet(name="Sheet", *sources):
    used = "".join(f'<datasource name="{s}"/>' for s in sources)
    return f'<worksheet name="{name}"><table><view><datasources>{used}</datasources></view></table></worksheet>'


def board(name, *sheets):
    inner = "".join(f'<zone type="worksheet" name="{s}"/>' for s in sheets)
    return f'<dashboard name="{name}"><zones><zone id="1" type="layout-basic">{inner}</zone></zones></dashboard>'


CLEAN = workbook(source(body=column("[Amount]")), sheet("Sheet", "sales"), board("Main", "Sheet"))
