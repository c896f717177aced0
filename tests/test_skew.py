"""One order, and so one workbook's worth of rows, holds a third of the line items."""

import glob
import os
import shutil

import duckdb
import pytest

from __spark_entry__ import queries
from check_oracles import compare
from quire import catalogue

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for file in glob.glob(f"{BASE}/*.parquet"):
        if os.path.basename(file) not in ("lineitem.parquet", "documents.parquet"):
            shutil.copy(file, folder)
    parts = duckdb.sql(f"SELECT count(*) FROM '{BASE}/part.parquet'").fetchall()[0][0]
    duckdb.sql(f"""
        COPY (SELECT * EXCLUDE (i) REPLACE (
                CASE WHEN i % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
                CASE WHEN i % 3 = 0 THEN i % {parts} ELSE l_partkey END AS l_partkey)
              FROM (SELECT *, row_number() OVER () AS i FROM '{BASE}/lineitem.parquet'))
        TO '{folder}/lineitem.parquet' (FORMAT parquet)""")
    duckdb.sql(f"""
        COPY (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'one  text' ELSE text END AS text)
              FROM '{BASE}/documents.parquet')
        TO '{folder}/documents.parquet' (FORMAT parquet)""")
    return str(folder)


def test_a_hot_order_is_split_into_documents_of_bounded_size(spark, skewed):
    docs = catalogue.documents(spark, skewed)
    hot = docs.filter("o = 1").selectExpr("path", "length(xml) AS n").collect()
    assert len(hot) >= 2 and all(r.path.startswith("estate/1-") for r in hot)
    fields = catalogue.estate(spark, skewed).selectExpr("max(size(datasources))", "max(size(fields))").first()
    assert fields[1] <= 2 * 1200


@pytest.mark.parametrize("name", [
    "inv_list_workbooks", "inv_server_summary", "inv_stats", "table_fields", "audit_all",
    "diff_workbooks", "norm_duplicates", "export_sarif", "dup_text_documents",
])
def test_answers_hold_under_skew(spark, skewed, name):
    assert name in queries()
    assert compare(spark, skewed, name) is None
