"""What large estates ask of the steps that many queries share: no nested rows on the driver, few and slim exchanges."""

import gzip
import json

from conftest import CLEAN, column, source, workbook
from pyspark.sql import functions as F

from quire import catalogue, sample_parts
from quire.functions import text
from quire.operators.upsert import replace_by_newest
from quire.plans import diff
from quire.plans.audit import default_registry
from quire.sinks import documents
from quire.sinks.findings import write_findings_documents, write_findings_sarif

BASE = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_diff_gathers_no_workbooks_on_the_driver(spark, ingest, tmp_path, monkeypatch):
    other = CLEAN.replace("[Amount]", "[Total]")
    for name, xml in (("a", CLEAN), ("b", other)):
        ingest({f"{i}.twb": xml for i in range(5)}).write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    few = diff.diff_workbooks(a, b)
    # The paths of few pairs are sent to all tasks; the sides themselves meet by sort and merge.
    assert "LeftSemi" in plan_of(few) and "SortMergeJoin" in plan_of(few)
    monkeypatch.setattr(diff, "FEW_PAIRS", 0)
    many = diff.diff_workbooks(a, b)
    assert "BroadcastExchange" not in plan_of(many) and "SortMergeJoin" in plan_of(many)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect())) and many.count() == 10
    summary = diff.diff_summary(diff.workbook_pairs(a, b), many)
    assert "BroadcastExchange" not in plan_of(summary) and summary.count() == 5


def test_part_workbooks_are_rendered_by_several_tasks(spark):
    assert sample_parts.documents(spark, BASE).rdd.getNumPartitions() > 1


def test_documents_of_an_estate_are_not_stored(spark):
    catalogue.estate(spark, BASE, "b")
    assert not [key for key in catalogue._STORES if key[2].startswith("documents")]


def test_exported_documents_may_be_compressed(spark, ingest, tmp_path):
    bad = workbook(source("s", column("[email]"), connection='<connection class="c" password="x"/>'), version="9.0")
    registry = default_registry()
    found = registry.run(ingest({f"d/{i}.twb": bad for i in range(20)})).cache()
    for kind, write in (("json", lambda *a, **k: write_findings_documents(*a, **k)),
                        ("sarif", lambda *a, **k: write_findings_sarif(*a, registry.rules, **k))):
        write(found, str(tmp_path / f"{kind}-plain"), documents=2)
        write(found, str(tmp_path / f"{kind}-small"), documents=2, compression="gzip")
        plain, small = ([p for p in sorted((tmp_path / f"{kind}-{name}").rglob("findings-*")) if p.is_file()] for name in ("plain", "small"))
        assert small and [p.name + ".gz" for p in sorted(plain, key=lambda p: p.name)] == sorted(p.name for p in small)
        texts = {p.name: gzip.decompress(p.read_bytes()).decode() for p in small}
        assert texts == {p.name + ".gz": p.read_text() for p in plain} and all(json.loads(t) for t in texts.values())


def test_a_batch_replaces_stored_rows_in_one_exchange(spark):
    rows = lambda *r: spark.createDataFrame(r, "k string, v int").withColumn("bucket", F.crc32("k") % 3)
    old = rows(("a", 1), ("b", 2), ("d", 9), (None, 5), (None, 6))
    new = rows(("a", 3), ("a", 4), ("c", 0), ("d", 1), (None, 7), (None, 8))
    found = replace_by_newest(old, new, "k", "bucket", F.desc("v"))
    assert plan_of(found).count("Exchange") == 1
    assert {(r.k, r.v) for r in found.collect()} == {
        (None, 5), (None, 6), (None, 8), ("a", 4), ("b", 2), ("c", 0), ("d", 1)} and found.count() == 7


def test_documents_exchange_no_text_for_suppliers(spark, tmp_path):
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        # One key comes twice with two names: a data source for each of them.
        "supplier": ([(1, "A", 0, 0.0), (1, "B", 0, 0.0), (2, "C", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(3, "bolt"), (4, "gear")], "p_partkey long, p_name string"),
        "orders": ([(5, "F", "1-URGENT")], "o_orderkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(5, 3, 1, "R"), (5, 3, 1, "N"), (5, 4, 2, None), (5, 4, 9, "N")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    found = {}
    for most in ("10m", "-1"):
        spark.conf.set(threshold, most)
        try:
            docs = catalogue.documents(spark, str(tmp_path))
            found[most] = [tuple(r) for r in docs.collect()]
            # What is above the last exchange makes the texts of columns and of sources.
            above = plan_of(docs).split("Exchange")[0]
            assert "collect_list(struct(p, " in above and "collect_list(struct(s, " in above
        finally:
            spark.conf.unset(threshold)
    [(order, path, xml)] = found["-1"]
    assert found["10m"] == found["-1"] and (order, path) == (5, "estate/5-0.twb")
    assert [xml.count(f'caption="{n}"') for n in "ABC"] == [1, 1, 1] and xml.count('name="[p3]"') == 2 and xml.count("password") == 2


def test_rules_read_their_columns_only_and_build_no_rows_of_other_kinds(spark, ingest, tmp_path):
    body = column("[email]") + column("[c]", "ATTR([email]) + [gone]") + column("[d]", "1 + 1") + column("[e]", " 1  +  1 ")
    books = {"a.twb": workbook(source("s", body, connection='<connection class="c" server="x.org" password="p"/>'), version="9.0"),
             "b.twb": workbook(), "c.twb": workbook(source("t", connection="") + source("t"))}
    ingest(books).write.parquet(str(tmp_path / "estate"))
    found = default_registry().run(spark.read.parquet(str(tmp_path / "estate")))
    scan = found._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "calc_formula" in scan and not any(name in scan for name in ("attrs", "username", "hidden", "zones"))
    # A workbook without a kind, or with fewer of one, shifts no column of another.
    assert sorted((r.workbook_path, r.rule_id, r.location) for r in found.collect()) == [
        ("a.twb", "AUD002", "datasource:s"), ("a.twb", "AUD003", "datasource:s/field:[c]"), ("a.twb", "AUD004", "s/[d]"),
        ("a.twb", "AUD005", "datasource:s/field:[c]"), ("a.twb", "AUD006", "workbook"),
        ("a.twb", "GOV001", "datasource:s/connection:c"), ("a.twb", "GOV002", "datasource:s/connection:c"),
        ("a.twb", "GOV003", "datasource:s/field:[email]"), ("c.twb", "AUD002", "datasource:t"), ("c.twb", "AUD002", "datasource:t")]


def test_names_in_plain_ascii_need_no_unicode(spark):
    """Whatever the way a term is looked for, letters of any case and borders of any kind count as before."""
    names = ["[E-Mail]", "[email_address]", "EMAILED", "Zip\tCode", "Zip\vCode", "a.ssn", "a1ssn", "éssn", "é ssn", "ſSN", "é ſsn",
             "K ZIP CODE", "", None, "x_dob_y", "İp address", "FIRST-Name", "first name", "mrń", "mrn'"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    words = text.field_words(F.col("name"), F.lit(None).cast("string"))
    before = F.coalesce(*[F.when(words.rlike(text.pii_pattern(label)), label) for label in text.PII_TERMS])
    found = rows.select("name", text.pii_label(F.col("name"), F.lit(None).cast("string")).alias("now"), before.alias("before"))
    assert [r.name for r in found.collect() if r.now != r.before] == []
    assert {r.now for r in found.collect()} >= {"email", "address", "ssn", "dob", "personal_name", None}
    assert "octet_length" in plan_of(found)


def test_compressed_documents_are_written_in_pieces(spark, tmp_path, monkeypatch):
    system, path = documents.fs.LocalFileSystem(), str(tmp_path / "d.gz")
    texts = [f"é{i}\n" for i in range(30_000)]
    out = documents._Document(system, path, "gzip")
    for piece in texts:
        out.add(piece)
        assert len(out.waiting) <= documents._PIECE
    out.close()
    whole = (tmp_path / "d.gz").read_bytes()
    assert gzip.decompress(whole).decode() == "".join(texts)
    # The fourth flag of the header says that it was not packed the slowest way.
    assert whole[8] != 2


def test_an_estate_that_is_read_once_is_not_stored(spark, tmp_path):
    for name, kind in (("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"), ("part", "p_partkey long, p_name string"),
                       ("orders", "o_orderkey long, o_orderstatus string, o_orderpriority string"), ("nation", "n_nationkey int, n_name string, n_regionkey int"),
                       ("supplier", "s_suppkey long, s_name string, s_nationkey int"), ("region", "r_regionkey int, r_name string")):
        values = {"lineitem": [(5, 3, 1, "R")], "part": [(3, "bolt")], "orders": [(5, "F", "1-URGENT")], "nation": [(0, "N", 0)],
                  "supplier": [(1, "A", 0)], "region": [(0, "ASIA")]}[name]
        spark.createDataFrame(values, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    place = str(tmp_path)
    told = lambda rows: [str(r) for r in rows.drop("scanned_at").collect()]
    found = catalogue.QUERIES["audit_all"](spark, place).count()
    listed = catalogue.QUERIES["inv_upsert_then_list"](spark, place).count()
    assert found and listed == 1 and not [key for key in catalogue._STORES if key[1] == place and key[2].startswith("estate")]
    once = told(catalogue.estate_read_once(spark, place))
    assert once == told(catalogue.estate(spark, place)) == told(catalogue.estate_read_once(spark, place))
    assert "MapInArrow" not in plan_of(catalogue.estate_read_once(spark, place))
