import json

import pyarrow as pa
import pytest
from conftest import CLEAN, column, source, workbook
from pyspark.sql import functions as F

from quire.functions.text import artifact_uri, rule_slug
from quire.plans.audit import default_registry
from quire.sinks.documents import _DocumentWriter, _Written, file_name, write_documents
from quire.sinks.findings import write_findings_documents, write_findings_json, write_findings_sarif


@pytest.fixture(scope="module")
def found(ingest):
    bad = workbook(source("s", column("[email]") + column("[c]", "[gone]"),
                          connection='<connection class="c" password="hunter2"/>'), version="9.0")
    return default_registry().run(ingest({"dir/bad.twb": bad, "clean.twb": CLEAN})).cache()


def documents_in(folder):
    assert (folder / "_SUCCESS").exists()
    return [p.read_text() for p in sorted(folder.rglob("*")) if p.is_file() and p.suffix in (".json", ".sarif")]


def test_json_envelope(found, tmp_path):
    write_findings_documents(found, str(tmp_path / "d"))
    texts = documents_in(tmp_path / "d")
    assert len(texts) == 1 and "hunter2" not in texts[0]
    document = json.loads(texts[0])
    assert set(document) == {"tool", "version", "findings"}
    by_rule = {f["rule_id"]: f for f in document["findings"]}
    assert set(by_rule) == {"AUD002", "AUD005", "AUD006", "GOV001", "GOV003"}
    assert {f["workbook_path"] for f in document["findings"]} == {"dir/bad.twb"}
    assert by_rule["GOV003"]["properties"] == {"pattern": "email"} and by_rule["GOV001"]["properties"] == {}
    assert set(by_rule["AUD006"]) == {
        "rule_id", "severity", "title", "message", "workbook_path", "location", "remediation", "properties"}


def test_documents_are_streams_of_their_rows(spark, tmp_path):
    rows = [(k, p, json.dumps({"x": f"{k}{i}"})) for k in ("a/b", "a_b", "") for p in (0, 1) for i in range(50)]
    rows += [("a/b", 0, json.dumps({"x": "a/b1"}))] * 3 + [("only rules", 0, "{}"), ("only results", 1, "{}"), (None, 1, "{}")]
    frame = spark.createDataFrame(rows, "key string, part int, text string").repartition(7)
    write_documents(frame, str(tmp_path / "d"), "json", '{"rules": [\n', '\n], "results": [\n', "\n]}")
    parsed = [json.loads(t) for t in documents_in(tmp_path / "d")]
    # A null key has a document of its own.
    assert sorted((len(d["rules"]), len(d["results"])) for d in parsed) == [
        (0, 1), (0, 1), (1, 0), (50, 50), (50, 50), (50, 50)]
    assert file_name("a/b", "json") != file_name("a_b", "json")
    write_documents(frame.limit(0), str(tmp_path / "none"), "json", "[", "", "]")
    assert documents_in(tmp_path / "none") == []


def batches(*rows):
    """Each row in a batch of its own."""
    return iter([pa.RecordBatch.from_pylist([dict(zip(("key", "part", "text"), row))]) for row in rows])


def test_only_committed_attempts_stay(tmp_path):
    options = {"path": str(tmp_path / "d"), "extension": "json", "head": "[\n", "middle": "", "tail": "]"}
    writer = _DocumentWriter(options)
    first, again = writer.write(batches(("k", 1, "1"))), writer.write(batches(("k", 1, "1"), ("l", 1, "2")))
    writer.commit([again, _Written(None), None])
    assert [p.name for p in (tmp_path / "d").iterdir() if p.is_dir()] == [again.folder] and first.folder != again.folder
    assert sorted(documents_in(tmp_path / "d")) == ["[\n1]", "[\n2]"]
    other = _DocumentWriter(options)
    other.write(batches(("k", 1, "3")))
    other.abort([])
    assert sorted(documents_in(tmp_path / "d")) == ["[\n1]", "[\n2]"]


def test_json_lines(spark, found, tmp_path):
    write_findings_json(found, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 5


def test_sarif(found, tmp_path):
    registry = default_registry()
    write_findings_sarif(found, str(tmp_path / "d"), registry.rules)
    texts = documents_in(tmp_path / "d")
    assert len(texts) == 1
    document = json.loads(texts[0])
    assert document["version"] == "2.1.0" and document["$schema"].endswith("sarif-schema-2.1.0.json")
    run = document["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == [r.meta.id for r in registry.rules]
    results = {r["ruleId"]: r for r in run["results"]}
    assert results["AUD005"]["level"] == "error" and results["AUD006"]["level"] == "note"
    location = results["AUD005"]["locations"][0]
    assert location["physicalLocation"]["artifactLocation"]["uri"] == "dir/bad.twb"
    assert location["logicalLocations"] == [{"fullyQualifiedName": "datasource:s/field:[c]"}]
    assert results["AUD005"]["properties"]["referenced"] == "[gone]"
    assert "**Remediation:**" in results["AUD005"]["message"]["markdown"]
    assert results["AUD005"]["properties"]["remediation"]


def test_sarif_declares_rules_it_was_not_given(found, tmp_path):
    write_findings_sarif(found, str(tmp_path / "d"))
    document = json.loads(documents_in(tmp_path / "d")[0])
    rules = document["runs"][0]["tool"]["driver"]["rules"]
    assert sorted(r["id"] for r in rules) == ["AUD002", "AUD005", "AUD006", "GOV001", "GOV003"]
    assert all("properties" not in r for r in rules)


@pytest.mark.parametrize("path,uri", [
    ("C:\\a b\\x.twb", "file:///C:/a%20b/x.twb"), ("/tmp/ü (1).twb", "file:///tmp/%C3%BC%20(1).twb"),
    ("rel\\x y.twb", "rel/x y.twb"), ("\\\\srv\\s\\x.twb", "file://srv/s/x.twb"), ("/a+b$c.twb", "file:///a+b$c.twb"),
])
def test_artifact_uri(spark, path, uri):
    row = spark.createDataFrame([(path,)], "p string").select(artifact_uri(F.col("p"))).first()
    assert row[0] == uri


def test_slug(spark):
    row = spark.createDataFrame([("AUD001", "unused work-sheet (x)")], "i string, t string")
    assert row.select(rule_slug(F.col("i"), F.col("t"))).first()[0] == "AUD001UnusedWorkSheetX"


def test_few_documents_share_all_workbooks(spark, ingest, tmp_path):
    """Dealt to a number of documents: every finding once, a workbook in one document only, rules declared once each."""
    bad = workbook(source("s", column("[email]"), connection='<connection class="c" password="x"/>'), version="9.0")
    registry = default_registry()
    found = registry.run(ingest({f"d/{i}.twb": bad for i in range(20)})).cache()
    write_findings_documents(found, str(tmp_path / "j"), documents=3)
    parts = [json.loads(t)["findings"] for t in documents_in(tmp_path / "j")]
    paths = [{f["workbook_path"] for f in p} for p in parts]
    assert 1 < len(parts) <= 3 and sum(map(len, parts)) == found.count() and sum(map(len, paths)) == 20
    write_findings_sarif(found, str(tmp_path / "s"), registry.rules[:1], documents=3)
    logs = [json.loads(t)["runs"][0] for t in documents_in(tmp_path / "s")]
    for run in logs:
        declared = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert len(declared) == len(set(declared)) and {r["ruleId"] for r in run["results"]} <= set(declared)
    assert sum(len(run["results"]) for run in logs) == found.count()
    # No workbooks at all still make a valid call.
    write_findings_documents(found.limit(0), str(tmp_path / "none"), documents=0)
    assert documents_in(tmp_path / "none") == []
