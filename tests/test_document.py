import io
import zipfile
from types import BuiltinMethodType

import pytest
from conftest import CLEAN, board, column, sheet, source, workbook

from quire.sources.document import Document, _handlers, document_bytes, parse_document
from quire.sources.package import DocumentError, read_document
from quire.sources.workbooks import read_workbook, readable, unreadable


def test_all_parts_of_a_document():
    xml = workbook(
        source("a", column("[x]", caption="X", hidden="TRUE") + column("[y]", "[x] * 2")),
        sheet("s1", "a", ""), board("d", "s1", "s2"), extra="<preferences/>",
    )
    doc = parse_document(xml.encode())
    assert doc.version == "18.1" and doc.source_build is None
    assert doc.datasources == [(0, "a", None, None)]
    assert doc.connections == [
        (0, "a", 0, "sqlserver", "localhost", None, None, False, None, None, None, [])]
    plain, calculated = doc.fields
    assert plain == [0, "a", 0, "[x]", "string", "dimension", None, "X", None, True, False, None, None]
    assert calculated[-3:] == [True, "[x] * 2", "tableau"]
    assert doc.worksheets == [(0, "s1", ["a"])]
    assert doc.dashboards == [[0, "d", ["s1", "s2"]]]
    assert [z[1] for z in doc.zones] == ["1", "1/1", "1/2"]


def test_connections_at_any_depth_but_columns_only_as_children():
    nested = '<connection class="federated"><named><connection class="excel-direct" filename="f"/></named></connection>'
    deep = "<group>" + column("[deep]") + "</group>"
    doc = parse_document(workbook(source(connection=nested, body=deep)).encode())
    assert [c[3] for c in doc.connections] == ["federated", "excel-direct"]
    assert doc.fields == []


def test_password_is_reduced_to_its_presence():
    connection = '<connection class="c" password="s3cret" workgroup-password="s3cret" odbc="x"/>'
    doc = parse_document(workbook(source(connection=connection)).encode())
    assert doc.connections[0][7] is True
    assert doc.connections[0][-1] == [("odbc", "x")]
    assert "s3cret" not in repr(doc)
    empty = parse_document(workbook(source(connection='<connection password=""/>')).encode())
    assert empty.connections[0][7] is False


def test_calculation_without_formula_does_not_count():
    body = '<column name="[a]"><calculation class="bin"/></column>'
    assert parse_document(workbook(source(body=body)).encode()).fields[0][-3:] == [False, None, None]


def test_namespace_prefixes_are_ignored():
    xml = (
        '<t:workbook xmlns:t="urn:t" version="18.1"><t:datasources><t:datasource name="p">'
        '<t:connection class="c" t:server="no" server="yes"/></t:datasource></t:datasources></t:workbook>'
    )
    doc = parse_document(xml.encode())
    assert doc.datasources[0][1] == "p" and doc.connections[0][4] == "yes"


def test_zones_nest_and_dashboards_follow_each_other():
    deep = (
        '<dashboard name="one"><zones><zone><zone><zone type="worksheet" name="w3"/></zone>'
        '<zone type="worksheet" name="w1"/></zone><zone type="text" name="w9"/></zones></dashboard>'
    )
    doc = parse_document(workbook(boards=deep + board("two", "w2")).encode())
    assert doc.dashboards == [[0, "one", ["w1", "w3"]], [1, "two", ["w2"]]]
    assert [(z[0], z[1], z[2]) for z in doc.zones] == [
        (0, "1", 0), (0, "1/1", 1), (0, "1/1/1", 2), (0, "1/2", 1), (0, "2", 0), (1, "1", 0), (1, "1/1", 1)]


@pytest.mark.parametrize("encode", [
    lambda x: x.encode(),
    lambda x: b"\xef\xbb\xbf" + x.encode(),
    lambda x: x.replace('version="1.0"', 'version="1.0" encoding="utf-16"').encode("utf-16"),
    lambda x: x.replace("><", ">\r\n<").encode(),
])
def test_encodings_and_line_ends_give_the_same_record(encode):
    text = workbook(source("Größe 数", column("[é]", "[é] + 1")))
    assert parse_document(encode(text)) == parse_document(text.encode())


@pytest.mark.parametrize("xml", [
    b"", b"<workbook", b"<report/>", b"<!DOCTYPE workbook><workbook/>",
    '<!DOCTYPE w [<!ENTITY a "b">]><workbook/>'.encode("utf-16"), b"<a:workbook/>",
])
def test_bad_documents_are_refused(xml):
    with pytest.raises(DocumentError):
        parse_document(xml)


def packed(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name.replace("__", "."), data)
    return buffer.getvalue()


def test_package_rules():
    assert read_document(packed(book__TWB=CLEAN, data__csv="1")) == CLEAN.encode()
    with pytest.raises(DocumentError, match="holds no"):
        read_document(packed(data__csv="1"))
    with pytest.raises(DocumentError, match="several"):
        read_document(packed(a__twb=CLEAN, b__twb=CLEAN))
    with pytest.raises(DocumentError, match="ratio"):
        read_document(packed(a__twb=b"\0" * 1_000_000))


def test_extension_decides():
    assert document_bytes("x/A.TWB", b"z") == b"z"
    with pytest.raises(DocumentError, match="unsupported"):
        document_bytes("x/a.xml", b"z")


def test_bad_file_becomes_an_error_row():
    assert read_workbook("a.twb", b"<")[1][0] == "parse"
    assert read_workbook("a.twbx", b"not a zip") == (Document(), ("BadZipFile", "File is not a zip file"))


def test_ingest_keeps_going(ingest):
    rows = ingest({"ok.twb": CLEAN, "bad.twb": "<workbook", "odd.twbx": b"nope", "empty.twb": b""}).cache()
    assert [r.path for r in readable(rows).collect()] == ["ok.twb"]
    messages = {r.path: r.message for r in unreadable(rows).collect()}
    assert set(messages) == {"bad.twb", "odd.twbx", "empty.twb"}
    assert messages["bad.twb"].startswith("parse: ") and messages["odd.twbx"].startswith("BadZipFile: ")


def test_wide_document_is_linear(ingest):
    body = "".join(column(f"[f{i}]", f"[f{i}] * 2" if i % 2 else None) for i in range(100))
    rows = ingest({"big.twb": workbook("".join(source(f"s{i}", body) for i in range(50)))})
    assert rows.selectExpr("size(datasources)", "size(fields)").first() == (50, 5000)


def test_no_python_runs_at_end_tags_and_levels_close():
    assert isinstance(_handlers(Document())[1], BuiltinMethodType)
    xml = (
        "<workbook><datasources><datasource name='s'><column name='a'><x/></column><calculation formula='no'/>"
        "<group><calculation formula='no'/></group></datasource><other><connection server='no'/></other></datasources>"
        "<worksheets><worksheet name='w'><table><rows><datasources><datasource name='no'/></datasources></rows>"
        "<view><datasources><datasource name='s'/></datasources></view></table></worksheet></worksheets>"
        "<dashboards><dashboard name='d'><zones><zone id='1'><zone id='2' type='worksheet' name='w'/><x><zone id='no'/></x></zone>"
        "<x><zone id='no'/></x><zone id='3'/></zones><size><zone id='no'/></size><zones><zone id='4'/></zones></dashboard>"
        "<other><zones><zone id='no'/></zones></other></dashboards></workbook>")
    document = parse_document(xml.encode())
    assert [(f[3], f[10], f[11]) for f in document.fields] == [("a", False, None)] and not document.connections
    assert document.worksheets == [(0, "w", ["s"])] and document.dashboards == [[0, "d", ["w"]]]
    assert [(z[1], z[3]) for z in document.zones] == [("1", "1"), ("1/1", "2"), ("2", "3"), ("3", "4")]
