import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quire.sources import split_csv
from quire.sources.tabular import CsvSource


@pytest.fixture
def small(spark, monkeypatch):
    """Splits of some hundred bytes and chunks of some lines."""
    monkeypatch.setattr(split_csv, "CHUNK", 60)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def written(rows, end="\n", sep=","):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, delimiter=sep).writerows(rows)
    return out.getvalue().encode()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_come_back_unchanged(spark, small, tmp_path, end):
    rng = random.Random(end)
    texts = ["", "x", "a,b", 'say "hi"', "two\nlines", "dos\r\nline", "\n\n", "\r", '"', "é🙂", "x" * 700, 'q"\n"q,\n', "5\" disk"]
    rows = [["id", "a", "b"]] + [[str(i), rng.choice(texts), rng.choice(texts)] for i in range(400)]
    (tmp_path / "t.csv").write_bytes(written(rows, end))
    read = CsvSource(str(tmp_path / "t.csv")).read(spark)
    assert read.columns == rows[0]
    assert sorted(map(list, read.collect())) == sorted(rows[1:])


def test_one_file_is_many_tasks(spark, small, tmp_path):
    rows = [["id", "t"]] + [[str(i), f"line {i}\nnext"] for i in range(500)]
    (tmp_path / "t.csv").write_bytes(written(rows))
    pieces = split_csv.records(spark, str(tmp_path / "t.csv"), ",")
    assert pieces.select(F.spark_partition_id()).distinct().count() > 1
    assert CsvSource(str(tmp_path / "t.csv")).read(spark).count() == 500


def test_a_record_over_many_splits(spark, small, tmp_path):
    long = "\n".join(f"row {i}, with \"quotes\"" for i in range(300))
    rows = [["id", "t"], ["1", "short"], ["2", long], ["3", long + "\n"], ["4", "end"]]
    (tmp_path / "t.csv").write_bytes(written(rows))
    assert sorted(map(list, CsvSource(str(tmp_path / "t.csv")).read(spark).collect())) == rows[1:]


def test_quotes_inside_plain_cells_open_nothing(spark, small, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'id,t\n1,5" disk\n2,a "b" c\n3,"x"y"z\n4,"open\n5,still" tail\n' * 40)
    got = CsvSource(str(tmp_path / "t.csv")).read(spark).collect()
    assert {(r.id, r.t) for r in got} == {
        ("1", '5" disk'), ("2", 'a "b" c'), ("3", 'xy"z'), ("4", "open\n5,still tail"), ("id", "t")}
    assert len(got) == 40 * 4 + 39


def test_files_headers_marks_and_blank_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b'\xef\xbb\xbfid;t\r\n\r\n1;"a\r\nb"\r\n')
    (tmp_path / "in" / "b.csv").write_bytes(b"id;t\n2;\n\n3;c")
    got = CsvSource(str(tmp_path / "in"), separator=";").read(spark)
    assert got.columns == ["id", "t"]
    assert sorted(map(tuple, got.collect())) == [("1", "a\r\nb"), ("2", ""), ("3", "c")]
    (tmp_path / "plain.csv").write_bytes(b"1,2\n3,4\n")
    bare = CsvSource(str(tmp_path / "plain.csv"), has_header=False).read(spark)
    assert bare.columns == ["Column1", "Column2"] and bare.count() == 2


def test_rows_of_another_width_fail(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="malformed CSV"):
        CsvSource(str(tmp_path / "t.csv")).read(spark).collect()


def test_scanner_agrees_with_the_cutter():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice('a",\n') for _ in range(rng.randrange(30))).encode()
        lines, inside, records = text.split(b"\n"), False, []
        held = []
        for line in lines:
            held.append(line)
            inside = split_csv.inside_after(line, inside, b",")
            if not inside:
                records.append(b"\n".join(held))
                held = []
        if held:
            records.append(b"\n".join(held))
        want = list(csv.reader(io.StringIO(text.decode(), newline="")))
        got = [split_csv.fields_of(r, b",") if r else [] for r in records]
        if text.endswith(b"\n") and not inside and got and got[-1] == []:
            got.pop()
        assert [g for g in got if g] == [w for w in want if w], text
