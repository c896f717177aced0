import os
import zipfile

import pytest
from conftest import CLEAN, column, source, workbook
from pyspark.sql import functions as F

from quire.operators.upsert import EstateStore, newest_per_key, replace_by_key
from quire.plans import inventory
from quire.plans.scan import scan_files, scan_tree
from quire.session import shared_dir
from quire.sources.workbooks import find_workbooks, parse_workbooks, with_file_facts
from quire.streaming.index import index_new_files


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, "a.twb", CLEAN)
    write(root, "deep/er/B.TWB", workbook(source("b")))
    write(root, "deep/bad.twb", "<workbook")
    write(root, "deep/old.twbx", "not a zip")
    write(root, "notes.txt", "x")
    write(root, "a.twb.bak", "x")
    return root


def test_discovery_and_facts(spark, tree):
    with zipfile.ZipFile(tree / "good.twbx", "w") as archive:
        archive.writestr("x/book.twb", CLEAN)
    listed = find_workbooks(spark, str(tree))
    import hashlib
    for through_spark in (False, True):
        facts = with_file_facts(listed, through_spark)
        assert facts.columns == ["path", "sha256", "mtime", "size_bytes", "content"]
        rows = {os.path.basename(r.path): r for r in parse_workbooks(facts).collect()}
        assert set(rows) == {"a.twb", "B.TWB", "bad.twb", "old.twbx", "good.twbx"}
        # The digest covers the whole file, also where parsing stopped early.
        for name, row in rows.items():
            content = next(tree.rglob(name)).read_bytes()
            assert row.sha256 == hashlib.sha256(content).hexdigest() and row.size_bytes == len(content)
        assert abs(rows["a.twb"].mtime - os.path.getmtime(tree / "a.twb")) < 0.01
        assert {n for n, r in rows.items() if r.error} == {"bad.twb", "old.twbx"}
    plan = parse_workbooks(with_file_facts(listed))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema"):].split("\n")[0]


def test_listing_does_not_read_contents(spark, tree):
    plan = find_workbooks(spark, str(tree)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema"):]


def test_scan_and_rescan(spark, tree, tmp_path):
    store = EstateStore(spark, str(tmp_path / "store"))
    assert store.load().count() == 0 and store.version() == 0
    result = scan_tree(spark, str(tree), store)
    assert (result.scanned, result.indexed, result.skipped) == (4, 2, 2)
    assert {os.path.basename(r.path): r.message.split(":")[0] for r in result.errors.collect()} == {
        "bad.twb": "parse", "old.twbx": "BadZipFile"}
    first = {os.path.basename(r.path): r for r in inventory.workbook_list(store.load()).collect()}

    # Changed, broken and removed files: only the changed one is replaced.
    write(tree, "a.twb", workbook(source("x") + source("y")))
    write(tree, "deep/er/B.TWB", "<broken")
    assert scan_tree(spark, str(tree), store).indexed == 1
    (tree / "a.twb").rename(tree / "gone.txt")
    second = {os.path.basename(r.path): r for r in inventory.workbook_list(store.load()).collect()}
    assert set(second) == set(first) == {"a.twb", "B.TWB"}
    assert second["a.twb"].datasource_count == 2 and second["B.TWB"] == first["B.TWB"]
    assert second["a.twb"].scanned_at > first["a.twb"].scanned_at
    assert store.version() == 2 and store.load(1).count() == 2


def test_incomplete_versions_are_ignored(spark, ingest, tmp_path):
    store = EstateStore(spark, str(tmp_path / "s"))
    store.upsert(ingest({"a.twb": CLEAN}))
    # What a writer leaves that died: data without a manifest, and a manifest under another name.
    os.makedirs(tmp_path / "s" / "data" / "dead" / "bucket=0")
    (tmp_path / "s" / "manifests" / "writing-dead").write_text("{")
    assert store.version() == 1 and store.load().count() == 1
    batch = ingest({"b.twb": CLEAN})
    assert store.upsert(batch.unionByName(batch)) == 2
    assert store.version() == 2 and store.load().count() == 2 and store.load(1).count() == 1


def data_files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_an_upsert_writes_the_buckets_of_its_paths_only(spark, ingest, tmp_path):
    store = EstateStore(spark, str(tmp_path / "s"), buckets=512)
    books = ingest({f"{i}.twb": CLEAN for i in range(600)}).persist()
    store.upsert(books)
    first, folders = data_files(tmp_path / "s"), store.manifest(1)["folders"]
    assert len(first) == len(folders) > 300
    store.upsert(books.where("path IN ('1.twb', '22.twb', '333.twb', '44.twb', '55.twb', '6.twb')"))
    written = data_files(tmp_path / "s") - first
    assert 1 <= len(written) <= 6
    changed = {b for b, folder in store.manifest(2)["folders"].items() if folders.get(b) != folder}
    assert len(changed) == len(written)
    assert store.load().count() == 600 and store.load().select("path").distinct().count() == 600
    # Reopened with another number, the store keeps its own.
    assert EstateStore(spark, store.root, buckets=7).upsert(books.where("path = '9.twb'")) == 3
    assert store.manifest(3)["buckets"] == 512 and store.load().count() == 600


def test_of_two_writers_one_fails(spark, ingest, tmp_path, monkeypatch):
    store, other = (EstateStore(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    store.upsert(ingest({"a.twb": CLEAN}))
    plain = EstateStore._publish

    def interrupted(self, current, manifest):
        monkeypatch.setattr(EstateStore, "_publish", plain)
        other.upsert(ingest({"b.twb": CLEAN}))
        plain(self, current, manifest)

    monkeypatch.setattr(EstateStore, "_publish", interrupted)
    with pytest.raises(RuntimeError, match="another writer"):
        store.upsert(ingest({"c.twb": CLEAN}))
    assert store.version() == 2 and {r.path for r in store.load().collect()} == {"a.twb", "b.twb"}
    assert not [n for n in os.listdir(tmp_path / "s" / "manifests") if n.startswith("writing")]
    assert store.upsert(ingest({"c.twb": CLEAN})) == 3 and store.load().count() == 3


def test_vacuum_removes_what_no_kept_version_names(spark, ingest, tmp_path):
    store = EstateStore(spark, str(tmp_path / "s"), buckets=2)
    for _ in range(3):
        store.upsert(ingest({f"{i}.twb": CLEAN for i in range(20)}))
    store.upsert(ingest({"0.twb": CLEAN}))
    before = data_files(tmp_path / "s")
    assert store.vacuum(keep=1) == 0 and data_files(tmp_path / "s") == before   # all are young
    assert store.versions() == [4]
    assert store.vacuum(keep=1, older_than_seconds=-60) == len(before) - 2
    assert len(data_files(tmp_path / "s")) == 2 and store.load().count() == 20
    assert store.upsert(ingest({"x.twb": CLEAN})) == 5 and store.load().count() == 21


def test_nothing_readable_changes_nothing(spark, tmp_path):
    store = EstateStore(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a.twb", bytearray(b"<"))], "path string, content binary")
    assert scan_files(files, store).skipped == 1 and store.version() == 0


def test_replace_by_key_and_newest(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8), ("c", 7)], "k string, v int")
    latest = newest_per_key(new, "k", F.desc("v"))
    assert sorted(map(tuple, replace_by_key(old, latest, "k").collect())) == [("a", 9), ("b", 3), ("c", 8)]


def test_new_files_are_indexed_once(spark, tree, tmp_path):
    store = EstateStore(spark, str(tmp_path / "store"))

    def run():
        index_new_files(spark, str(tree), store, str(tmp_path / "cp")).awaitTermination()
        return store.load().count()

    assert run() == 2
    version = store.version()
    assert run() == 2 and store.version() == version
    write(tree, "later/c.twb", workbook(source("c", column("[c]"))))
    assert run() == 3 and store.version() == version + 1


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_package_of_any_size_is_read(spark, tmp_path):
    root = tmp_path / "large files"
    root.mkdir()
    # A sparse file: zip directories are found from the end, whatever stands before.
    with open(root / "big.twbx", "wb") as out:
        out.truncate((1 << 30) + 4096)
        out.seek(0, os.SEEK_END)
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("book.twb", CLEAN)
    store = EstateStore(spark, str(tmp_path / "store"))
    result = scan_tree(spark, str(root), store)
    assert (result.scanned, result.indexed) == (1, 1)
    row = store.load().select("sha256", "size_bytes", F.size("datasources").alias("n")).first()
    assert row.size_bytes > 1 << 30 and len(row.sha256) == 64 and row.n == 1
