"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Queries over workbooks read an estate rendered from the star-schema tables (see
``sample_estate``), which is ingested once per session and table folder into the
shared folder, as a scan would do, and then queried from there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import sample_estate, sample_parts
from quire.functions.text import normalize_formula
from quire.operators import tables
from quire.operators.keyed_diff import keyed_diff
from quire.operators.line_diff import line_diff
from quire.operators.transforms import Clause, Filter, any_column_contains
from quire.operators.upsert import EstateStore
from quire.plans import diff, inventory, normalize, scan
from quire.plans.audit import GovernanceConfig, default_registry, reports
from quire.plans.pipeline import Pipeline
from quire.session import configure, fresh_path, hadoop_path
from quire.sinks.findings import write_findings_documents, write_findings_sarif
from quire.sinks.tabular import export_result
from quire.sources.tabular import CsvSource
from quire.sources.workbooks import parse_workbooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STORES: dict[tuple, str] = {}
# Workbooks whose findings share a document, in exports of whole estates.
WORKBOOKS_PER_DOCUMENT = 1000


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir.rstrip("/"))

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(spark: SparkSession, sf_dir: str, label: str) -> tuple:
    place, files = hadoop_path(spark, sf_dir)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(place)))
    return spark.sparkContext.applicationId, sf_dir, label, state


def _stored(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Rows written to the shared folder on first use, read from there until a table in the folder changes.

    The files go when the driver's JVM ends.
    """
    key = _key(spark, sf_dir, label)
    if key not in _STORES:
        path = fresh_path(spark, label)
        build().write.parquet(path)
        handle, files = hadoop_path(spark, path)
        files.deleteOnExit(handle)
        _STORES[key] = path
    return spark.read.parquet(_STORES[key])


def documents(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """``o, path, xml`` of one snapshot, in place of a tree of files; they are parsed as they are rendered."""
    return sample_estate.documents(spark, sf_dir, variant)


def _ingested(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return parse_workbooks(sample_estate.files(documents(spark, sf_dir, variant)))


def estate(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """Ingested workbook rows of one snapshot."""
    return _stored(spark, sf_dir, f"estate-{variant}", lambda: _ingested(spark, sf_dir, variant))


def estate_read_once(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """``estate`` for a query that reads its rows in one pass: rows that are not stored yet go on as they are parsed."""
    if _key(spark, sf_dir, f"estate-{variant}") in _STORES:
        return estate(spark, sf_dir, variant)
    return _ingested(spark, sf_dir, variant)


def part_books(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """Ingested rows of one workbook per part, in one of two snapshots."""
    return _stored(
        spark, sf_dir, f"parts-{'b' if later else 'a'}",
        lambda: parse_workbooks(sample_estate.files(sample_parts.documents(spark, sf_dir, later))))


# ---- inventory ----------------------------------------------------------------
@query
def inv_embedded_credentials(spark, sf_dir):
    return inventory.embedded_credentials(estate(spark, sf_dir))


@query
def inv_references_table(spark, sf_dir):
    return inventory.references_table(estate(spark, sf_dir), "db_1")


@query
def inv_references_formula(spark, sf_dir):
    return inventory.references_table(estate(spark, sf_dir), "GONE1")


@query
def inv_references_datasource(spark, sf_dir):
    return inventory.references_table(estate(spark, sf_dir), "Federated.S1")


@query
def inv_references_unconnected(spark, sf_dir):
    """Data sources found by name, most of them without any connection."""
    return inventory.references_table(part_books(spark, sf_dir, later=True), "BARE")


@query
def inv_user_identity_fields(spark, sf_dir):
    return inventory.user_identity_fields(estate(spark, sf_dir))


@query
def inv_server_summary(spark, sf_dir):
    return inventory.server_summary(estate(spark, sf_dir))


@query
def inv_list_workbooks(spark, sf_dir):
    return inventory.workbook_list(estate(spark, sf_dir)).drop("mtime", "scanned_at")


@query
def inv_stats(spark, sf_dir):
    return inventory.stats(estate(spark, sf_dir))


@query
def inv_adhoc_sql(spark, sf_dir):
    return tables.query(
        spark, estate(spark, sf_dir),
        """
        SELECT d.caption, count(DISTINCT w.path) AS workbooks, count(f.name) AS fields
        FROM workbooks w
        JOIN datasources d ON d.path = w.path
        LEFT JOIN fields f ON f.path = d.path AND f.ds_pos = d.ds_pos AND f.is_calculated
        WHERE w.version = :version
          AND EXISTS (SELECT 1 FROM connections c
                      WHERE c.path = d.path AND c.ds_pos = d.ds_pos AND c.server LIKE :server)
        GROUP BY d.caption
        """,
        version="18.1", server="%.vendor.example.net",
    )


@query
def inv_upsert_then_list(spark, sf_dir):
    store = EstateStore(spark, fresh_path(spark, "store"))
    store.upsert(estate_read_once(spark, sf_dir))
    number = F.regexp_extract("path", r"^estate/(\d+)", 1).cast("long")
    store.upsert(estate_read_once(spark, sf_dir, "b").filter(number % 2 == 0))
    return inventory.workbook_list(store.load()).drop("mtime", "scanned_at")


@query
def inv_upsert_repeated_paths(spark, sf_dir):
    """Both snapshots in one batch: of the rows of a path the last scanned stays."""
    store = EstateStore(spark, fresh_path(spark, "store"))
    sides = [estate_read_once(spark, sf_dir, variant).withColumn("scanned_at", F.lit(at).cast("timestamp"))
             for variant, at in (("b", "2024-01-02"), ("a", "2024-01-01"))]
    store.upsert(sides[0].unionByName(sides[1]))
    return inventory.workbook_list(store.load()).drop("mtime", "scanned_at")


@query
def table_fields(spark, sf_dir):
    return tables.fields(estate(spark, sf_dir)).select(
        "path", "ds_pos", "field_pos", "datasource", "name", "caption", "datatype", "role",
        "is_calculated", "calc_formula", "references_username",
    )


@query
def table_dashboards(spark, sf_dir):
    return tables.dashboards(estate(spark, sf_dir))


@query
def table_zones(spark, sf_dir):
    return tables.zones(estate(spark, sf_dir))


@query
def table_nested_zones(spark, sf_dir):
    return tables.zones(part_books(spark, sf_dir))


# ---- scan -----------------------------------------------------------------------
@query
def scan_summary(spark, sf_dir):
    docs = sample_estate.with_broken(documents(spark, sf_dir))
    return scan.summary(parse_workbooks(sample_estate.files(docs)))


@query
def scan_errors_first(spark, sf_dir):
    docs = sample_estate.with_broken(documents(spark, sf_dir))
    return inventory.first_scan_errors(parse_workbooks(sample_estate.files(docs))).select(
        "path", F.regexp_extract("message", "^(.*): line", 1).alias("message"))


@query
def scan_tree_files(spark, sf_dir):
    """Real files scanned, changed and scanned again: what the store holds, and the errors of the second scan."""
    root, store = fresh_path(spark, "tree"), EstateStore(spark, fresh_path(spark, "store"))
    sample_estate.write_files(sample_estate.supplier_books(spark, sf_dir, later=False), root)
    scan.scan_tree(spark, root, store)
    sample_estate.write_files(sample_estate.supplier_books(spark, sf_dir, later=True), root)
    second = scan.scan_tree(spark, root, store)
    name = F.regexp_extract("path", r"(n\d+/s\d+\.twb)$", 1).alias("name")
    held = store.load().select(
        name, "sha256", "size_bytes", F.size("datasources").cast("long").alias("sources"),
        (F.col("mtime") > 1.6e9).alias("dated"), F.lit("").alias("message"))
    nothing = [F.lit(value).cast(t).alias(c) for c, t, value in (
        ("sha256", "string", ""), ("size_bytes", "long", 0), ("sources", "long", 0), ("dated", "boolean", False))]
    return held.unionByName(second.errors.select(name, *nothing, "message"))


@query
def zip_ingest(spark, sf_dir):
    packed = sample_estate.packaged(documents(spark, sf_dir))
    outcome = F.when(F.col("error").isNull(), "indexed").otherwise(
        F.regexp_extract("error.message", "(no workbook document|several workbook documents)", 1))
    return parse_workbooks(packed).groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("files"), F.sum(tables.size_of("fields")).alias("fields"))


@query
def zip_ingest_files(spark, sf_dir):
    """What became of each package."""
    packed = sample_estate.packaged(documents(spark, sf_dir))
    said = F.regexp_extract(F.coalesce("error.message", F.lit("")), "(holds .*)$", 1)
    return parse_workbooks(packed).select(
        "path", said.alias("said"), tables.size_of("datasources").cast("long").alias("sources"),
        tables.size_of("fields").cast("long").alias("fields"))


# ---- audit ----------------------------------------------------------------------
_FLAT = ["rule_id", "severity", "title", "message", "workbook_path", "location", "remediation"]


def _flat(findings: DataFrame) -> DataFrame:
    """Whole findings, the properties as ``name=value`` texts in the order of their names."""
    pairs = F.transform(F.map_entries("properties"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return findings.select(*_FLAT, F.array_join(F.array_sort(pairs), ",").alias("properties"))


def _rule_query(rule_id: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(default_registry().run(estate(spark, sf_dir), only=[rule_id]))

    run.__name__ = f"audit_{rule_id.lower()}"
    query(run)


for _rule in default_registry().rules:
    _rule_query(_rule.meta.id)


@query
def audit_all(spark, sf_dir):
    return _flat(default_registry().run(estate_read_once(spark, sf_dir)))


@query
def audit_wordings(spark, sf_dir):
    """Formulas, captions and files in every wording the rules tell apart."""
    return _flat(default_registry().run(part_books(spark, sf_dir), only=["AUD003", "GOV003", "GOV004", "GOV005"]))


@query
def audit_gravest(spark, sf_dir):
    """The head of the report: gravest findings first."""
    return _flat(reports.ordered(default_registry().run(estate(spark, sf_dir))).limit(50))


@query
def audit_findings_by_workbook(spark, sf_dir):
    return reports.by_workbook(default_registry().run(estate(spark, sf_dir)))


@query
def audit_severity_counts(spark, sf_dir):
    return reports.severity_counts(default_registry().run(estate(spark, sf_dir)))


@query
def audit_gate(spark, sf_dir):
    rows = estate(spark, sf_dir)
    return reports.gate(rows, default_registry().run(rows))


@query
def audit_pack_config(spark, sf_dir):
    config = GovernanceConfig(["N1.vendor.example.net"], [" Email "])
    findings = default_registry().run(estate(spark, sf_dir), "Governance", config)
    return _flat(reports.filtered(findings, ["warn"], "VENDOR"))


@query
def audit_pack_pii_disabled(spark, sf_dir):
    config = GovernanceConfig([], ["email"])
    findings = default_registry().run(estate(spark, sf_dir), "governance", config, only=["GOV003"])
    return _flat(findings)


# ---- diff -----------------------------------------------------------------------
@query
def diff_workbooks(spark, sf_dir):
    changes = diff.diff_workbooks(estate(spark, sf_dir), estate(spark, sf_dir, "b"))
    return changes.select(
        "a_path", "kind", "category", "identifier", F.coalesce("detail", F.lit("")).alias("detail"))


@query
def diff_summary(spark, sf_dir):
    a, b = estate(spark, sf_dir), estate(spark, sf_dir, "b")
    return diff.diff_summary(diff.workbook_pairs(a, b), diff.diff_workbooks(a, b)).drop("b_path")


@query
def diff_keyed_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    later = (
        orders.filter(key % 7 != 0)
        .withColumn("o_totalprice", F.when(key % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
        .withColumn("o_orderstatus", F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
        .withColumn("o_orderkey", F.when(key % 13 == 0, -1 - key).otherwise(key))
    )
    found = keyed_diff(orders, later, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return found.withColumn("changed_cols", F.array_join("changed_cols", ","))


@query
def diff_every_kind(spark, sf_dir):
    changes = diff.diff_workbooks(part_books(spark, sf_dir), part_books(spark, sf_dir, later=True))
    return changes.select(
        "a_path", "kind", "category", "identifier", F.coalesce("detail", F.lit("")).alias("detail"))


@query
def diff_every_kind_summary(spark, sf_dir):
    a, b = part_books(spark, sf_dir), part_books(spark, sf_dir, later=True)
    return diff.diff_summary(diff.workbook_pairs(a, b), diff.diff_workbooks(a, b)).drop("b_path")


@query
def diff_duplicate_names(spark, sf_dir):
    """The later snapshot with repeated names in some workbooks: errors for these, changes of all others."""
    repeated = F.regexp_extract("path", r"^estate/(\d+)", 1).cast("long") % 10 == 0
    docs = documents(spark, sf_dir, "b").filter(F.col("o") % 10 == 0)
    twins = _stored(spark, sf_dir, "estate-twins", lambda: parse_workbooks(
        sample_estate.files(sample_estate.with_repeated_source(docs))))
    later = estate(spark, sf_dir, "b").filter(~repeated).unionByName(twins)
    return diff.diff_workbooks(estate(spark, sf_dir), later).select(
        "a_path", "kind", "category", "identifier", F.coalesce("detail", F.lit("")).alias("detail"))


# ---- canonical forms --------------------------------------------------------------
@query
def norm_duplicates(spark, sf_dir):
    both = sample_estate.files(sample_estate.with_noisy(documents(spark, sf_dir)))
    groups = normalize.duplicate_groups(normalize.canonical_digest_table(both))
    return groups.select("first_path", "copies")


@query
def diff_lines(spark, sf_dir):
    a, b = (
        _stored(spark, sf_dir, f"forms-{v}", lambda v=v: normalize.canonical_forms(
            sample_estate.files(documents(spark, sf_dir, v))))
        for v in ("a", "b")
    )
    return normalize.diff_lines(a, b).groupBy("path", "kind").agg(
        F.sum("copies").alias("lines"), F.count("*").alias("different"))


@query
def diff_document_lines(spark, sf_dir):
    """Whole documents against a version with one line taken out and one put in front, line by line in order."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).withColumn(
        "k", (F.col("doc_id") % F.size("lines")).cast("int"))
    ended = lambda *parts: F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n")).alias("body")
    old = F.array(F.concat(F.lit("# old "), F.col("doc_id").cast("string")))
    new = F.array(F.concat(F.lit("# new "), F.col("doc_id").cast("string")))
    before, after = F.slice("lines", 1, F.col("k")), F.slice("lines", F.col("k") + 1, F.size("lines"))
    found = line_diff(rows.select("doc_id", ended(before, old, after)), rows.select("doc_id", ended(new, F.col("lines"))),
                      "doc_id", "body")
    return found.na.fill(0, ["old_at", "new_at"])


@query
def conformance(spark, sf_dir):
    docs = sample_estate.with_broken(documents(spark, sf_dir))
    xsd = sample_estate.schema_file(spark)
    return normalize.conformance_summary(normalize.conformance(sample_estate.files(docs), xsd))


@query
def conformance_documents(spark, sf_dir):
    docs = sample_estate.with_broken(documents(spark, sf_dir))
    xsd = sample_estate.schema_file(spark)
    return normalize.conformance(sample_estate.files(docs), xsd)


@query
def dup_text_documents(spark, sf_dir):
    digest = F.sha2(normalize_formula(F.col("text")), 256)
    return (
        table(spark, sf_dir, "documents")
        .groupBy(digest.alias("text_sha"))
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))
        .filter("copies > 1")
        .select("first_doc_id", "copies")
    )


# ---- export -----------------------------------------------------------------------
def _lines(spark: SparkSession, folder: str, start: str, schema: str) -> DataFrame:
    """``file, j``: the elements of all documents below a folder that begin like ``start``, read line by line."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).where(F.col("value").startswith(start))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.from_json(F.rtrim("value", F.lit(",")), schema).alias("j"))


def _named(properties: str):
    """Properties as ``name=value`` texts in the order of their names."""
    pairs = F.transform(F.map_entries(properties), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(F.array_sort(pairs), ",").alias("properties")


def _documents_for(rows: DataFrame) -> int:
    return -(-rows.count() // WORKBOOKS_PER_DOCUMENT)


@query
def export_json(spark, sf_dir):
    folder, rows = fresh_path(spark, "json"), estate(spark, sf_dir)
    write_findings_documents(default_registry().run(rows), folder, documents=_documents_for(rows), compression="gzip")
    found = _lines(spark, folder, '{"rule_id"', ", ".join(f"{c} string" for c in _FLAT) + ", properties map<string,string>")
    return found.select(*[f"j.{c}" for c in _FLAT], _named("j.properties"))


@query
def export_sarif(spark, sf_dir):
    folder, registry, rows = fresh_path(spark, "sarif"), default_registry(), estate(spark, sf_dir)
    write_findings_sarif(registry.run(rows), folder, registry.rules, documents=_documents_for(rows), compression="gzip")
    results = _lines(spark, folder, '{"ruleId"', (
        "ruleId string, level string, message struct<text:string,markdown:string>, properties map<string,string>, "
        "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>,"
        "logicalLocations:array<struct<fullyQualifiedName:string>>>>"))
    rules = _lines(spark, folder, '{"id"', "id string, name string").select(
        "file", F.col("j.id").alias("rule_id"), F.col("j.name").alias("slug"))
    place = F.col("j.locations")[0]
    return results.select(
        "file", F.col("j.ruleId").alias("rule_id"), "j.level", F.col("j.message.text").alias("message"), "j.message.markdown",
        place["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
        place["logicalLocations"][0]["fullyQualifiedName"].alias("location"), _named("j.properties"),
    ).join(rules, ["file", "rule_id"]).drop("file")


# ---- pipelines ----------------------------------------------------------------------
def _pipeline(spark: SparkSession, spec: str, **paths: str) -> DataFrame:
    """Run a spec that writes to ``{out}`` and read what it wrote."""
    out = fresh_path(spark, "pipeline")
    Pipeline.from_yaml(spec.format(out=out, **paths)).run(spark)
    return spark.read.parquet(out)


@query
def pipe_cast_filter(spark, sf_dir):
    return _pipeline(spark, """
        name: cast and filter
        source: {{type: parquet, path: "{sf}/orders.parquet"}}
        transforms:
          - type: filter
            where:
              - {{col: o_orderdate, op: "<", value: 1997-01-01}}
              - {{col: O_ORDERSTATUS, op: "!=", value: P}}
              - {{col: o_custkey, op: ">=", value: "10.5"}}
          - type: cast
            columns: {{o_totalprice: int64, o_custkey: string, missing: int8}}
          - type: filter
            where:
              - {{col: o_totalprice, op: ">", value: "100,000"}}
              - {{col: o_custkey, op: "<=", value: 900}}
        sink: {{type: parquet, path: "{out}"}}
        """, sf=sf_dir)


@query
def pipe_rename_select_drop(spark, sf_dir):
    return _pipeline(spark, """
        name: columns
        source: {{type: parquet, path: "{sf}/lineitem.parquet"}}
        transforms:
          - {{type: rename, columns: {{l_orderkey: order_id, L_QUANTITY: qty, nothing: x}}}}
          - {{type: select, columns: [qty, order_id, l_shipdate, l_tax, L_DISCOUNT]}}
          - {{type: drop, columns: [L_TAX, nothing]}}
        sink: {{type: parquet, path: "{out}"}}
        """, sf=sf_dir)


@query
def pipe_metrics(spark, sf_dir):
    out = fresh_path(spark, "pipeline")
    result = Pipeline.from_yaml(f"""
        name: metrics
        source: {{type: parquet, path: "{sf_dir}/lineitem.parquet"}}
        transforms:
          - {{type: filter, where: [{{col: l_quantity, op: ">", value: 25}}]}}
          - {{type: select, columns: [l_orderkey]}}
        sink: {{type: table, path: "{out}"}}
        """).run(spark)
    stored = spark.read.parquet(f"{out}/Extract").agg(F.count("*").alias("stored"))
    return stored.select(
        F.lit(result.name).alias("name"), F.lit(result.rows_in).cast("long").alias("rows_in"),
        F.lit(result.rows_out).cast("long").alias("rows_out"), "stored", F.lit(",".join(result.columns)).alias("columns"))


@query
def pipe_in_notin_nulls(spark, sf_dir):
    kind = F.nullif("event_type", F.lit("click"))
    amount = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), amount.alias("amount"))
    tests = {
        "in": Filter([Clause("kind", "in", ["view", "error"])]),
        "in_null": Filter([Clause("kind", "in", ["view", None])]),
        "not_in": Filter([Clause("kind", "not_in", ["view"])]),
        "not_in_null": Filter([Clause("kind", "not_in", ["view", None])]),
        "below": Filter([Clause("amount", "<", "5")]),
        "not_below": Filter([Clause("amount", ">=", "5")]),
        "unequal": Filter([Clause("kind", "!=", "view")]),
        "is_null": Filter([Clause("amount", "==", None)]),
        "above_null": Filter([Clause("amount", ">", None), Clause("kind", "<=", "purchase")]),
    }
    parts = [f.apply(rows).select(F.lit(name).alias("test"), "event_id") for name, f in tests.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def pipe_text_ladder(spark, sf_dir):
    k = F.col("c_custkey")
    day = F.lpad((1 + k % 28).cast("string"), 2, "0")
    mixed = (
        F.when(k % 6 == 0, k.cast("string"))
        .when(k % 6 == 1, F.concat(F.lit("("), k.cast("string"), F.lit(")")))
        .when(k % 6 == 2, F.concat(F.lit("w"), k.cast("string")))
        .when(k % 6 == 3, F.concat(F.lit("2024-01-"), day))
        .when(k % 6 == 4, F.concat(F.lit("01/"), day, F.lit("/2024")))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", mixed.alias("mixed"))
    tests = {
        "number": Clause("mixed", ">=", "1,00"),
        "time": Clause("mixed", "<", "2024-01-15"),
        "text": Clause("mixed", "!=", "w2"),
        "list": Clause("mixed", "in", ["100", "(7)", "w8", None, "2024-01-05"]),
        "negative": Clause("mixed", "<", "-5"),
    }
    parts = [
        Filter([clause]).apply(rows).select(F.lit(name).alias("test"), "c_custkey")
        for name, clause in tests.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def pipe_csv_roundtrip(spark, sf_dir):
    middle = fresh_path(spark, "pipeline")
    Pipeline.from_yaml(f"""
        name: to text
        source: {{type: parquet, path: "{sf_dir}/supplier.parquet"}}
        sink: {{type: csv, path: "{middle}", separator: ";"}}
        """).run(spark)
    return _pipeline(spark, """
        name: from text
        source: {{type: csv, path: "{middle}", separator: ";"}}
        transforms:
          - {{type: filter, where: [{{col: s_acctbal, op: ">", value: 0}}]}}
          - {{type: cast, columns: {{s_suppkey: int64, s_nationkey: int32, s_acctbal: float64}}}}
        sink: {{type: parquet, path: "{out}"}}
        """, middle=middle)


@query
def pipe_parquet_roundtrip(spark, sf_dir):
    return _pipeline(spark, """
        name: widening
        source: {{type: parquet, path: "{sf}/part.parquet"}}
        transforms:
          - {{type: cast, columns: {{p_size: int8, p_retailprice: int32, p_partkey: uint64}}}}
        sink: {{type: parquet, path: "{out}"}}
        """, sf=sf_dir)


@query
def pipe_table_append(spark, sf_dir):
    out = fresh_path(spark, "pipeline")
    job = Pipeline.from_yaml(f"""
        name: twice
        source: {{type: parquet, path: "{sf_dir}/nation.parquet"}}
        transforms: []
        sink: {{type: table, path: "{out}", table: nations, mode: Append}}
        """)
    job.run(spark)
    job.run(spark)
    return spark.read.parquet(f"{out}/nations")


@query
def result_any_column_filter(spark, sf_dir):
    return any_column_contains(table(spark, sf_dir, "supplier"), " r#00000000 ")


@query
def result_export_csv(spark, sf_dir):
    out = fresh_path(spark, "export")
    rows = inventory.embedded_credentials(estate(spark, sf_dir))
    export_result(any_column_contains(rows, "asia.INTERNAL"), out)
    return CsvSource(out).read(spark)
