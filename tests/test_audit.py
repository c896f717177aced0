import pytest
from conftest import CLEAN, board, column, sheet, source, workbook
from pyspark.sql import functions as F

from quire.functions.text import PII_TERMS, normalize_formula, pii_label
from quire.plans.audit import GovernanceConfig, Hit, Registry, RuleMeta, default_registry, reports
from quire.plans.audit.registry import row_rule, set_rule


def one(body="", connection=None, **kw):
    args = {} if connection is None else {"connection": connection}
    return workbook(source("sales", column("[Amount]") + body, **args), sheet("Sheet", "sales"),
                    kw.pop("boards", board("Main", "Sheet")), **kw)


ONE_EACH = {
    "AUD001": workbook(source(), sheet("Sheet", "sales") + sheet("Spare", "sales"), board("Main", "Sheet")),
    "AUD002": workbook(source() + source("lonely"), sheet("Sheet", "sales"), board("Main", "Sheet")),
    "AUD003": one(column("[c]", "attr ([Amount])")),
    "AUD004": one(column("[c]", "[Amount]  * 2") + column("[d]", " [AMOUNT] * 2 ").replace("AMOUNT", "Amount")),
    "AUD005": one(column("[c]", "[Amount] + [Gone]")),
    "AUD006": one(version="9.0"),
    "GOV001": one(connection='<connection class="c" server="db.internal.example.com" password="x"/>'),
    "GOV002": one(connection='<connection class="c" server="db.example.org"/>'),
    "GOV003": one(column("[customer_email]")),
    "GOV004": one(column("[c]", "USERDOMAIN() = 'x'")),
    "GOV005": one(connection='<connection class="textscan" filename="c:\\uSers\\me\\x.csv"/>'),
}


@pytest.fixture(scope="module")
def findings(ingest):
    books = {f"{rule}.twb": xml for rule, xml in ONE_EACH.items()} | {"clean.twb": CLEAN}
    rows = ingest(books).cache()
    return rows, default_registry().run(rows).cache()


def test_each_workbook_breaks_only_its_rule(findings):
    found = {(r.workbook_path, r.rule_id) for r in findings[1].collect()}
    assert found == {(f"{rule}.twb", rule) for rule in ONE_EACH}


def test_single_rule_runs_agree_with_the_shared_run(findings):
    rows, together = findings
    for rule in default_registry().rules:
        alone = default_registry().run(rows, only=[rule.meta.id])
        assert alone.schema == together.schema or alone.columns == together.columns
        assert alone.collect() == together.filter(F.col("rule_id") == rule.meta.id).collect()


def test_locations_and_properties(findings):
    by_rule = {r.rule_id: r for r in findings[1].collect()}
    assert by_rule["AUD001"].location == "worksheet:Spare"
    assert by_rule["AUD002"].location == "datasource:lonely"
    assert by_rule["AUD003"].properties == {"function": "ATTR"}
    assert by_rule["AUD004"].location == "sales/[c]" and by_rule["AUD004"].properties == {"count": "2"}
    assert by_rule["AUD005"].properties == {"referenced": "[Gone]"}
    assert by_rule["AUD006"].location == "workbook" and by_rule["AUD006"].properties == {"version": "9.0"}
    assert by_rule["GOV001"].location == "datasource:sales/connection:c"
    assert by_rule["GOV002"].properties == {"server": "db.example.org"}
    assert by_rule["GOV003"].location == "datasource:sales/field:[customer_email]"
    assert by_rule["GOV005"].properties == {"path": "c:\\uSers\\me\\x.csv"}


def test_gate_and_counts(findings):
    rows, found = findings
    codes = {r.path: r.exit_code for r in reports.gate(rows, found).collect()}
    assert codes["clean.twb"] == 0 and codes["AUD004.twb"] == 0
    assert codes["AUD005.twb"] == 2 and codes["GOV003.twb"] == 1
    assert tuple(reports.severity_counts(found).first()) == (2, 7, 2, 11)
    assert reports.by_workbook(found).count() == 11


def test_filter_is_literal(findings):
    found = findings[1]
    assert [r.rule_id for r in reports.filtered(found, ["error"], "gone").collect()] == ["AUD005"]
    assert reports.filtered(found, text="%").count() == 0
    assert reports.filtered(found, ["info"], "  aud006 ").count() == 1
    order = [r.severity for r in reports.ordered(found).collect()]
    assert order == sorted(order, key=["error", "warn", "info"].index)


def test_details_of_rules(ingest):
    rows = ingest({
        # No dashboard at all: no worksheet is unused. No version: never old.
        "none.twb": workbook(source(), sheet("Sheet", "sales")).replace(' version="18.1"', ""),
        # One formula with both functions, one repeated reference, own name, other source's column.
        "many.twb": workbook(
            source("a", column("[c]", "ATTR([x]) + window_var([x]) + [c]")) + source("b", column("[x]")),
            sheet("s", "a", "b")),
        # Same name twice and unused: one finding for each.
        "twins.twb": workbook(source("t") + source("t")),
        "version.twb": workbook(version="17.9d") + "",
        "nested.twb": workbook(source("q", column("[v]", "[A].[B]\n[C]"))),
        "same.twb": workbook(source("m", column("[k]", "1") + column("[l]", "1")) + source("n", column("[o]", "1")),
                             sheet("s", "m", "n")),
    })
    found = {}
    for r in default_registry().run(rows, "audit").collect():
        found.setdefault(r.workbook_path, []).append((r.rule_id, r.properties))
    assert "none.twb" not in found
    assert sorted(k for k, _ in found["many.twb"]) == ["AUD003", "AUD003", "AUD005"]
    assert found["twins.twb"] == [("AUD002", {}), ("AUD002", {})]
    assert "version.twb" not in found
    assert sorted(p["referenced"] for k, p in found["nested.twb"] if k == "AUD005") == ["[A]", "[B]", "[C]"]
    assert found["same.twb"] == [("AUD004", {"count": "3"})]


def test_servers(ingest):
    def connect(server):
        return one(connection=f'<connection class="c" server="{server}"/>')

    names = ["LOCALHOST", "127.0.0.1", "internal.example.com", "a.b.INTERNAL.example.com", "", "ok.org",
             "xinternal.example.com", "internal.example.com.evil.org", "127x0.0.1"]
    rows = ingest({f"{i}.twb": connect(n) for i, n in enumerate(names)})
    found = default_registry().run(rows, "governance", GovernanceConfig(["OK.org", " ", ""]), only=["GOV002"])
    assert sorted(r.properties["server"] for r in found.collect()) == [
        "127x0.0.1", "internal.example.com.evil.org", "xinternal.example.com"]


def test_profile_paths(ingest):
    paths = {"/home/ann/x": 1, "/Users/ann/x": 1, "/users/ann/x": 0, "D:\\Users\\x": 1, "/home/x": 0, "C:\\Data\\x": 0}
    books = {f"{i}.twb": one(connection=f'<connection filename="{p}"/>') for i, p in enumerate(paths)}
    found = default_registry().run(ingest(books), only=["GOV005"])
    assert sorted(r.properties["path"] for r in found.collect()) == sorted(p for p, hit in paths.items() if hit)


NAMES = {
    ("[first_name]", None): "personal_name", ("[last_name]", ""): "personal_name",
    ("[client_ip]", "Client IP Address"): "ip_address", ("[client_ip]", None): None,
    ("[cost_center]", None): None, ("[cost_center_number]", None): None,
    ("[credit_card]", None): "credit_card", ("[cc_num]", None): "credit_card", ("[cc_number]", None): "credit_card",
    ("[primary_account_number]", None): "credit_card", ("[pan_number]", None): "credit_card",
    ("[customer_email]", None): "email", ("[user_phone]", None): "phone",
    ("[customer_credit_card_number]", None): "credit_card",
    ("[ip_owner]", None): None, ("[ip_license_status]", None): None, ("[shipping_id]", None): None,
    ("[ip_address]", None): "ip_address", ("[ip-addr]", None): "ip_address", ("[ipv4_address]", None): "ip_address",
    ("[x]", "Social Security Number"): "ssn", ("[ssn_email]", None): "ssn", ("[Date of Birth]", None): "dob",
    ("[zip_code]", None): "address", ("[home address]", None): "address", ("[address]", None): None,
    ("[diagnosis]", None): "medical", ("[surname]", None): "personal_name", ("[emails]", None): None,
    ("[e-mail]", None): "email", ("[telephone]", None): "phone", ("[MRN]", None): "medical",
}


def test_field_name_vocabulary(spark):
    rows = spark.createDataFrame([(n, c, want) for (n, c), want in NAMES.items()], "n string, c string, want string")
    got = rows.withColumn("got", pii_label(F.col("n"), F.col("c")))
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    off = rows.select(pii_label(F.col("n"), F.col("c"), ["EMAIL"]).alias("x")).filter("x = 'email'")
    assert off.count() == 0
    assert rows.filter(pii_label(F.col("n"), F.col("c"), list(PII_TERMS)).isNotNull()).count() == 0


def test_formula_normal_form(spark):
    row = spark.createDataFrame([("\u00a0 A \t\n+  B ",)], "f string")
    assert row.select(normalize_formula(F.col("f"))).first()[0] == "a + b"


def test_registry():
    registry = default_registry()
    assert len(registry.rules) == 11 and registry.known_packs == ["all", "audit", "governance"]
    assert len(registry.for_pack(None)) == len(registry.for_pack("ALL")) == 11
    assert [r.meta.id for r in registry.for_pack("Governance")] == [f"GOV00{i}" for i in range(1, 6)]
    with pytest.raises(ValueError, match="unknown rule pack"):
        registry.for_pack("nope")
    with pytest.raises(ValueError, match="registered"):
        registry.register(registry.rules[0])


def test_catalogue(spark):
    rows = default_registry().catalogue(spark).collect()
    assert [r.rule_id for r in rows] == sorted(r.rule_id for r in rows) and len(rows) == 11


def test_rules_of_users(spark, findings):
    registry = Registry()
    registry.register(row_rule(
        RuleMeta("USR1", "Any sheet", "info", "d", "mine"), "worksheets", ["name"],
        lambda config: [Hit(F.col("name") == "Spare", F.lit("m"), F.col("name"))]))
    registry.register(set_rule(
        RuleMeta("USR2", "Per estate", "warn", "d"),
        lambda estate, config: estate.groupBy().agg(F.count("*").alias("n")).select(
            F.lit("*").alias("workbook_path"), F.col("n").cast("string").alias("message"),
            F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("remediation"),
            F.create_map().cast("map<string,string>").alias("properties"))))
    found = {r.rule_id: r for r in registry.run(findings[0]).collect()}
    assert found["USR1"].location == "Spare" and found["USR2"].message == "12"
    assert registry.run(findings[0], only=[]).count() == 0


def test_files_are_audited_without_a_store(spark):
    files = spark.createDataFrame(
        [(f"{rule}.twb", bytearray(xml.encode())) for rule, xml in ONE_EACH.items()], "path string, content binary")
    found = reports.audit_files(files, "audit")
    assert {r.rule_id for r in found.collect()} == {f"AUD00{i}" for i in range(1, 7)}


def test_one_scan_serves_all_rules(spark, ingest, tmp_path):
    path = str(tmp_path / "estate")
    ingest({"a.twb": workbook(source(body=column("[x]", "[y] + 1")))}).write.parquet(path)
    findings = default_registry().run(spark.read.parquet(path))
    plan = findings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    counted = findings.groupBy("severity").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("which is deprecated") and not counted.count("which is deprecated")


def test_repeated_and_broken_formulas_against_plain_python(spark, ingest):
    import random
    from collections import defaultdict

    rng = random.Random(11)
    books, repeats, broken = {}, set(), set()
    for b in range(25):
        sources, places, known, used = [], defaultdict(list), set(), []
        for s in range(rng.randrange(4)):
            body = ""
            for f in range(rng.randrange(8)):
                refs = [f"c{rng.randrange(10)}" for _ in range(rng.randrange(4))]
                formula = " + ".join(f"[{r}]" for r in refs) or None
                body += column(f"[c{f}]", formula)
                known.add((s, f"[c{f}]"))
                if formula:
                    places[formula].append(f"s{s}:[c{f}]")
                    used += [(s, f"[{r}]", f"[c{f}]") for r in refs]
            sources.append(source(f"s{s}", body))
        books[f"{b}.twb"] = workbook("".join(sources))
        repeats |= {(f"{b}.twb", ", ".join(p)) for p in places.values() if len(p) > 1}
        broken |= {(f"{b}.twb", f"datasource:s{s}/field:{name}", ref) for s, ref, name in used if (s, ref) not in known}
    found = default_registry().run(ingest(books), only=["AUD004", "AUD005"]).collect()
    assert {(r.workbook_path, r.message.split(": ", 1)[1][:-1]) for r in found if r.rule_id == "AUD004"} == repeats
    assert {(r.workbook_path, r.location, r.properties["referenced"]) for r in found if r.rule_id == "AUD005"} == broken
    assert len([r for r in found if r.rule_id == "AUD005"]) == len(broken) and broken and repeats
