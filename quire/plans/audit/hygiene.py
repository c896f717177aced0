"""Rules on workbook health: dead parts, broken or repeated formulas, age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import (
    calls_function, column_references, held, normalize_formula, version_number,
)
from quire.operators.tables import members
from quire.plans.audit.config import GovernanceConfig
from quire.plans.audit.registry import Hit, RuleMeta, fold_rule, row_rule

PACK = "audit"

# Fixed values.
DEPRECATED_FUNCTIONS = {
    "ATTR": "Use MIN or MAX where one value per partition is meant.",
    "WINDOW_VAR": "Use VAR inside a level-of-detail expression.",
}
VERSION_FLOOR = 18.0


def _text(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def field_location() -> Column:
    return _text("datasource:", F.col("datasource"), "/field:", F.col("name"))


def _runs(items: Column, key: str) -> Column:
    """The stretches of equal ``key`` of an array of structs, ordered by that key first.

    The array is sorted once and cut where the key changes, so the cost does not depend on how many are equal.
    """
    def cut(ordered: Column) -> Column:
        def changes(i: Column) -> Column:
            return (i == 0) | ~F.get(ordered, i)[key].eqNullSafe(F.get(ordered, i - 1)[key])

        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(
            F.array().cast("array<int>"))

        def stretches(starts: Column) -> Column:
            return F.transform(starts, lambda p, j: F.slice(
                ordered, p + 1, F.coalesce(F.get(starts, j + 1), F.size(ordered)) - p))

        return held(F.filter(places, changes), stretches)

    return held(F.array_sort(items), cut)


# ---- AUD001 -------------------------------------------------------------------
def _unused_worksheets(rows: DataFrame, name: str) -> DataFrame:
    shown = F.flatten("dashboards.referenced_worksheets")
    unused = F.when(F.size("dashboards.pos") > 0, F.array_except("worksheets.name", shown)).otherwise(
        F.array().cast("array<string>"))
    return rows.withColumn(name, F.transform(F.array_compact(unused), lambda n: F.struct(n.alias("name"))))


def _unused_worksheet(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=F.lit(True),
        message=_text("No dashboard shows worksheet '", F.col("name"), "'."),
        location=_text("worksheet:", F.col("name")),
        remediation="Put it on a dashboard or delete it.",
    )]


# ---- AUD002 -------------------------------------------------------------------
def _orphan_sources(rows: DataFrame, name: str) -> DataFrame:
    used = F.flatten("worksheets.datasource_names")
    # Back to the full list: two sources may share an unused name.
    return rows.withColumn(name, held(F.array_except("datasources.name", used), lambda orphans: F.when(
        F.size(orphans) > 0, F.transform(
            F.filter("datasources.name", lambda n: F.array_contains(orphans, n)), lambda n: F.struct(n.alias("name"))),
    ).otherwise(F.array().cast("array<struct<name:string>>"))))


def _orphan_source(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=F.lit(True),
        message=_text("No worksheet uses data source '", F.col("name"), "'."),
        location=_text("datasource:", F.col("name")),
        remediation="Use it in a worksheet or remove it.",
    )]


# ---- AUD003 -------------------------------------------------------------------
def _deprecated_functions(config: GovernanceConfig) -> list[Hit]:
    return [
        Hit(
            when=calls_function(F.col("calc_formula"), [name]),
            message=_text("Formula of '", F.col("name"), "' on '", F.col("datasource"),
                          f"' calls {name}(), which is deprecated."),
            location=field_location(),
            remediation=hint,
            properties={"function": F.lit(name)},
        )
        for name, hint in DEPRECATED_FUNCTIONS.items()
    ]


# ---- AUD004 -------------------------------------------------------------------
def _repeated_formulas(rows: DataFrame, name: str) -> DataFrame:
    calculated = F.filter(
        members("fields", "ds_pos", "pos", "datasource", "name", "calc_formula"),
        lambda f: f["calc_formula"].isNotNull(),
    )

    def repeated(calculated: Column, normal: Column) -> Column:
        keyed = F.transform(calculated, lambda f, i: F.struct(
            F.get(normal, i).alias("formula"), f["ds_pos"].alias("ds_pos"), f["pos"].alias("pos"),
            f["datasource"].alias("datasource"), f["name"].alias("name")))
        found = F.transform(F.filter(_runs(keyed, "formula"), lambda r: F.size(r) > 1), lambda r: F.struct(F.transform(
            r, lambda p: F.struct(p["datasource"].alias("datasource"), p["name"].alias("name"))).alias("places")))
        # Most workbooks repeat none: only the others are sorted.
        return F.when(F.size(F.array_distinct(normal)) < F.size(normal), found).otherwise(
            F.array().cast("array<struct<places:array<struct<datasource:string,name:string>>>>"))

    return rows.withColumn(name, held(calculated, lambda c: held(
        F.transform(c, lambda f: normalize_formula(f["calc_formula"])), lambda normal: repeated(c, normal))))


def _repeated_formula(config: GovernanceConfig) -> list[Hit]:
    count = F.size("places").cast("string")
    listed = F.array_join(
        F.transform("places", lambda p: F.concat(p["datasource"], F.lit(":"), p["name"])), ", ")
    first = F.get("places", F.lit(0))
    return [Hit(
        when=F.lit(True),
        message=_text("The same formula stands in ", count, " places: ", listed, "."),
        location=_text(first["datasource"], "/", first["name"]),
        remediation="Keep it once, as a parameter or in a shared data source.",
        properties={"count": count},
    )]


# ---- AUD005 -------------------------------------------------------------------
def _broken_references(rows: DataFrame, name: str) -> DataFrame:
    def key(pos: Column, column: Column) -> Column:
        return F.concat_ws("|", pos.cast("string"), column)

    def entry(k: Column, used: bool, source: Column, field: Column) -> Column:
        return F.struct(k.alias("key"), F.lit(used).alias("used"), source.alias("datasource"), field.alias("name"))

    none = F.lit(None).cast("string")
    known = F.transform(
        members("fields", "ds_pos", "name"), lambda f: entry(key(f["ds_pos"], f["name"]), False, none, none))
    calcs = F.filter(
        members("fields", "ds_pos", "datasource", "name", "calc_formula"),
        lambda f: f["calc_formula"].isNotNull(),
    )
    used = F.flatten(F.transform(calcs, lambda f: F.transform(
        F.array_distinct(column_references(f["calc_formula"])),
        lambda r: entry(key(f["ds_pos"], r), True, f["datasource"], f["name"]))))
    names = F.transform(members("fields", "ds_pos", "name"), lambda f: key(f["ds_pos"], f["name"]))

    def broken(references: Column) -> Column:
        # A known column stands before the references to it, so a stretch that begins with a reference is broken.
        stretches = F.filter(_runs(F.concat(known, references), "key"), lambda r: F.get(r, F.lit(0))["used"])
        # Most workbooks have none: only the others are sorted.
        any_broken = (F.size(references) > 0) & (F.size(F.array_except(references["key"], names)) > 0)
        return F.transform(F.when(any_broken, F.flatten(stretches)).otherwise(F.slice(references, 1, 0)), lambda e: F.struct(
            e["datasource"].alias("datasource"), e["name"].alias("name"),
            F.regexp_replace(e["key"], r"^\d+\|", "").alias("ref")))

    return rows.withColumn(name, held(used, broken))


def _broken_reference(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=F.lit(True),
        message=_text("Formula of '", F.col("name"), "' refers to ", F.col("ref"),
                      ", which data source '", F.col("datasource"), "' does not have."),
        location=field_location(),
        remediation="Correct the reference or bring the column back.",
        properties={"referenced": F.col("ref")},
    )]


# ---- AUD006 -------------------------------------------------------------------
def _old_version(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=version_number(F.col("version")) < VERSION_FLOOR,
        message=_text("Saved as version '", F.col("version"), f"', below {VERSION_FLOOR:g}."),
        location=F.lit("workbook"),
        remediation="Open it in a current release and save it again.",
        properties={"version": F.col("version")},
    )]


RULES = [
    fold_rule(RuleMeta(
        "AUD001", "Unused worksheet", "warn",
        "A worksheet that no dashboard of the workbook shows.", PACK), _unused_worksheets, _unused_worksheet),
    fold_rule(RuleMeta(
        "AUD002", "Orphan data source", "warn",
        "A data source that no worksheet uses.", PACK), _orphan_sources, _orphan_source),
    row_rule(RuleMeta(
        "AUD003", "Deprecated function", "warn",
        "A formula that calls a deprecated function.", PACK),
        "fields", ["datasource", "name", "calc_formula"], _deprecated_functions),
    fold_rule(RuleMeta(
        "AUD004", "Repeated formula", "info",
        "The same formula in several calculated fields of a workbook.", PACK), _repeated_formulas, _repeated_formula),
    fold_rule(RuleMeta(
        "AUD005", "Broken column reference", "error",
        "A formula that refers to a column its data source lacks.", PACK), _broken_references, _broken_reference),
    row_rule(RuleMeta(
        "AUD006", "Old workbook version", "info",
        "A workbook saved by a release below the supported floor.", PACK),
        "workbook", ["version"], _old_version),
]
