"""Rules on credentials, servers, personal data and access control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import (
    is_external_server, is_profile_path, pii_label, references_user_identity,
)
from quire.plans.audit.config import GovernanceConfig
from quire.plans.audit.hygiene import _text, field_location
from quire.plans.audit.registry import Hit, RuleMeta, row_rule

PACK = "governance"


def _connection_location() -> Column:
    kind = F.coalesce("conn_class", F.lit(""))
    return _text("datasource:", F.col("datasource"), "/connection:", kind)


def _embedded_credentials(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=F.col("has_password"),
        message=_text("A connection of data source '", F.col("datasource"), "' stores a password."),
        location=_connection_location(),
        remediation="Remove the password; let the server, the user's login or a prompt supply it.",
    )]


def _external_server(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=is_external_server(F.col("server"), config.allowed_servers),
        message=_text("Data source '", F.col("datasource"), "' connects to '", F.col("server"),
                      "', which is not an approved server."),
        location=_connection_location(),
        remediation="Connect to an approved server, or approve this one.",
        properties={"server": F.col("server")},
    )]


def _pii_label(config: GovernanceConfig) -> dict[str, Column]:
    return {"label": pii_label(F.col("name"), F.col("caption"), config.disabled_pii_labels)}


def _pii_fields(config: GovernanceConfig) -> list[Hit]:
    label = F.col("label")
    return [Hit(
        when=label.isNotNull(),
        message=_text("The name of field '", F.col("name"), "' on '", F.col("datasource"),
                      "' reads like personal data (", label, ")."),
        location=field_location(),
        remediation="Check that it may be published, or take it out.",
        properties={"pattern": label},
    )]


def _user_identity(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=references_user_identity(F.col("calc_formula")),
        message=_text("Formula of '", F.col("name"), "' on '", F.col("datasource"),
                      "' decides by who is looking."),
        location=field_location(),
        remediation="Filter rows in the data source; a formula in the workbook can be bypassed.",
    )]


def _profile_path(config: GovernanceConfig) -> list[Hit]:
    return [Hit(
        when=is_profile_path(F.col("filename")),
        message=_text("Data source '", F.col("datasource"), "' reads '", F.col("filename"),
                      "' from a user's own folder."),
        location=_connection_location(),
        remediation="Move the file to a shared place, or use an extract.",
        properties={"path": F.col("filename")},
    )]


RULES = [
    row_rule(RuleMeta(
        "GOV001", "Embedded password", "error",
        "A connection that stores a password in the workbook.", PACK),
        "connections", ["datasource", "conn_class", "has_password"], _embedded_credentials),
    row_rule(RuleMeta(
        "GOV002", "Unapproved server", "warn",
        "A connection to a server that is not approved.", PACK),
        "connections", ["datasource", "conn_class", "server"], _external_server),
    row_rule(RuleMeta(
        "GOV003", "Personal data in field name", "warn",
        "A field whose name or caption suggests personal data.", PACK),
        "fields", ["datasource", "name", "caption"], _pii_fields, derive=_pii_label),
    row_rule(RuleMeta(
        "GOV004", "Access control in a formula", "warn",
        "A formula that depends on the identity of the viewer.", PACK),
        "fields", ["datasource", "name", "calc_formula"], _user_identity),
    row_rule(RuleMeta(
        "GOV005", "File in a user profile", "warn",
        "A connection to a file in somebody's own folder.", PACK),
        "connections", ["datasource", "conn_class", "filename"], _profile_path),
]
