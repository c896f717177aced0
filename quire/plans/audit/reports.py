"""What is asked of a findings table: order, filter, counts, gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.audit.config import GovernanceConfig
from quire.plans.audit.registry import SEVERITIES, Registry, default_registry
from quire.sources.workbooks import ingest, readable


def audit_files(
    files: DataFrame, pack: str | None = None, config: GovernanceConfig | None = None,
    registry: Registry | None = None,
) -> DataFrame:
    """Findings over workbook files (``path, content``) that no store holds yet.

    The files are parsed once, into the shared folder: the rules read their own
    columns from there instead of each parsing the files again.
    """
    return (registry or default_registry()).run(ingest(files), pack, config)


def severity_rank(severity: Column) -> Column:
    ranks = [x for rank, name in enumerate(SEVERITIES) for x in (F.lit(name), F.lit(rank))]
    return F.try_element_at(F.create_map(*ranks), severity)


def ordered(findings: DataFrame) -> DataFrame:
    """Gravest first, then by rule."""
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), "rule_id", "workbook_path", "location")


def filtered(
    findings: DataFrame, severities: Iterable[str] = SEVERITIES, text: str | None = None
) -> DataFrame:
    """Findings of some severities that contain a text, literally and in any case."""
    kept = findings.filter(F.col("severity").isin(list(severities)))
    needle = (text or "").strip().lower()
    if not needle:
        return kept
    places = ["title", "message", "rule_id", "location"]
    hit = F.lit(False)
    for place in places:
        hit = hit | F.coalesce(F.lower(place).contains(F.lit(needle)), F.lit(False))
    return kept.filter(hit)


def _counts() -> list[Column]:
    by_severity = [
        F.count_if(F.col("severity") == name).alias(f"{name}_count") for name in reversed(SEVERITIES)
    ]
    return [*by_severity, F.count("*").alias("total_count")]


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*_counts())


def by_workbook(findings: DataFrame) -> DataFrame:
    """Findings per workbook and severity; only workbooks that have any."""
    return findings.groupBy("workbook_path").agg(*_counts())


def gate(estate: DataFrame, findings: DataFrame) -> DataFrame:
    """Exit code per workbook: 2 for an error, 1 for a warning, else 0."""
    code = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    worst = findings.groupBy(F.col("workbook_path").alias("path")).agg(F.max(code).alias("code"))
    return (
        readable(estate).select("path")
        .join(worst, "path", "left")
        .select("path", F.coalesce("code", F.lit(0)).alias("exit_code"))
    )
