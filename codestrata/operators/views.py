"""The report views: findings with their source line, files by tier, files by quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.operators.findings import ORDER
from codestrata.operators.rollup import ai_tier


def of_category(issues: DataFrame, category: int) -> DataFrame:
    return issues.filter(F.col("category") == category)


def snippet(line: Column) -> Column:
    """The text of a line as shown beside a finding.

    Limits are in bytes; a character that a limit falls into goes.
    """
    return text.cut(text.strip(text.cut(line, 80, 77)), 70, 67)


def security_view(found: DataFrame) -> DataFrame:
    """From the findings of the rules with the ``snippet`` that the scan cut for them."""
    return found.select(
        "path", "line_no", text.severity_label().alias("label"), "type", "snippet",
        "message", "fix", *ORDER,
    )


def ai_view(file_report: DataFrame, issues: DataFrame, uniform: DataFrame) -> DataFrame:
    """Files of the two upper tiers, a row per reason (at least one row per file)."""
    tiers = file_report.select(
        "file_id", "path", "ai_score", ai_tier().alias("tier")
    ).filter(F.col("tier").isin("high", "moderate"))
    reasons = of_category(issues, fv.AI_PATTERN).select(
        "file_id", F.col("message").alias("reason"), *ORDER)
    note = F.concat(
        F.lit("Functions uniformly sized (~"), F.col("mean_size").cast("string"),
        F.lit(" lines) — typical AI pattern"))
    notes = uniform.select(
        "file_id", note.alias("reason"), F.lit(9).alias("pass_no"), F.lit(0).alias("check_no"),
        F.lit(0).cast("long").alias("ord"), F.lit(0).alias("rule_no"))
    return tiers.join(reasons.unionByName(notes), "file_id", "left").select(
        "path", "tier", F.format_string("%.0f%%", F.bround("ai_score", 0)).alias("score"),
        F.coalesce("reason", F.lit("")).alias("reason"), *ORDER,
    )


def quality_view(issues: DataFrame) -> DataFrame:
    return of_category(issues, fv.QUALITY).select(
        "path", "line_no", text.severity_label().alias("label"), "message", "fix", *ORDER)


def in_report_order(issues: DataFrame) -> DataFrame:
    """Findings of a file in the order in which the passes and checks report them."""
    return issues.orderBy("path", *ORDER)


def by_severity(issues: DataFrame) -> DataFrame:
    """The most severe findings first, within a severity by file and report order."""
    return issues.orderBy(F.desc("severity"), "path", *ORDER)
