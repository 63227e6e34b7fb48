"""Roll-ups of findings and files: project, directories, grades and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.sources.changes import roots

#: label -> the types of findings it counts
BREAKDOWN_GROUPS = {
    "Complex Functions": ("high_complexity", "moderate_complexity"),
    "Long Functions": ("long_function",),
    "Code Duplication": ("code_duplication",),
    "Unused Imports": ("unused_import",),
    "TODO Markers": ("todo_marker",),
    "Dead Code": ("dead_code",),
    "Deep Nesting": ("deep_nesting",),
    "Error Handling": ("empty_error_handler", "error_swallowing"),
}


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Findings per file, type, severity and category."""
    return issues.groupBy("file_id", "path", "type", "severity", "category").agg(
        F.count(F.lit(1)).alias("issue_count"))


def issues_per_file(issues: DataFrame) -> DataFrame:
    """``(file_id, issue_count, security_issues, quality_issues, ai_issues)``."""
    category = F.col("category")
    return issues.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("issue_count"),
        _count_if(category == fv.SECURITY).alias("security_issues"),
        _count_if(category == fv.QUALITY).alias("quality_issues"),
        _count_if(category == fv.AI_PATTERN).alias("ai_issues"),
    )


def summary(file_report: DataFrame) -> DataFrame:
    """One row for the whole project.  Findings are counted per file before."""
    return file_report.agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        _count_if(F.col("issue_count") > 0).alias("files_flagged"),
        F.coalesce(F.sum("complexity") / F.count(F.lit(1)), F.lit(0.0)).alias("avg_complexity"),
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total_issues"),
        _count_if(F.col("ai_score") > fv.AI_SUSPECTED_ABOVE).alias("ai_suspected"),
        F.coalesce(F.sum("security_issues"), F.lit(0)).alias("security_issues"),
    )


def totals(files: DataFrame) -> DataFrame:
    """What the gate needs of files with counts of findings."""
    return files.agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum("security_issues"), F.lit(0)).alias("security_issues"),
    )


def gate(summary: DataFrame) -> DataFrame:
    """The verdict on a project: FAIL/2 on security findings, WARN/1 on any, else PASS/0."""
    unsafe, flagged = F.col("security_issues") > 0, F.col("total_issues") > 0
    return summary.select(
        "files_analyzed", "total_issues", "security_issues",
        F.when(unsafe, "FAIL").when(flagged, "WARN").otherwise("PASS").alias("verdict"),
        F.when(unsafe, 2).when(flagged, 1).otherwise(0).alias("exit_code"),
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """Security findings by severity, in one row."""
    severity = F.col("severity")
    return issues.filter(F.col("category") == fv.SECURITY).agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(severity == fv.CRITICAL).alias("critical"),
        _count_if(severity == fv.ERROR).alias("error"),
        _count_if(severity == fv.WARNING).alias("warning"),
        _count_if(~severity.isin(fv.CRITICAL, fv.ERROR, fv.WARNING)).alias("info"),
    )


def ai_tier() -> Column:
    return (
        F.when(F.col("ai_score") > fv.AI_HIGH_ABOVE, "high")
        .when(F.col("ai_score") > fv.AI_MODERATE_ABOVE, "moderate")
        .when(F.col("ai_issues") > 0, "low")
        .otherwise("none")
    )


def ai_tiers(file_report: DataFrame) -> DataFrame:
    return file_report.groupBy(ai_tier().alias("tier")).agg(F.count(F.lit(1)).alias("files"))


def uniform_sizes(functions: DataFrame) -> DataFrame:
    """Files of more than three functions that are all within half of the mean size.

    The extremes decide, so one aggregate is enough.
    """
    size = F.col("line_count").cast("long")
    mean = F.floor(F.col("total") / F.col("n")).cast("long")
    slack = F.floor(F.col("mean_size") / 2)
    return (
        functions.groupBy("file_id", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"),
             F.min(size).alias("low"), F.max(size).alias("high"))
        .filter(F.col("n") > 3)
        .withColumn("mean_size", mean)
        .filter((F.col("high") - F.col("mean_size") <= slack)
                & (F.col("mean_size") - F.col("low") <= slack))
        .select("file_id", "path", F.col("n").alias("functions"), "mean_size")
    )


def quality_metrics(file_report: DataFrame, issues: DataFrame) -> DataFrame:
    """The figures of the quality view, in one row."""
    kind, is_quality = F.col("type"), F.col("category") == fv.QUALITY
    counts = issues.agg(
        _count_if(is_quality).alias("quality_issues"),
        _count_if(is_quality & (kind == "long_function")).alias("long_functions"),
        _count_if(is_quality & kind.isin("high_complexity", "moderate_complexity"))
        .alias("complex_functions"),
        _count_if(is_quality & (kind == "code_duplication")).alias("duplications"),
        _count_if(is_quality & (kind == "unused_import")).alias("unused_imports"),
        _count_if(is_quality & (kind == "todo_marker")).alias("todos"),
        _count_if(kind == "dead_code").alias("dead_code"),
        _count_if(kind == "deep_nesting").alias("deep_nesting"),
        _count_if(kind.isin("empty_error_handler", "error_swallowing")).alias("error_handling"),
    )
    files = file_report.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("n_functions"), F.lit(0)).alias("total_functions"),
        _count_if(F.col("quality_issues") > 0).alias("files_with_issues"),
        F.coalesce(F.sum("complexity") / F.count(F.lit(1)), F.lit(0.0)).alias("avg_complexity"),
        F.coalesce(F.avg("comment_ratio") * 100, F.lit(0.0)).alias("avg_comment_percent"),
    )
    counts = counts.withColumnRenamed("quality_issues", "total_quality_issues")
    both = files.unionByName(counts, allowMissingColumns=True)  # two rows, each with its half
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def quality_grade(metrics: DataFrame) -> DataFrame:
    """Score and grade of a project; all figures come along."""
    over = F.greatest(F.lit(0.0), F.col("avg_complexity") - 15)
    score = F.greatest(
        F.lit(0.0),
        100.0 - F.col("long_functions") * 3 - F.col("complex_functions") * 4
        - F.col("duplications") * 2 - F.col("unused_imports") - over * 2,
    )
    grade = (
        F.when(F.col("score") < 50, "Needs Work").when(F.col("score") < 70, "Fair")
        .when(F.col("score") < 85, "Good").otherwise("Excellent")
    )
    return metrics.withColumn("score", score).withColumn("grade", grade)


def issue_breakdown(issues: DataFrame) -> DataFrame:
    """Count and share of the eight groups; empty groups are left out."""
    counted = issues.filter(F.col("category") == fv.QUALITY).agg(
        F.count(F.lit(1)).alias("total"),
        *[_count_if(F.col("type").isin(list(types))).alias(label)
          for label, types in BREAKDOWN_GROUPS.items()],
    )
    groups = F.array(
        *[F.struct(F.lit(label).alias("label"), F.col(label).alias("issue_count"))
          for label in BREAKDOWN_GROUPS])
    return (
        counted.select("total", F.inline(groups))
        .filter(F.col("issue_count") > 0)
        .select("label", "issue_count", (F.col("issue_count") / F.col("total")).alias("share"))
    )


def directory_rollup(file_report: DataFrame) -> DataFrame:
    """Files, lines, findings and complexity below every directory; the top is '' (of each ``root``)."""
    parts = F.split("path", "/", -1)
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(F.split("path", "/", -1), 1, n), "/"),
    )
    return (
        file_report.select(
            *roots(file_report), F.explode_outer(ancestors).alias("directory"), "line_count", "complexity",
            "issue_count", "security_issues")
        .groupBy(*roots(file_report), "directory")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("line_count").alias("line_count"),
            F.sum("complexity").alias("complexity"),
            F.sum("issue_count").alias("issue_count"),
            F.sum("security_issues").alias("security_issues"),
        )
    )


def tree_listing(files: DataFrame) -> DataFrame:
    """All directories and files below the root: directories first, names without case."""
    parts = F.split("path", "/", -1)
    nodes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(
            F.array_join(F.slice(F.split("path", "/", -1), 1, n - 1), "/").alias("parent"),
            F.get(F.split("path", "/", -1), n - 1).alias("name"),
            (n < F.size(F.split("path", "/", -1))).alias("is_dir"),
        ),
    )
    return (
        files.select(F.explode_outer(nodes).alias("n"))
        .select("n.parent", "n.name", "n.is_dir")
        .distinct()
        .withColumn(
            "depth",
            F.when(F.col("parent") == "", 0)
            .otherwise(F.size(F.split("parent", "/", -1))),
        )
        .orderBy("parent", F.desc("is_dir"), F.lower("name"), "name")
    )
