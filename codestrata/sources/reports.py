"""Stored results: JSON and Markdown reports, and a full dump that can be read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.operators.findings import ORDER
from codestrata.operators.ranking import numbered
from codestrata.session import cut
from codestrata.sources.corpus import walk_key

FUNCTION_SCHEMA = "struct<name:string,start_line:int,end_line:int,complexity:int,line_count:int>"
ISSUE_SCHEMA = (
    "struct<line:int,type:string,severity:int,category:int,message:string,fix:string>"
)
DUMP_SCHEMA = (
    "path string, language string, line_count int, ai_probability double, complexity int,"
    f" functions array<{FUNCTION_SCHEMA}>, issues array<{ISSUE_SCHEMA}>, git_info"
    " struct<commit_count:int,last_author:string,last_modified:string,authors:array<string>>,"
    " comment_ratio double"
)


def _nested(rows: DataFrame, order: tuple[str, ...], alias: str, /, **fields) -> DataFrame:
    """The rows of a file as one ordered list.  A file's rows are bounded by its size."""
    item = F.struct(*order, F.struct(*[c.alias(k) for k, c in fields.items()]).alias("item"))
    return rows.groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(alias))


def json_report(file_report: DataFrame, issues: DataFrame) -> DataFrame:
    """The files of the JSON report: all with findings, and those with a higher score."""
    nested = _nested(
        issues, ORDER, "issues",
        line=F.col("line_no"), type=F.col("type"), severity=text.severity_name(),
    )
    kept = file_report.filter(
        (F.col("issue_count") > 0) | (F.col("ai_score") >= fv.JSON_KEEP_FROM))
    return kept.join(nested, "file_id", "left").select(
        "path", (F.col("ai_score") / 100).alias("ai_probability"), "complexity", "issues")


def write_json_report(
    summary: DataFrame, file_report: DataFrame, issues: DataFrame, out: str
) -> None:
    """Two JSON data sets below ``out``: ``summary`` and ``files``."""
    summary.select("files_analyzed", "files_flagged", "avg_complexity", "total_issues").write.mode(
        "overwrite").json(f"{out}/summary")
    json_report(file_report, issues).write.mode("overwrite").json(f"{out}/files")


def json_document(summary: DataFrame, file_report: DataFrame, issues: DataFrame) -> DataFrame:
    """All lines of the JSON report as one document, ``(line_no, value)``.

    A file is a line that opens it, one for each finding, and one that closes it. Findings stand beside
    their file by their order alone and are never gathered, so a file may have any number of them.
    Whether a finding is the first of its file, and goes without a comma, is told by the number of its line.
    """
    kept = file_report.filter((F.col("issue_count") > 0) | (F.col("ai_score") >= fv.JSON_KEEP_FROM))
    opened = F.concat(
        F.regexp_replace(F.to_json(F.struct("path")), r"\}\z", ""),
        F.format_string(',"ai_probability":%.6f,"complexity":%d,"issues":[', F.col("ai_score") / 100 + 1e-9, "complexity"))
    found = F.format_string(
        '{"line":%d,"type":"%s","severity":"%s"}', F.col("line_no"), F.col("type"), text.severity_name())
    head = F.format_string(
        '{"summary":{"files_analyzed":%d,"files_flagged":%d,"avg_complexity":%.6f,"total_issues":%d},"files":[',
        "files_analyzed", "files_flagged", F.col("avg_complexity") + 1e-9, "total_issues")

    def rows(df: DataFrame, part: int, kind: int, line: Column, of_file: bool = True, order=None) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"), (F.col("path") if of_file else F.lit("")).alias("path"),
            *[F.col(c) if of_file else F.lit(None).cast(kinds[c]).alias(c) for c in key], F.lit(kind).alias("kind"),
            *[(F.col(c) if order else F.lit(0)).cast("long").alias(c) for c in ORDER], line.alias("text"))

    # a path may stand in several roots; the findings know their file
    key, kinds = ["file_id"], dict(file_report.dtypes)
    lines = (
        rows(summary, 1, 0, head, of_file=False)
        .unionAll(rows(kept, 2, 1, opened)).unionAll(rows(issues, 2, 2, found, order=True)).unionAll(rows(kept, 2, 3, F.lit("]}")))
        .unionAll(rows(summary, 3, 0, F.lit("]}"), of_file=False)))
    placed = cut(numbered(lines, ["part", walk_key(), *key, "kind", *ORDER], "line_no").select("line_no", "kind", "text"))
    opens = placed.filter(F.col("kind") == 1).select((F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("first"))
    first = F.when(F.col("kind") == 1, F.col("line_no") == 2).when(F.col("kind") == 2, F.coalesce("first", F.lit(False))).otherwise(True)
    return placed.join(opens, "line_no", "left").select(
        "line_no", F.concat(F.when(first, "").otherwise(","), "text").alias("value"))


def full_dump(file_report: DataFrame, functions: DataFrame, issues: DataFrame) -> DataFrame:
    """Every file with its functions, findings and history, in ``DUMP_SCHEMA``."""
    nested_issues = _nested(
        issues, ORDER, "issues",
        line=F.col("line_no"), type=F.col("type"), severity=F.col("severity"),
        category=F.col("category"), message=F.col("message"), fix=F.col("fix"),
    )
    nested_functions = _nested(
        functions, ("start_line",), "functions",
        **{c: F.col(c) for c in ("name", "start_line", "end_line", "complexity", "line_count")},
    )
    git = F.col("git_info") if "git_info" in file_report.columns else F.lit(None)
    return (
        file_report.join(nested_functions, "file_id", "left")
        .join(nested_issues, "file_id", "left")
        .select(
            "path", "language", "line_count", F.col("ai_score").alias("ai_probability"),
            "complexity", "functions", "issues", git.alias("git_info"), "comment_ratio",
        )
    )


def write_dump(dump: DataFrame, out: str) -> None:
    dump.write.mode("overwrite").json(out)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A stored result; nothing is analysed again."""
    return spark.read.schema(DUMP_SCHEMA).json(path)


def issues_of_dump(dump: DataFrame) -> DataFrame:
    """The findings of a stored result as rows."""
    return dump.select("path", F.inline("issues"))


def markdown_rows(summary: DataFrame, file_report: DataFrame, issues: DataFrame) -> DataFrame:
    """The table rows of the Markdown report as ``(part, severity, path, ord..., text)``.

    Parts: 1 summary, 2 findings (most severe first), 3 suspected files.
    """
    def rows(df: DataFrame, part: int, severity, path, order, line) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"), severity.alias("severity"), path.alias("path"),
            *[o.cast("long").alias(n) for n, o in zip(ORDER, order)], line.alias("text"))

    none = [F.lit(0)] * len(ORDER)
    lines = F.array(
        *[F.format_string(f"| {label} | {fmt} |", F.bround(c, 1) if fmt == "%.1f" else F.col(c))
          for label, fmt, c in fv.REPORT_FIGURES])
    head = summary.select(F.posexplode(lines).alias("n", "line"))
    finding_line = F.format_string("| `%s` | %d | %s | %s |", "path", "line_no", "type", "message")
    # a half goes to the even number, as the report prints it
    percent = F.bround("ai_score", 0).cast("int")
    suspected = file_report.filter(F.col("ai_score") > fv.AI_REPORT_ABOVE)
    suspected_line = F.format_string(
        "| `%s` | %s %d%% | %d |", F.col("path"), text.bar(F.col("ai_score") / 100, 10),
        percent, F.col("complexity"))
    zero = F.lit(0)
    return (
        rows(head, 1, zero, F.lit(""), [F.col("n"), *none[1:]], F.col("line"))
        .unionByName(rows(issues, 2, F.col("severity"), F.col("path"),
                          [F.col(c) for c in ORDER], finding_line))
        .unionByName(rows(suspected, 3, zero, F.col("path"), none, suspected_line))
    )


def markdown_report(
    summary: DataFrame, file_report: DataFrame, issues: DataFrame, root_dir: str,
    title: str = fv.REPORT_TITLE,
) -> DataFrame:
    """All lines of the Markdown report as ``(line_no, value)``.

    Files come as a walk meets them, findings of a file in the order of the passes."""
    spark = summary.sparkSession

    def fixed(part: int, severity: int, block: int, texts) -> DataFrame:
        return spark.createDataFrame(
            [(part, severity, block, n, t) for n, t in enumerate(texts)],
            "part int, severity int, block int, n int, text string")

    body = markdown_rows(summary, file_report, issues).withColumns({"block": F.lit(1), "n": F.lit(0)})
    heading = [f"# {title}", "", f"**Directory:** `{root_dir}`", "", *fv.REPORT_SUMMARY_HEAD]
    sections = reduce(DataFrame.unionAll, [
        fixed(2, s, 0, ["", name, "", *fv.REPORT_ISSUE_HEAD]) for s, name in fv.REPORT_SECTIONS.items()])
    suspects = fixed(3, 0, 0, ["", *fv.REPORT_SUSPECT_HEAD])
    # a section without rows has no heading; there are four severities at most
    used = body.filter("part > 1").select("part", "severity").distinct()
    frame = (
        fixed(1, 0, 0, heading)
        .unionAll(sections.unionAll(suspects).join(F.broadcast(used), ["part", "severity"], "left_semi")
                  .select("part", "severity", "block", "n", "text"))
        .unionAll(fixed(4, 0, 0, fv.REPORT_FOOT))
        .withColumns({"path": F.lit(""), **{c: F.lit(0).cast("long") for c in ORDER}})
    )
    order = ["part", F.desc("severity"), "block", "n", walk_key(), *ORDER, "text"]
    return numbered(body.unionByName(frame), order, "line_no").select("line_no", F.col("text").alias("value"))


def write_lines(report: DataFrame, out: str) -> None:
    """Write a report's lines in order; part files in name order make up the document."""
    report.orderBy("line_no").select("value").write.mode("overwrite").text(out)
