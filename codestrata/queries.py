"""The registered queries: every operator over the corpus derived from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.operators import ai, churn, complexity, quality, rollup, security, views
from codestrata.operators.findings import ISSUE_COLUMNS
from codestrata.plans.analysis import Analysis
from codestrata.session import shared_folder
from codestrata.sources import changes, corpus, derived, reports, tree
from codestrata.streaming.corrections import Corrected
from codestrata.sources.lines import (
    line_count, per_file, with_line_columns,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: Parameters of queries whose default limit the derived corpus does not reach.
SMALL_FILE_BYTES = 1500
CHUNK_BYTES = 700
NEWEST_OF_ROOT = 20
WALK_FIRST = 300
TOP_CHURN = 25
REPORT_ROOT = "corpus"


class Inputs:
    """The corpus and history of one scale, and what single operators need of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw_files(self) -> DataFrame:
        return derived.code_files(self.spark, self.sf_dir)

    @cached_property
    def analysis(self) -> Analysis:
        return Analysis(self.raw_files, co_located=True, keep=False)

    @cached_property
    def files(self) -> DataFrame:
        return self.analysis.files

    @cached_property
    def lines(self) -> DataFrame:
        return self.analysis.lines

    @cached_property
    def described(self) -> DataFrame:
        return with_line_columns(self.lines)

    @cached_property
    def functions(self) -> DataFrame:
        return complexity.functions(self.lines)

    @cached_property
    def starts(self) -> DataFrame:
        return complexity.function_starts(self.lines)

    @cached_property
    def change_log(self) -> DataFrame:
        return derived.change_log(self.spark, self.sf_dir)

    @cached_property
    def ordered_log(self) -> DataFrame:
        return derived.ordered_change_log(self.spark, self.sf_dir)


_shared: dict[tuple[str, str], Analysis] = {}


def shared_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """One analysis with a persisted corpus for all queries that need every pass."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        release_shared()
        _shared[key] = Analysis(
            derived.code_files(spark, sf_dir), derived.change_log(spark, sf_dir),
            co_located=True, keep=True)
    return _shared[key]


def release_shared() -> None:
    for analysis in _shared.values():
        if analysis.files.sparkSession.sparkContext._jsc is not None:
            analysis.release()
    _shared.clear()


class TextInputs(Inputs):
    """The texts of a table as files, all rows and all text."""

    def __init__(self, spark: SparkSession, sf_dir: str, table: str):
        super().__init__(spark, sf_dir)
        self.table = table

    @cached_property
    def raw_files(self) -> DataFrame:
        return derived.text_files(self.spark, self.sf_dir, self.table)

    @cached_property
    def analysis(self) -> Analysis:
        return Analysis(self.raw_files, keep=False)


#: Checks that also run over the plain texts of these tables, as ``<table>_<check>``.
TEXT_TABLES = ("documents", "pages")
TEXT_CHECKS = (
    "line_explode", "security_scan", "identifier_tokens", "magic_numbers", "code_duplication",
    "formatting", "line_length_dist", "generic_repetition", "branch_counts", "comment_quality",
)


def single(name: str):
    """Register a query over fresh inputs."""
    def register(f: Callable[[Inputs], DataFrame]):
        if name in TEXT_CHECKS:
            for table in TEXT_TABLES:
                REGISTRY[f"{table}_{name}"] = lambda spark, sf_dir, t=table: f(TextInputs(spark, sf_dir, t))
        REGISTRY[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        return f
    return register


def whole(name: str):
    """Register a query over the shared analysis."""
    def register(f: Callable[[Analysis], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: f(shared_analysis(spark, sf_dir))
        return f
    return register


def r6(c: str | Column) -> Column:
    """Rounded to compare; the small addend keeps exact ties from going either way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# -- corpus ----------------------------------------------------------------


@single("corpus_scan")
def _(i: Inputs):
    return i.files.select(
        "file_id", "path", "language", F.octet_length("content").alias("n_bytes"))


@single("skipped_files")
def _(i: Inputs):
    return corpus.skipped(i.raw_files, SMALL_FILE_BYTES)


def stored_tree(i: Inputs) -> str:
    """All files of the corpus, written as a directory tree below the shared folder."""
    root = f"{shared_folder(i.spark)}/tree-{uuid.uuid4().hex}"
    tree.write_files(i.raw_files, root)
    return root


@single("directory_scan")
def _(i: Inputs):
    return corpus.scan_directory(i.spark, stored_tree(i)).select(
        "path", "n_bytes", corpus.language_of().alias("language"), F.md5("content").alias("content_md5"))


@single("directory_lines")
def _(i: Inputs):
    """The same tree in chunks that are smaller than most files."""
    lines = corpus.scan_directory_lines(i.spark, stored_tree(i), chunk_bytes=CHUNK_BYTES)
    return lines.select("path", "n_lines", "line_no", F.md5("line").alias("line_md5"))


@single("directory_skipped")
def _(i: Inputs):
    return corpus.skipped_in_directory(i.spark, stored_tree(i), SMALL_FILE_BYTES).select("path", "n_bytes", "reason")


@single("walk_prune")
def _(i: Inputs):
    return i.raw_files.select("file_id", "path", corpus.is_pruned().alias("pruned"))


@single("language_tagging")
def _(i: Inputs):
    return i.raw_files.select("file_id", "path", corpus.language_of().alias("language"))


@single("size_filter")
def _(i: Inputs):
    return corpus.analysable(i.raw_files, max_bytes=SMALL_FILE_BYTES).select(
        "file_id", F.octet_length("content").alias("n_bytes"))


@single("file_cap")
def _(i: Inputs):
    return corpus.analysable(i.raw_files, max_files=WALK_FIRST).select("file_id", "path")


@single("line_count")
def _(i: Inputs):
    n_bytes = F.octet_length("content")
    return i.files.select(
        "file_id", line_count().alias("line_count"),
        corpus.estimated_lines(n_bytes).alias("est_lines"))


@single("line_explode")
def _(i: Inputs):
    return i.described.select(
        "file_id", "line_no", "trimmed", "byte_len", "trimmed_bytes", "indent", "is_blank",
        "is_comment")


@whole("json_report")
def _(a: Analysis):
    report = reports.json_report(a.file_report, a.issues)
    item = F.transform(
        "issues", lambda x: F.concat_ws(":", x["line"].cast("string"), x["type"], x["severity"]))
    return report.select(
        "path", r6("ai_probability").alias("ai_probability"), "complexity",
        F.coalesce(F.array_join(item, ";"), F.lit("")).alias("issues"))


@whole("json_document")
def _(a: Analysis):
    return reports.json_document(a.summary, a.file_report, a.issues)


@whole("markdown_report")
def _(a: Analysis):
    return reports.markdown_rows(a.summary, a.file_report, a.issues).select(
        "part", "severity", "path", "text")


@whole("markdown_document")
def _(a: Analysis):
    return reports.markdown_report(a.summary, a.file_report, a.issues, REPORT_ROOT)


@whole("report_source")
def _(a: Analysis):
    """A full dump, stored as JSON lines in the shared folder and read again from there."""
    spark = a.files.sparkSession
    folder = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    reports.write_dump(reports.full_dump(a.file_report, a.functions, a.issues), folder)
    return reports.read_dump(spark, folder).select(
        "path", "language", "line_count", r6("ai_probability").alias("ai_probability"),
        "complexity",
        F.coalesce(F.size("functions"), F.lit(0)).alias("n_functions"),
        F.coalesce(F.size("issues"), F.lit(0)).alias("n_issues"),
        F.col("git_info.commit_count").alias("commit_count"),
        r6("comment_ratio").alias("comment_ratio"))


@single("newest_commits")
def _(i: Inputs):
    return changes.newest_commits(i.change_log, fv.MAX_COMMITS).select("commit_id", "author", "path")


@single("newest_commits_of_roots")
def _(i: Inputs):
    """By the order of the log, not by time, of each repository."""
    return changes.newest_commits(i.ordered_log, NEWEST_OF_ROOT).select("root", "commit_id", "author", "path")


# -- predicates ------------------------------------------------------------


@single("comment_lines")
def _(i: Inputs):
    return i.lines.filter(text.is_comment()).select("file_id", "line_no")


@single("security_comment_lines")
def _(i: Inputs):
    return i.lines.filter(text.is_security_comment()).select("file_id", "line_no")


@single("comment_text")
def _(i: Inputs):
    return i.lines.filter(text.is_comment()).select(
        "file_id", "line_no", text.comment_text().alias("comment"))


@single("test_paths")
def _(i: Inputs):
    return i.raw_files.filter(text.is_test_path()).select("file_id", "path")


@single("definition_lines")
def _(i: Inputs):
    return i.lines.filter(text.is_definition_line(text.folded("line"))).select("file_id", "line_no")


@single("security_eligible_lines")
def _(i: Inputs):
    return security.eligible_lines(i.lines).select("file_id", "line_no")


@whole("category_filter")
def _(a: Analysis):
    return views.of_category(a.issues, fv.AI_PATTERN).select(*ISSUE_COLUMNS)


@single("relative_path")
def _(i: Inputs):
    full = F.concat(F.lit("/corpus/root/"), "path")
    return i.raw_files.select("file_id", corpus.relative_path(full, "/corpus/root").alias("path"))


# -- security --------------------------------------------------------------


@single("security_scan")
def _(i: Inputs):
    return security.scan(i.lines)


def _family(name: str, rules: tuple[fv.Rule, ...]) -> None:
    @single(name)
    def _(i: Inputs):
        return security.scan(i.lines, rules=rules).select(
            "file_id", "line_no", "type", "severity", "message", "rule_no")


_family("secret_rules", fv.SECRET_RULES)
_family("injection_rules", fv.INJECTION_RULES)
_family("crypto_rules", fv.CRYPTO_RULES)
_family("auth_rules", fv.AUTH_RULES)


@single("entropy_gate")
def _(i: Inputs):
    return security.secret_values(i.lines).select(
        "file_id", "line_no", "rule_no", "value", r6("entropy").alias("entropy"),
        (F.col("entropy") >= fv.MIN_SECRET_ENTROPY).alias("kept"))


@single("test_downgrade")
def _(i: Inputs):
    return security.scan(i.lines, path_aware=True, rules=fv.SECRET_RULES).select(
        "file_id", "path", "line_no", "severity", "rule_no")


# -- complexity ------------------------------------------------------------


@single("branch_counts")
def _(i: Inputs):
    return i.lines.select("file_id", "line_no", complexity.branch_count().alias("branches"))


@single("file_complexity")
def _(i: Inputs):
    return complexity.file_complexity(i.lines)


@single("function_starts")
def _(i: Inputs):
    return i.starts.select("file_id", "line_no", "name")


@single("function_segments")
def _(i: Inputs):
    return i.functions.select("file_id", "name", "start_line", "end_line")


@single("function_metrics")
def _(i: Inputs):
    return i.functions.select("file_id", "name", "start_line", "complexity", "line_count")


# -- quality ---------------------------------------------------------------


@single("complex_functions")
def _(i: Inputs):
    return quality.emit(i.functions, quality.function_complexity())


@single("long_functions")
def _(i: Inputs):
    return quality.emit(i.functions, quality.function_length())


@single("long_files")
def _(i: Inputs):
    return quality.long_files(i.files)


@single("deep_nesting")
def _(i: Inputs):
    return quality.deep_nesting(i.lines)


@single("long_parameter_lists")
def _(i: Inputs):
    return quality.emit(i.functions, quality.long_parameter_list())


@single("dead_code")
def _(i: Inputs):
    seen = quality.with_closure_flag(quality.with_following_lines(i.lines))
    return quality.emit(seen, quality.dead_code())


@single("closure_lines")
def _(i: Inputs):
    return quality.with_closure_flag(i.lines).filter("in_closure").select("file_id", "line_no")


@single("empty_error_handlers")
def _(i: Inputs):
    return quality.emit(quality.with_following_lines(i.lines), quality.empty_error_handler())


@single("error_swallowing")
def _(i: Inputs):
    return quality.emit(i.lines, quality.error_swallowing())


@single("magic_numbers")
def _(i: Inputs):
    return quality.magic_numbers(i.lines)


@single("naming_inconsistency")
def _(i: Inputs):
    return quality.naming_inconsistency(per_file(i.lines, quality.naming_stats()))


@single("unused_imports")
def _(i: Inputs):
    return quality.unused_imports(i.lines, i.files)


@single("todo_markers")
def _(i: Inputs):
    return quality.emit(i.lines, quality.todo_marker())


@single("code_duplication")
def _(i: Inputs):
    return quality.code_duplication(i.lines)


@whole("quality_scan")
def _(a: Analysis):
    return a.quality_issues


# -- signals ---------------------------------------------------------------


@single("token_diversity")
def _(i: Inputs):
    return ai.identifier_stats(i.files).select(
        "file_id", F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
        r6(ai.token_diversity()).alias("score"))


@single("identifier_tokens")
def _(i: Inputs):
    return ai.identifiers(i.files)


@single("naming_entropy")
def _(i: Inputs):
    return ai.identifier_stats(i.files).select(
        "file_id", F.col("n_snake").cast("long").alias("n_snake"),
        F.col("n_camel").cast("long").alias("n_camel"), ai.naming_entropy().alias("score"))


@single("generic_naming")
def _(i: Inputs):
    return ai.generic_naming(i.files)


def _line_signal(name: str, score: Callable[[], Column]) -> None:
    @single(name)
    def _(i: Inputs):
        return per_file(i.lines, ai.line_stats()).select("file_id", r6(score()).alias("score"))


_line_signal("formatting", ai.formatting)
_line_signal("comment_quality", ai.comment_quality)
_line_signal("structural_pattern", ai.structural_pattern)
_line_signal("line_length_dist", ai.line_length_dist)
_line_signal("comment_ratio", ai.comment_ratio)


@single("function_uniformity")
def _(i: Inputs):
    return ai.function_size_stats(i.functions).select(
        "file_id", "n_functions", ai.function_uniformity().alias("score"))


@single("marker_phrases")
def _(i: Inputs):
    return quality.emit(ai.comment_lines(i.lines), ai.marker_phrase())


@single("marker_phrase_score")
def _(i: Inputs):
    return per_file(i.lines, ai.comment_stats()).filter("n_comments > 0").select(
        "file_id", "n_comments", "n_markers", ai.marker_phrases().alias("score"))


@single("readme_comments")
def _(i: Inputs):
    return quality.emit(ai.comment_lines(i.lines), ai.readme_comment())


@single("readme_comment_score")
def _(i: Inputs):
    return per_file(i.lines, ai.comment_stats()).filter("n_comments > 0").select(
        "file_id", "n_comments", "n_readme", ai.readme_comments().alias("score"))


@single("error_boilerplate")
def _(i: Inputs):
    return ai.error_block_stats(i.lines).select(
        "file_id", "n_blocks", "n_top_block", ai.error_boilerplate().alias("score"))


def _repetition(name: str, score: Callable[[], Column]) -> None:
    @single(name)
    def _(i: Inputs):
        stats = per_file(i.lines, ai.line_stats()).join(
            ai.shape_stats(i.lines), "file_id", "left")
        return stats.select("file_id", r6(score()).alias("score"))


_repetition("repetitive_structure", ai.repetitive_structure)
_repetition("generic_repetition", ai.generic_repetition)


@whole("ai_signals")
def _(a: Analysis):
    return a.signals.select(
        "file_id", *[r6(s).alias(s) for s in fv.SIGNAL_WEIGHTS])


@whole("ai_score")
def _(a: Analysis):
    return a.signals.select("file_id", r6(ai.ai_score()).alias("ai_score"))


# -- joins -----------------------------------------------------------------


@single("file_churn_join")
def _(i: Inputs):
    joined = churn.apply_git_info(
        i.files.select("file_id", "path"), churn.git_info(i.change_log))
    git = F.col("git_info")
    return joined.select(
        "file_id", git["commit_count"].alias("commit_count"),
        git["last_author"].alias("last_author"), git["last_modified"].alias("last_modified"),
        F.array_join(git["authors"], ",").alias("authors"))


@whole("issue_snippets")
def _(a: Analysis):
    return a.security_findings.select("file_id", "line_no", "rule_no", "snippet")


@single("function_start_lines")
def _(i: Inputs):
    """Functions and the text of their first line, which the start rows already hold."""
    return i.starts.select("file_id", "line_no", "name", F.md5("line").alias("line_hash"))


@single("import_lookup")
def _(i: Inputs):
    return quality.go_imports(i.lines).select(
        "file_id", "line_no", "pkg", "name", F.col("body_from").cast("int").alias("body_from"))


@single("generic_name_lookup")
def _(i: Inputs):
    return ai.identifiers(i.files).filter(
        F.lower("token").isin(list(fv.GENERIC_NAMES))
    ).groupBy(F.lower("token").alias("name")).agg(F.count(F.lit(1)).alias("uses"))


# -- roll-ups --------------------------------------------------------------


@whole("file_report")
def _(a: Analysis):
    return a.file_report.select(
        "file_id", "path", "language", "line_count", r6("ai_score").alias("ai_score"),
        "complexity", r6("comment_ratio").alias("comment_ratio"), "issue_count",
        F.col("git_info.commit_count").alias("commit_count"))


@whole("project_summary")
def _(a: Analysis):
    return a.summary.withColumn("avg_complexity", r6("avg_complexity"))


@single("severity_counts")
def _(i: Inputs):
    return rollup.severity_counts(security.scan(i.lines))


@whole("ai_tiers")
def _(a: Analysis):
    return rollup.ai_tiers(a.file_report)


@single("uniform_sizes")
def _(i: Inputs):
    return rollup.uniform_sizes(i.functions)


@whole("quality_metrics")
def _(a: Analysis):
    return a.quality_metrics.withColumns(
        {c: r6(c) for c in ("avg_complexity", "avg_comment_percent")})


@whole("quality_grade")
def _(a: Analysis):
    return rollup.quality_grade(a.quality_metrics).select(r6("score").alias("score"), "grade")


@whole("issue_breakdown")
def _(a: Analysis):
    return rollup.issue_breakdown(a.quality_issues).withColumn("share", r6("share"))


@whole("gate_verdict")
def _(a: Analysis):
    return a.gate


@whole("directory_rollup")
def _(a: Analysis):
    return a.directories


def corrected(i: Inputs) -> Corrected:
    """The state after the whole history of the files has come in, as three batches."""
    state = Corrected(i.spark, f"{shared_folder(i.spark)}/feed-{uuid.uuid4().hex}")
    changes = derived.file_changes(i.spark, i.sf_dir)
    for arrival in range(3):
        state.apply(changes.filter(F.col("arrival") == arrival).drop("arrival"), arrival)
    return state


@single("corrected_directories")
def _(i: Inputs):
    return corrected(i).directories


@single("corrected_issues")
def _(i: Inputs):
    return corrected(i).issues.groupBy("file_id", "path", "category").agg(F.count("*").alias("issue_count"))


@single("file_churn")
def _(i: Inputs):
    return churn.churn(i.change_log)


@single("file_authors")
def _(i: Inputs):
    return churn.author_ranks(i.change_log)


@single("author_activity")
def _(i: Inputs):
    return churn.authors(i.change_log).select("path", "author", "commits", "newest_commit")


@single("file_churn_of_roots")
def _(i: Inputs):
    return churn.churn(i.ordered_log)


@single("file_authors_of_roots")
def _(i: Inputs):
    return churn.author_ranks(i.ordered_log)


@whole("issue_counts")
def _(a: Analysis):
    return rollup.issue_counts(a.issues)


# -- order -----------------------------------------------------------------


@single("tree_order")
def _(i: Inputs):
    return rollup.tree_listing(corpus.unpruned(i.raw_files))


@single("high_churn")
def _(i: Inputs):
    return churn.high_churn(i.change_log, TOP_CHURN)


@whole("issue_order")
def _(a: Analysis):
    return views.in_report_order(a.issues)


@whole("issues_by_severity")
def _(a: Analysis):
    return views.by_severity(a.issues).select(
        "path", "line_no", text.severity_name().alias("severity_name"),
        text.severity_label().alias("severity_label"),
        text.category_name().alias("category_name"), "type")


@whole("all_issues")
def _(a: Analysis):
    return a.issues


# -- views -----------------------------------------------------------------


@whole("security_view")
def _(a: Analysis):
    return views.security_view(a.security_findings)


@whole("ai_view")
def _(a: Analysis):
    uniform = rollup.uniform_sizes(a.functions)
    return views.ai_view(a.file_report, a.issues, uniform).select(
        "path", "tier", "score", "reason", "pass_no")


@whole("quality_view")
def _(a: Analysis):
    return views.quality_view(a.issues)
