"""A whole analysis: files to lines, functions, findings, scores and roll-ups."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import ai, churn, one_pass, rollup
from codestrata.operators.findings import union_all
from codestrata.sources import corpus
from codestrata.sources.changes import roots
from codestrata.sources.lines import explode_lines


class Analysis:
    """All tables of one analysis, declared lazily but for the facts.

    ``files`` holds ``(file_id, path, content)`` and, for several repositories, ``root``.  One pass over
    the selected files, each at the partition of its ``file_id``, gives the ``facts``, a few rows
    a file, from which all tables follow.  With ``keep`` (the default) the facts are persisted, by a
    job of their own as soon as a table asks for them; contents and lines never are.  Lost blocks are
    computed again from the source.  Call ``release`` when done.  Without ``keep`` every table makes the pass anew; that suits single tables.
    """

    def __init__(
        self,
        files: DataFrame,
        change_log: DataFrame | None = None,
        *,
        co_located: bool = False,
        keep: bool = True,
        path_aware: bool = False,
        max_bytes: int | None = None,
        max_files: int | None = None,
        max_commits: int | None = None,
    ):
        selected = corpus.analysable(files, max_bytes, max_files)
        if not co_located or max_files is not None:
            selected = corpus.co_locate(selected)
        self._keep = keep
        self._kept: list[DataFrame] = []
        self.files = selected
        self._path_aware = path_aware
        self._change_log = change_log
        self._max_commits = max_commits

    def _kept_if_wanted(self, table: DataFrame) -> DataFrame:
        if self._keep:
            table.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(table)
            # a plan that reads an empty store several times starts as many jobs over it at once, and executors
            # that do not have a partition yet may compute it again
            table.count()
        return table

    def release(self) -> None:
        for table in self._kept:
            table.unpersist()

    @cached_property
    def lines(self) -> DataFrame:
        return explode_lines(self.files)

    @cached_property
    def facts(self) -> DataFrame:
        return self._kept_if_wanted(one_pass.facts(self.files))

    @cached_property
    def functions(self) -> DataFrame:
        return one_pass.functions(self.facts)

    @cached_property
    def file_stats(self) -> DataFrame:
        """All figures of a file, a row per file."""
        return one_pass.file_stats(self.facts)

    @cached_property
    def security_findings(self) -> DataFrame:
        """The findings of the rules with their snippets."""
        return one_pass.security_issues(self.facts, self._path_aware)

    @cached_property
    def security_issues(self) -> DataFrame:
        return self.security_findings.drop("snippet")

    @cached_property
    def ai_issues(self) -> DataFrame:
        return one_pass.ai_issues(self.facts)

    @cached_property
    def quality_issues(self) -> DataFrame:
        return one_pass.quality_issues(self.facts)

    @cached_property
    def issues(self) -> DataFrame:
        """The findings of all passes (a bag)."""
        return union_all([self.ai_issues, self.security_issues, self.quality_issues])

    @cached_property
    def signals(self) -> DataFrame:
        return ai.signals(self.file_stats, "complexity", *roots(self.files))

    @cached_property
    def git_info(self) -> DataFrame | None:
        if self._change_log is None:
            return None
        return churn.git_info(self._change_log, self._max_commits)

    @cached_property
    def file_report(self) -> DataFrame:
        """A row per file with its score, complexity and counts of findings."""
        scored = self.signals.select(
            "file_id", *roots(self.files), "path", "language", F.col("n_lines").alias("line_count"),
            ai.ai_score().alias("ai_score"), "comment_ratio", "n_functions", "complexity",
        )
        counts = rollup.issues_per_file(self.issues)
        report = (
            scored.join(counts, "file_id", "left")
            .fillna(0, ["issue_count", "security_issues", "quality_issues", "ai_issues"])
        )
        if self.git_info is None:
            return report
        return churn.apply_git_info(report, self.git_info)

    @cached_property
    def summary(self) -> DataFrame:
        return rollup.summary(self.file_report)

    @cached_property
    def file_counts(self) -> DataFrame:
        """A row per file with its lines, complexity and counts of findings; no signals."""
        counts = rollup.issues_per_file(self.issues)
        return (
            self.file_stats.select(
                "file_id", *roots(self.files), "path", F.col("n_lines").alias("line_count"), "complexity")
            .join(counts, "file_id", "left")
            .fillna(0, ["issue_count", "security_issues", "quality_issues", "ai_issues"])
        )

    @cached_property
    def gate(self) -> DataFrame:
        return rollup.gate(rollup.totals(self.file_counts))

    @cached_property
    def directories(self) -> DataFrame:
        return rollup.directory_rollup(self.file_counts)

    @cached_property
    def quality_metrics(self) -> DataFrame:
        return rollup.quality_metrics(self.file_report, self.issues)
