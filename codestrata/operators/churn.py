"""Change history per file; where a log has ``root``, every table has it too, as part of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.sources.changes import newest_commits, recency, roots


def authors(change_log: DataFrame) -> DataFrame:
    """``(path, author, commits, newest_at, newest_commit, latest_at, head)``, a row per author of a path.

    ``newest`` is by the log, ``latest_at`` by time; ``head`` orders authors by the log.

    The partial aggregation takes the load of paths that very many commits touch.
    """
    newest = F.max(recency(change_log))
    return (
        change_log.groupBy(*roots(change_log), "path", "author")
        .agg(F.count(F.lit(1)).alias("commits"), newest.alias("newest"),
             F.max("authored_at").alias("latest_at"))
        .select(
            *roots(change_log), "path", "author", "commits",
            F.col("newest.authored_at").alias("newest_at"),
            F.col("newest.commit_id").alias("newest_commit"),
            "latest_at", F.col("newest.head").alias("head"),
        )
    )


def churn(change_log: DataFrame) -> DataFrame:
    """``(path, commit_count, author_count, last_author, last_modified)`` of any history."""
    last = F.max(F.struct("head", "newest_at", "newest_commit", "author"))
    return (
        authors(change_log)
        .groupBy(*roots(change_log), "path")
        .agg(
            F.sum("commits").cast("int").alias("commit_count"),
            F.count(F.lit(1)).cast("int").alias("author_count"),
            last.alias("last"), F.max("latest_at").alias("latest_at"),
        )
        .select(
            *roots(change_log), "path", "commit_count", "author_count",
            F.col("last.author").alias("last_author"),
            F.date_format("latest_at", "yyyy-MM-dd").alias("last_modified"),
        )
    )


def author_ranks(change_log: DataFrame, max_commits: int | None = None) -> DataFrame:
    """``(path, author_no, author)``: the authors of a path, newest first, of all or the newest commits.

    Ranked are distinct authors, so hot paths weigh no more than others of as many authors;
    ``authors`` holds the same order as ``newest_at`` and ``newest_commit`` without ranks.
    """
    newest_first = Window.partitionBy(*roots(change_log), "path").orderBy(
        F.desc("head"), F.desc("newest_at"), F.desc("newest_commit"))
    return authors(newest_commits(change_log, max_commits)).select(
        *roots(change_log), "path", F.row_number().over(newest_first).alias("author_no"), "author")


def git_info(change_log: DataFrame, max_commits: int | None = None) -> DataFrame:
    """``(path, git_info)`` of all or the newest commits, with the authors as one list.

    A list holds each person once who ever touched the path; ``churn`` and ``authors`` have
    the same as rows.
    """
    newest_first = F.reverse(
        F.array_sort(F.collect_list(F.struct("head", "newest_at", "newest_commit", "author", "latest_at"))))
    return (
        authors(newest_commits(change_log, max_commits))
        .groupBy(*roots(change_log), "path")
        .agg(F.sum("commits").cast("int").alias("commit_count"), newest_first.alias("a"))
        .select(
            *roots(change_log), "path",
            F.struct(
                "commit_count",
                F.col("a")[0]["author"].alias("last_author"),
                F.date_format(F.array_max("a.latest_at"), "yyyy-MM-dd").alias("last_modified"),
                F.col("a.author").alias("authors"),
            ).alias("git_info"),
        )
    )


def apply_git_info(files: DataFrame, info: DataFrame) -> DataFrame:
    """Files with their ``git_info``; NULL for files without history."""
    return files.join(info, [*roots(info), "path"], "left")


def high_churn(change_log: DataFrame, limit: int) -> DataFrame:
    """The paths touched by most commits; equal counts in the order of the paths."""
    return (
        change_log.groupBy(*roots(change_log), "path")
        .agg(F.count(F.lit(1)).alias("commit_count"))
        .orderBy(F.desc("commit_count"), *roots(change_log), "path")
        .limit(limit)
    )
