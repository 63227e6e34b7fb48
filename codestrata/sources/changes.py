"""Change history: a table ``change_log(commit_id, author, authored_at, path[, seq][, root])``.

``root`` names the repository where a table holds several; commits and paths count by it.

The log order of commits is newest first: ``seq`` ascending where the table has it (times
may lie out of order after a rebase), else ``authored_at`` and then ``commit_id``, both
descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recency(change_log: DataFrame) -> Column:
    """Greater for commits nearer to the head of the log."""
    own = (-F.col("seq") if "seq" in change_log.columns else F.lit(0)).cast("long")
    return F.struct(own.alias("head"), "authored_at", "commit_id")


def roots(table: DataFrame) -> list[str]:
    """The key column of the repository, if ``table`` holds several."""
    return ["root"] if "root" in table.columns else []


def newest_commits(change_log: DataFrame, max_commits: int | None = None) -> DataFrame:
    """The rows of the newest commits (all without a limit): a top-k of commits, then a semi join.

    Commits are made distinct before the top-k; both steps work on partial
    results, so a commit with very many rows is no burden to one task. With roots the
    newest are those of each root; a root of very many commits is first ranked in slices.
    """
    if max_commits is None:
        return change_log
    key = [*roots(change_log), "commit_id"]
    commits = change_log.select(*key, recency(change_log).alias("recency")).distinct()
    if roots(change_log):
        slices = int(change_log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for part in (["root", F.pmod(F.xxhash64("commit_id"), F.lit(slices))], ["root"]):
            newest_first = Window.partitionBy(*part).orderBy(F.desc("recency"))
            commits = commits.withColumn("place", F.row_number().over(newest_first)).filter(F.col("place") <= max_commits)
    else:
        commits = commits.orderBy(F.desc("recency")).limit(max_commits)
    return change_log.join(commits.select(*key), key, "left_semi").select(change_log.columns)
