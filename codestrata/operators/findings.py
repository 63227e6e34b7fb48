"""The shape of a finding, shared by all passes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import sql_string

#: Findings sort by pass, check, position within the check, and rule.
ORDER = ("pass_no", "check_no", "ord", "rule_no")
ISSUE_COLUMNS = (
    "file_id", "path", "line_no", "type", "severity", "category", "message", "fix", *ORDER,
)

AI_PASS, SECURITY_PASS, QUALITY_PASS = 1, 2, 3


def filled(template: str) -> str:
    """SQL for ``template`` with each ``{column}`` replaced by the column's value."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [sql_string(t) if n % 2 == 0 else t for n, t in enumerate(parts) if t or n % 2]
    return f"concat({', '.join(pieces)})" if len(parts) > 1 else sql_string(template)


def finding(
    *, type: str, severity: int, category: int, message: str, fix: str, pass_no: int,
    check_no: int, line_no: str = "line_no", ord: str | None = None, rule_no: str = "0",
    message_sql: str | None = None,
) -> Column:
    """A struct with all columns of a finding but the file, put together as SQL text.

    ``message`` and ``fix`` are templates, see ``filled``; ``message_sql`` replaces the
    former by an expression.
    """
    return F.expr(
        "named_struct("
        f"'line_no', cast({line_no} AS int), 'type', {sql_string(type)},"
        f" 'severity', {severity}, 'category', {category},"
        f" 'message', {message_sql or filled(message)}, 'fix', {filled(fix)},"
        f" 'pass_no', {pass_no}, 'check_no', {check_no},"
        f" 'ord', cast({ord or line_no} AS bigint), 'rule_no', cast({rule_no} AS int))"
    )


def emit(rows: DataFrame, *found: Column) -> DataFrame:
    """One row per finding that is not NULL, all ``found`` in one pass over ``rows``."""
    if len(found) == 1:
        hits = rows.select("file_id", "path", found[0].alias("f")).filter(F.col("f").isNotNull())
        return hits.select("file_id", "path", "f.*").select(*ISSUE_COLUMNS)
    return (
        rows.select("file_id", "path", F.inline_outer(F.array_compact(F.array(*found))))
        .filter(F.col("type").isNotNull())
        .select(*ISSUE_COLUMNS)
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
