"""Branch counts, function boundaries and cyclomatic complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.functions.linear import FUNCTION_FORMS
from codestrata.functions.regex import to_java
from codestrata.functions.text import sql_string
from codestrata.sources.lines import LineStats, per_file, so_far


def branch_count(trimmed: str = "trimmed", language: str = "language") -> Column:
    """Keywords of the language that the line holds, and its ``&&`` and ``||``.

    A keyword counts once per line, wherever it stands.
    """
    fallback = fv.BRANCH_KEYWORDS[fv.FALLBACK_KEYWORD_LANGUAGE]
    by_keywords: dict[tuple[str, ...], list[str]] = {}
    for name, keywords in fv.BRANCH_KEYWORDS.items():
        if keywords != fallback:
            by_keywords.setdefault(keywords, []).append(name)

    def listed(words) -> str:
        return ", ".join(sql_string(w) for w in words)

    cases = " ".join(
        f"WHEN {language} IN ({listed(names)}) THEN array({listed(words)})"
        for words, names in by_keywords.items())
    own = f"CASE {cases} ELSE array({listed(fallback)}) END"
    present = F.expr(f"size(filter({own}, k -> contains({trimmed}, k)))")
    return present + reduce(
        Column.__add__, [text.count_of(trimmed, op) for op in fv.LOGICAL_OPERATORS])


def function_name(trimmed: str = "trimmed", language: str = "language") -> Column:
    """The name of the function that starts on the line, NULL if none does."""
    by_pattern: dict[tuple, list[str]] = {}
    for name, spec in fv.FUNCTION_PATTERNS.items():
        by_pattern.setdefault(spec, []).append(name)
    cases = []
    for (pattern, groups), names in by_pattern.items():
        forms = FUNCTION_FORMS.get(pattern, [(pattern, g) for g in groups])
        found = ", ".join(
            f"nullif(regexp_extract({trimmed}, {sql_string(to_java(form))}, {g}), '')" for form, g in forms)
        hit = f"{language} IN ({', '.join(sql_string(n) for n in names)})"
        if pattern.endswith(r"\("):
            hit += f" AND contains({trimmed}, '(')"  # spares long lines the backtracking
        cases.append(f"WHEN {hit} THEN coalesce({found})")
    # inside a lambda the long CASE is interpreted, not part of one huge generated method
    case = f"CASE {' '.join(cases)} END"
    return F.expr(f"get(transform(array(0), one -> {case}), 0)")


def brace_change(c: str) -> Column:
    return text.count_of(c, "{") - text.count_of(c, "}")


def branch_stats() -> LineStats:
    return LineStats(
        {"branches": branch_count()},
        {"complexity": (F.sum("branches") + 1).cast("int")},
    )


def file_complexity(lines: DataFrame) -> DataFrame:
    """``(file_id, path, complexity)``: one plus all branches."""
    return per_file(lines, branch_stats()).select("file_id", "path", "complexity")


def parameter_count(line: str = "line") -> Column:
    """Filled parts between commas in the first parentheses of the line."""
    parts = F.split(text.group(line, fv.PARAMETER_LIST_PATTERN, 1), ",", -1)
    return F.size(F.filter(parts, lambda p: text.strip(p) != ""))


def function_starts(lines: DataFrame) -> DataFrame:
    """Lines on which a function starts, with its name."""
    return (
        lines.filter(F.col("language").isin(list(fv.FUNCTION_PATTERNS)))
        .select("file_id", "path", "line_no", "line", function_name().alias("name"))
        .filter(F.col("name").isNotNull())
    )


def functions(lines: DataFrame) -> DataFrame:
    """``(file_id, path, name, start_line, end_line, complexity, line_count, n_params)``.

    A function runs to the line before the next start, or to the end of the file;
    Python and Ruby functions already end before the first unindented line, Lua
    functions at ``end``, once the braces opened since the start are closed.  The
    closing line's branches belong to the function, later ones to none.

    Only flags and counts go through the windows, never the text.
    """
    per_line = lines.filter(F.col("language").isin(list(fv.FUNCTION_PATTERNS))).select(
        "file_id", "path", "language", "line_no", "line",
        function_name().alias("started"),
        brace_change("trimmed").alias("braces"),
        branch_count().alias("branches"),
        F.when(
            F.col("language").isin("Python", "Ruby"),
            ~text.is_blank() & ~text.starts_with_any("line", (" ", "\t")),
        ).otherwise((F.col("language") == "Lua") & (F.col("trimmed") == "end")).alias("may_close"),
    )
    starts = F.col("started").isNotNull()
    running = per_line.withColumn("n_params", F.when(starts, parameter_count())).drop("line").select(
        "*",
        F.sum("braces").over(so_far()).alias("depth"),
        F.sum("branches").over(so_far()).alias("branches_so_far"),
        F.max(F.when(starts, F.col("line_no"))).over(so_far()).alias("start_line"),
        F.last("started", ignorenulls=True).over(so_far()).alias("name"),
    ).withColumn(
        "depth_before",
        F.last(F.when(starts, F.col("depth") - F.col("braces")), ignorenulls=True).over(so_far()),
    )
    first_line_to_close = F.col("start_line") + F.when(F.col("language") == "Lua", 1).otherwise(2)
    closes = (
        F.col("may_close")
        & (F.col("depth") <= F.col("depth_before"))
        & (F.col("line_no") >= first_line_to_close)
    )
    inside = running.filter(F.col("start_line").isNotNull())
    measured = inside.groupBy("file_id", "path", "language", "start_line", "name").agg(
        F.min(F.when(closes, F.col("line_no"))).alias("close_line"),
        F.min(F.when(closes, F.col("branches_so_far"))).alias("branches_at_close"),
        F.max("line_no").alias("last_line"),
        F.max("branches_so_far").alias("branches_at_last"),
        F.min(F.when(starts, F.col("branches_so_far") - F.col("branches"))).alias("branches_before"),
        F.max("n_params").alias("n_params"),
    )
    before_close = F.when(F.col("language") == "Lua", 0).otherwise(1)
    end_line = F.coalesce(F.col("close_line") - before_close, F.col("last_line"))
    counted = F.coalesce("branches_at_close", "branches_at_last") - F.col("branches_before")
    return measured.select(
        "file_id", "path", "name",
        F.col("start_line").cast("int").alias("start_line"),
        end_line.cast("int").alias("end_line"),
        (counted + 1).cast("int").alias("complexity"),
        (end_line - F.col("start_line") + 1).cast("int").alias("line_count"),
        "n_params",
    )
