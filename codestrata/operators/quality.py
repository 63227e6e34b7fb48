"""Quality checks: size, nesting, dead code, error handling, naming, imports, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.operators.complexity import brace_change
from codestrata.operators.findings import QUALITY_PASS, emit, finding, union_all
from codestrata.sources.lines import (
    LineStats, earlier, in_file, line_count, next_non_null, so_far,
)

(
    COMPLEXITY, LENGTH, LONG_FILE, NESTING, PARAMETERS, DEAD_CODE, EMPTY_HANDLER,
    SWALLOWING, MAGIC, NAMING, IMPORTS, TODO, DUPLICATION,
) = range(1, 14)


def _quality(type: str, severity: int, message: str, fix: str, check_no: int, **more) -> Column:
    return finding(
        type=type, severity=severity, category=fv.QUALITY, message=message, fix=fix,
        pass_no=QUALITY_PASS, check_no=check_no, **more,
    )


# -- functions -------------------------------------------------------------


def function_complexity() -> Column:
    def found(type, severity, word, threshold, fix):
        message = (
            "Function '{name}' has cyclomatic complexity {complexity}"
            f" ({word} threshold: {threshold})")
        return _quality(type, severity, message, fix, COMPLEXITY, line_no="start_line")

    return F.when(
        F.col("complexity") >= fv.COMPLEXITY_CRITICAL,
        found("high_complexity", fv.ERROR, "critical", fv.COMPLEXITY_CRITICAL,
              "Break this function into smaller, focused functions. Extract conditional logic into helper functions."),
    ).when(
        F.col("complexity") >= fv.COMPLEXITY_WARNING,
        found("moderate_complexity", fv.WARNING, "warning", fv.COMPLEXITY_WARNING,
              "Consider refactoring — extract branches into helper functions or use early returns."),
    )


def function_length() -> Column:
    god = _quality(
        "god_function", fv.ERROR,
        "God function '{name}' — {line_count} lines with complexity {complexity}",
        "This function does too much. Split into focused functions with single responsibilities.",
        LENGTH, line_no="start_line",
    )
    long = _quality(
        "long_function", fv.WARNING,
        f"Function '{{name}}' is {{line_count}} lines (recommended max: {fv.MAX_FUNCTION_LINES})",
        "Break into smaller functions. Functions should ideally fit on one screen.",
        LENGTH, line_no="start_line",
    )
    is_god = (F.col("line_count") > fv.GOD_FUNCTION_LINES) & (
        F.col("complexity") > fv.GOD_FUNCTION_COMPLEXITY)
    return F.when(is_god, god).when(F.col("line_count") > fv.MAX_FUNCTION_LINES, long)


def long_parameter_list() -> Column:
    return F.when(
        F.col("n_params") > fv.MAX_PARAMETERS,
        _quality(
            "long_param_list", fv.WARNING,
            f"Function '{{name}}' has {{n_params}} parameters (max recommended: {fv.MAX_PARAMETERS})",
            "Group related parameters into a struct/object. Consider using options pattern or builder.",
            PARAMETERS, line_no="start_line",
        ),
    )


def function_findings(functions: DataFrame) -> DataFrame:
    return emit(functions, function_complexity(), function_length(), long_parameter_list())


# -- files and lines -------------------------------------------------------


def long_file() -> Column:
    return F.when(
        F.col("n_lines") > fv.MAX_FILE_LINES,
        _quality(
            "long_file", fv.INFO,
            f"File is {{n_lines}} lines (recommended max: {fv.MAX_FILE_LINES})",
            "Split into multiple files by responsibility. Group related functions together.",
            LONG_FILE, line_no="1",
        ),
    )


def long_files(files: DataFrame) -> DataFrame:
    return emit(files.select("file_id", "path", line_count().alias("n_lines")), long_file())


def nesting_level() -> Column:
    return F.floor(text.indent("line") / 4).cast("int")


def deep_nesting(lines: DataFrame) -> DataFrame:
    """The first line of each level that is too deep."""
    first = (
        lines.select("file_id", "path", "line_no", nesting_level().alias("level"))
        .filter(F.col("level") > fv.MAX_NESTING)
        .groupBy("file_id", "path", "level")
        .agg(F.min("line_no").alias("line_no"))
    )
    return emit(first, nested_too_deep())


def nested_too_deep() -> Column:
    return _quality(
        "deep_nesting", fv.WARNING,
        f"Code nested {{level}} levels deep (max recommended: {fv.MAX_NESTING})",
        "Use early returns (guard clauses) to reduce nesting. Extract nested logic into helper functions.",
        NESTING,
    )


def with_following_lines(lines: DataFrame) -> DataFrame:
    """Add what a check of a line must know of the lines after it."""
    return lines.withColumns(
        {
            "filled": F.when(~text.is_blank(), F.col("trimmed")),
            "filled_no": F.when(~text.is_blank(), F.col("line_no")),
        }
    ).withColumns(
        {
            "next_trimmed": F.lead("trimmed").over(in_file()),
            "next_filled": next_non_null("filled"),
            "next_filled_no": next_non_null("filled_no"),
        }
    )


def opens_closure() -> Column:
    plain = (
        F.col("trimmed").startswith("func ")
        & ~F.col("trimmed").contains("= func(")
        & ~F.col("trimmed").contains("(func(")
    )
    return F.col("line").contains("func") & text.matches("line", fv.CLOSURE_PATTERN) & ~plain


def with_closure_flag(lines: DataFrame) -> DataFrame:
    """Add ``in_closure``: some ``func (`` at or above the line is not closed again.

    Going back from line i to line k the net number of closing braces is
    S(i) - S(k-1) with S their running sum; so an open closure exists exactly if the
    largest S(k-1) of the candidates so far reaches S(i).
    """
    return (
        lines.withColumns({"closing": -brace_change("line"), "opens_closure": opens_closure()})
        .withColumn("closed", F.sum("closing").over(so_far()))
        .withColumn(
            "in_closure",
            F.coalesce(
                F.max(F.when(F.col("opens_closure"), F.col("closed") - F.col("closing")))
                .over(so_far()) >= F.col("closed"),
                F.lit(False),
            ),
        )
    )


def is_jump() -> Column:
    return text.matches("trimmed", fv.JUMP_PATTERN)


def dead_code() -> Column:
    """Needs the columns of ``with_following_lines`` and ``with_closure_flag``."""
    return F.when(
        F.col("next_filled").isNotNull() & ~F.col("in_closure") & ~may_follow_jump("next_filled") & is_jump(),
        unreachable(),
    )


def may_follow_jump(trimmed: str) -> Column:
    return (
        F.col(trimmed).isin(list(fv.LONE_CLOSERS))
        | F.col(trimmed).startswith("case ")
        | F.col(trimmed).startswith("default:")
    )


def unreachable() -> Column:
    return _quality(
        "dead_code", fv.WARNING, "Unreachable code after {trimmed}",
        "Remove this unreachable code or restructure the control flow.",
        DEAD_CODE, line_no="next_filled_no", ord="line_no",
    )


#: The kinds of error handlers and what a line that opens one looks like; the first that fits counts.
HANDLERS = {
    "catch block": "contains(trimmed, 'catch') AND endswith(trimmed, '{')",
    "except block": "contains(trimmed, 'except') AND endswith(trimmed, ':')",
    "error handler": "language = 'Go' AND contains(trimmed, 'if err != nil') AND endswith(trimmed, '{')",
}


def handler_kind() -> str:
    """SQL for the number of the kind of handler that the line opens, NULL if none."""
    return "CASE " + " ".join(f"WHEN {test} THEN {n}" for n, test in enumerate(HANDLERS.values(), start=1)) + " END"


def empty_error_handler() -> Column:
    """Needs the columns of ``with_following_lines``; the last line is never one."""
    empty = (
        f"get(transform(array({handler_kind()}), k -> CASE"
        " WHEN k = 2 THEN IF(next_trimmed IN ('pass', ''), k, NULL)"
        " WHEN k IN (1, 3) THEN IF(next_filled = '}', k, NULL) END), 0)"
    )
    return F.when(F.expr(f"next_trimmed IS NOT NULL AND ({empty}) IS NOT NULL"), swallows_silently(empty))


def swallows_silently(kind: str) -> Column:
    """The finding of an empty handler; ``kind`` is SQL for its number."""
    names = ", ".join(text.sql_string(k) for k in HANDLERS)
    return _quality(
        "empty_error_handler", fv.ERROR, "",
        "At minimum, log the error. Consider returning it or wrapping with context.",
        EMPTY_HANDLER,
        message_sql=f"concat('Empty ', get(array({names}), cast({kind} AS int) - 1), ' — errors silently swallowed')",
    )


def error_swallowing() -> Column:
    return F.when(discards(), discarded())


def discards() -> Column:
    line = F.col("line")
    return (
        (F.col("language") == "Go") & line.contains("_") & line.contains("=")
        & text.matches("line", fv.SWALLOW_PATTERN)
        & ~text.matches("line", fv.SWALLOW_ALLOWED_PATTERN)
    )


def discarded() -> Column:
    return _quality(
        "error_swallowing", fv.WARNING,
        "Return value discarded with _ — possible error swallowing",
        "Handle the error: check it, wrap it, or explicitly document why it's safe to ignore.",
        SWALLOWING,
    )


TODO_WORDS = ("todo", "fixme", "hack", "xxx", "bug")


def todo_text() -> str:
    """SQL for what a line with a marker says."""
    java = text.sql_string(text.to_java(fv.TODO_PATTERN))
    rest = f"btrim(regexp_extract(line, {java}, 2), {text.sql_string(text.WHITE_SPACE)})"
    return f"concat(upper(regexp_extract(line, {java}, 1)), ': ', {rest})"


def to_do(message_sql: str) -> Column:
    return _quality(
        "todo_marker", fv.INFO, "", "Resolve this TODO before merging to main branch.", TODO,
        message_sql=message_sql)


def todo_marker() -> Column:
    return F.when(
        text.let(text.folded("line"), lambda low: text.holds_any(low, TODO_WORDS))
        & text.matches("line", fv.TODO_PATTERN),
        to_do(todo_text()),
    )


def holds_no_magic_number() -> Column:
    """Lines whose numbers are never magic."""
    ticks = text.count_of("line", "`")
    return (
        text.matches("trimmed", fv.CONSTANT_LINE_PATTERN)
        | text.starts_with_any("trimmed", ("//", "#", "import"))
        | (F.col("line").contains("#") & text.matches("line", fv.HEX_COLOUR_PATTERN))
        | ((ticks > 0) & (ticks % 2 == 0))
    )


def magic_number_tokens(lines: DataFrame) -> DataFrame:
    """``(file_id, path, line_no, pos, token)`` for every number that may be magic."""
    return (
        lines.filter(~holds_no_magic_number())
        .select(
            "file_id", "path", "line_no",
            F.posexplode_outer(text.all_matches("line", fv.MAGIC_NUMBER_PATTERN, 1))
            .alias("pos", "token"),
        )
        .filter(F.col("token").isNotNull() & ~F.col("token").isin(list(fv.ALLOWED_NUMBERS)))
    )


def magic_numbers(lines: DataFrame) -> DataFrame:
    """The first use of each number in a file."""
    first = (
        magic_number_tokens(lines)
        .groupBy("file_id", "path", "token")
        .agg(F.min(F.struct("line_no", "pos")).alias("at"))
        .select("file_id", "path", "token", "at.line_no", "at.pos")
    )
    return emit(first, magic_number())


def magic_number() -> Column:
    return _quality(
        "magic_number", fv.INFO,
        "Magic number {token} — consider defining as a named constant",
        "Extract to a named constant for readability: const someName = {token}",
        MAGIC, rule_no="pos",
    )


def naming_stats() -> LineStats:
    """camelCase and snake_case names per file and the first line of either."""
    checked = ~F.col("language").isin(list(fv.MIXED_NAMING_LANGUAGES))
    camel = F.size(text.all_matches("line", fv.CAMEL_PATTERN))
    snake = F.when(
        F.col("line").contains("_"), F.size(text.all_matches("line", fv.SNAKE_PATTERN))
    ).otherwise(0)
    mixed = F.col("line").contains("_") & text.matches("line", fv.SNAKE_SEARCH_PATTERN)
    return LineStats(
        {
            "camel": F.when(checked, camel),
            "snake": F.when(checked, snake),
            "mixed_snake": checked & mixed,
        },
        {
            "n_camel_names": F.sum("camel"),
            "n_snake_names": F.sum("snake"),
            "first_camel": F.min(F.when(F.col("camel") > 0, F.col("line_no"))),
            "first_snake": F.min(F.when(F.col("mixed_snake"), F.col("line_no"))),
        },
    )


def naming_columns() -> dict[str, Column]:
    """What a finding of mixed names needs, from the ``naming_stats``; ``naming_line`` is NULL without one."""
    camel, snake = F.col("n_camel_names"), F.col("n_snake_names")
    total, snake_minor = camel + snake, snake < camel
    mixed = (total >= fv.MIN_NAMES) & (F.least(camel, snake) / total > fv.MAX_MINORITY_SHARE)
    first = F.when(snake_minor, F.col("first_snake")).otherwise(F.col("first_camel"))
    return {"snake_minor": snake_minor, "naming_line": F.when(mixed, first)}


def mixed_names() -> Column:
    styles = "if(snake_minor, '{0}', '{1}')"
    message = (
        "concat('Mixed naming conventions — file uses mostly ',"
        f" {styles.format('camelCase', 'snake_case')}, ' but also contains ',"
        f" {styles.format('snake_case', 'camelCase')})")
    return F.when(
        F.col("naming_line").isNotNull(),
        _quality("naming_inconsistency", fv.INFO, "",
                 "Pick one convention and use it consistently throughout the file.", NAMING,
                 line_no="naming_line", message_sql=message),
    )


def naming_inconsistency(stats: DataFrame) -> DataFrame:
    """From a ``per_file`` table with the ``naming_stats``."""
    return emit(stats.select("file_id", "path", *[c.alias(k) for k, c in naming_columns().items()]), mixed_names())


def go_imports(lines: DataFrame) -> DataFrame:
    """Imports of Go files with the first line that counts as their body."""
    t = F.col("trimmed")
    event = F.when(t == "import (", F.col("line_no")).when(t == ")", 0)
    staged = (
        lines.filter(F.col("language") == "Go")
        .select("file_id", "path", "line_no", "line", "trimmed", event.alias("event"))
        .withColumn("block", F.last("event", ignorenulls=True).over(earlier()))
        .filter(F.col("event").isNull() & F.col("line").contains('"'))
    )
    single = t.startswith('import "')
    single_pkg = text.group("trimmed", fv.SINGLE_IMPORT_PATTERN, 1)
    alias = text.group("line", fv.IMPORT_ALIAS_PATTERN, 1)
    pkg = F.when(single, single_pkg).when(
        F.col("block") > 0,
        F.when(alias != "", text.group("line", fv.IMPORT_ALIAS_PATTERN, 2))
        .otherwise(text.group("line", fv.IMPORT_PATTERN, 1)),
    )
    body_from = F.when(single, F.col("line_no") + 1).otherwise(
        F.col("block") + fv.IMPORT_BODY_OFFSET)
    last_part = F.substring_index("pkg", "/", -1)
    return (
        staged.select(
            "file_id", "path", "line_no", single.alias("single"), alias.alias("alias"),
            pkg.alias("pkg"), body_from.alias("body_from"),
        )
        .filter(F.col("pkg").isNotNull() & (F.col("pkg") != ""))
        .withColumn(
            "name", F.when(F.col("single") | (F.col("alias") == ""), last_part)
            .otherwise(F.col("alias")))
        .filter(
            F.when(F.col("single"), ~F.col("name").startswith("_"))
            .otherwise(~F.col("name").isin("_", "."))
        )
        .select("file_id", "path", "line_no", "pkg", "name", "body_from")
    )


def unused_imports(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Go imports whose ``name.`` is nowhere in the body of their file.

    The imports of a file (few, and bounded by its size) meet its text once: no
    pairs of imports and lines.
    """
    grouped = (
        go_imports(lines)
        .groupBy("file_id")
        .agg(F.collect_list(F.struct("line_no", "pkg", "name", "body_from")).alias("imports"))
    )
    unused = F.expr(
        "filter(imports, i -> locate(concat(i.name, '.'), content,"
        " length(substring_index(content, '\\n', i.body_from - 1)) + 2) = 0)"
    )
    found = (
        files.filter(F.col("language") == "Go")
        .select("file_id", "path", "content")
        .join(grouped, "file_id")
        .select("file_id", "path", F.inline_outer(unused))
        .filter(F.col("pkg").isNotNull())
    )
    return emit(found, unused_import())


def unused_imports_of() -> str:
    """SQL for the unused imports of ``content`` as an array of (line_no, pkg), in one pass over its lines.

    Only lines with a quote or at the edge of an import block are looked at; the state is the line of
    the open block (0 after its end) and the imports so far.
    """
    q, java = text.sql_string, lambda pattern: text.sql_string(text.to_java(pattern))
    lines = (
        f"filter(transform(split(content, '\\n', -1), (x, i) -> named_struct('no', i + 1, 'line', x, 'trimmed', btrim(x, {q(text.WHITE_SPACE)}))),"
        " e -> contains(e.line, '\"') OR e.trimmed IN ('import (', ')'))")
    alias = f"regexp_extract(e.line, {java(fv.IMPORT_ALIAS_PATTERN)}, 1)"
    single = "startswith(e.trimmed, 'import \"')"
    pkg = (
        f"CASE WHEN {single} THEN regexp_extract(e.trimmed, {java(fv.SINGLE_IMPORT_PATTERN)}, 1)"
        f" WHEN {alias} <> '' THEN regexp_extract(e.line, {java(fv.IMPORT_ALIAS_PATTERN)}, 2)"
        f" ELSE regexp_extract(e.line, {java(fv.IMPORT_PATTERN)}, 1) END")
    name = f"CASE WHEN {single} OR {alias} = '' THEN substring_index(p, '/', -1) ELSE {alias} END"
    body = f"IF({single}, e.no + 1, s.block + {fv.IMPORT_BODY_OFFSET})"
    item = (
        f"get(transform(array({pkg}), p -> IF(p <> '' AND IF({single}, NOT startswith({name}, '_'), ({name}) NOT IN ('_', '.')),"
        f" named_struct('line_no', e.no, 'pkg', p, 'name', {name}, 'body_from', {body}), NULL)), 0)")
    step = (
        "CASE WHEN e.trimmed = 'import (' THEN named_struct('block', e.no, 'found', s.found)"
        " WHEN e.trimmed = ')' THEN named_struct('block', 0, 'found', s.found)"
        f" WHEN {single} OR s.block > 0 THEN get(transform(array({item}), c -> IF(c IS NULL, s,"
        " named_struct('block', s.block, 'found', array_append(s.found, c)))), 0) ELSE s END")
    none = "array()"
    start = f"named_struct('block', 0, 'found', cast({none} AS array<struct<line_no:int,pkg:string,name:string,body_from:int>>))"
    unused = (
        f"filter(aggregate({lines}, {start}, (s, e) -> {step}, s -> s.found), i -> locate(concat(i.name, '.'), content,"
        " length(substring_index(content, '\\n', i.body_from - 1)) + 2) = 0)")
    return f"CASE WHEN language = 'Go' AND contains(content, 'import') THEN transform({unused}, i -> named_struct('line_no', i.line_no, 'pkg', i.pkg)) END"


def unused_import() -> Column:
    return _quality(
        "unused_import", fv.WARNING,
        "Import '{pkg}' may be unused",
        "Remove unused imports to keep code clean.", IMPORTS,
    )


def duplicate_windows(lines: DataFrame) -> DataFrame:
    """``(file_id, path, line_no, first_line)`` of windows seen before in the file."""
    size = fv.DUPLICATE_WINDOW
    # the text of a line becomes its hash before any sort, so six lines are six numbers
    numbers = lines.filter(F.col("n_lines") >= 2 * size).select(
        "file_id", "path", "n_lines", "line_no", F.xxhash64("trimmed").alias("of_line"))
    following = ["of_line"] + [F.lead("of_line", n).over(in_file()) for n in range(1, size)]
    blank = F.xxhash64(*[F.xxhash64(F.lit(""))] * size)
    hashed = (
        numbers.select("file_id", "path", "n_lines", "line_no", F.xxhash64(*following).alias("hash"))
        .filter((F.col("line_no") <= F.col("n_lines") - (size - 1)) & (F.col("hash") != blank))
        .select("file_id", "path", "line_no", "hash")
    )
    same = Window.partitionBy("file_id", "hash")
    return (
        hashed.withColumn("first_line", F.min("line_no").over(same))
        .filter(F.col("line_no") > F.col("first_line"))
        .select("file_id", "path", "line_no", "first_line")
    )


def code_duplication(lines: DataFrame) -> DataFrame:
    return emit(duplicate_windows(lines), duplicate())


def duplicate() -> Column:
    return _quality(
        "code_duplication", fv.INFO,
        "Duplicate code block (also at line {first_line})",
        "Extract duplicated code into a shared function.", DUPLICATION,
    )


def scan(lines: DataFrame, files: DataFrame, functions: DataFrame, stats: DataFrame) -> DataFrame:
    """All quality findings.  The checks of single lines share one pass."""
    seen = with_closure_flag(with_following_lines(lines))
    return union_all(
        [
            function_findings(functions),
            long_files(files),
            deep_nesting(lines),
            emit(seen, dead_code(), empty_error_handler(), error_swallowing(), todo_marker()),
            magic_numbers(lines),
            naming_inconsistency(stats),
            unused_imports(lines, files),
            code_duplication(lines),
        ]
    )
