"""Twelve weighted signals of machine-written code, and the findings three of them give.

Signals of identifiers are computed inside the row of a file; signals of lines by one
aggregate per file, which shrinks to a row per file before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.functions.regex import to_java
from codestrata.functions.text import sql_string
from codestrata.operators.findings import AI_PASS, emit, finding, union_all
from codestrata.sources.lines import LineStats, in_file, line_count, previous_non_null

GENERIC, MARKER, README = 1, 2, 3
MIN_COMMENT_BYTES = 5


def _step(value: Column, *steps: tuple[float, float], otherwise: Column | float = 0.0) -> Column:
    """The score of the first threshold that ``value`` exceeds."""
    out = None
    for above, score in steps:
        hit, score = value > above, F.lit(score)
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(otherwise)


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


# -- identifiers -----------------------------------------------------------


def with_identifiers(files: DataFrame) -> DataFrame:
    """Add ``identifiers``: all ASCII identifiers of a file, in order."""
    return files.select("*", text.bound(text.all_matches("content", fv.IDENTIFIER_PATTERN))
                        .alias("identifiers"))


def identifiers(files: DataFrame) -> DataFrame:
    """``(file_id, pos, token)``, one row per identifier."""
    return (
        files.select(
            "file_id",
            F.posexplode_outer(text.all_matches("content", fv.IDENTIFIER_PATTERN))
            .alias("pos", "token"))
        .filter(F.col("token").isNotNull())
    )


def identifier_stats(files: DataFrame) -> DataFrame:
    """Counts of identifiers per file, by style."""
    tokens = F.col("identifiers")
    generic = [F.lit(n) for n in fv.GENERIC_NAMES]

    def style(has_underscore: bool):
        def test(t: Column) -> Column:
            shape = t.contains("_") if has_underscore else ~t.contains("_") & t.rlike("[A-Z]")
            return (F.octet_length(t) >= 3) & shape & t.rlike("[a-z]")
        return test

    return with_identifiers(files).select(
        "file_id",
        F.size(tokens).alias("n_tokens"),
        F.size(F.array_distinct(F.transform(tokens, F.lower))).alias("n_distinct"),
        F.size(F.filter(tokens, style(True))).alias("n_snake"),
        F.size(F.filter(tokens, style(False))).alias("n_camel"),
        F.exists(tokens, lambda t: F.array_contains(F.array(*generic), F.lower(t)))
        .alias("has_generic"),
    )


def token_diversity() -> Column:
    ratio = _ratio(F.col("n_distinct"), F.col("n_tokens"))
    return (
        F.when(F.col("n_tokens") == 0, 0.0).when(ratio > 0.6, 0.0).when(ratio < 0.2, 1.0)
        .otherwise(1.0 - ratio / 0.6)
    )


def naming_entropy() -> Column:
    total = F.col("n_camel") + F.col("n_snake")
    consistency = _ratio(F.greatest("n_camel", "n_snake"), total)
    return F.when((F.col("n_tokens") < 10) | (total < 5), 0.0).otherwise(
        _step(consistency, (0.95, 0.6), (0.85, 0.3)))


def generic_names(files: DataFrame) -> DataFrame:
    """``(file_id, path, n_lines, pos, name, line_no)``: generic names of a file, once each.

    ``name`` is the first spelling met, ``line_no`` the first line that holds this
    spelling, be it inside a longer word.
    """
    return (
        with_identifiers(files.withColumn("n_lines", line_count()))
        .select("file_id", "path", "n_lines",
                F.posexplode_outer(F.expr(generic_places())).alias("pos", "found"))
        .filter(F.col("found").isNotNull())
        .select("file_id", "path", "n_lines", "pos", "found.name", "found.line_no")
    )


def generic_places() -> str:
    """SQL for an array of (name, line_no), from ``identifiers`` and ``content``."""
    words = ", ".join(sql_string(n) for n in fv.GENERIC_NAMES)
    spellings = (
        f"array_distinct(filter(identifiers, t -> lower(t) IN ({words})))"
    )
    firsts = (
        f"get(transform(array({spellings}), c -> filter(c, (t, i) ->"
        " array_position(transform(c, x -> lower(x)), lower(t)) = i + 1)), 0)"
    )
    before = "substring(content, 1, instr(content, t) - 1)"
    return (
        f"transform({firsts}, t -> named_struct('name', t, 'line_no', get(transform(array({before}), b ->"
        " 1 + octet_length(b) - octet_length(replace(b, '\\n', ''))), 0)))"
    )


def generic_naming(files: DataFrame) -> DataFrame:
    return emit(generic_names(files).filter(F.col("n_lines") >= fv.MIN_AI_LINES), generic_name())


def generic_name() -> Column:
    return finding(
        type="generic_naming", severity=fv.INFO, category=fv.AI_PATTERN, fix="",
        message="Generic identifier '{name}' — common in AI-generated code",
        pass_no=AI_PASS, check_no=GENERIC, ord="pos",
    )


# -- comments --------------------------------------------------------------


def phrase_no(patterns: list[str]) -> Column:
    """Number of the first pattern that a comment line matches, else NULL."""
    cases = " ".join(
        f"WHEN c RLIKE {sql_string(to_java(p))} THEN {n}" for n, p in enumerate(patterns, start=1))
    first = f"CASE WHEN octet_length(c) < {MIN_COMMENT_BYTES} THEN NULL {cases} END"
    bound = text.comment_text_sql("trimmed")
    return F.when(text.is_comment(), F.expr(f"get(transform(array({bound}), c -> {first}), 0)"))


def marker_no() -> Column:
    return phrase_no([p for p, _ in fv.MARKER_PHRASES])


def readme_no() -> Column:
    return phrase_no(list(fv.README_PHRASES))


def comment_lines(lines: DataFrame) -> DataFrame:
    """Comment lines with the phrases they hold: ``marker_no`` and ``readme_no``."""
    return lines.filter(text.is_comment()).select(
        "file_id", "path", "n_lines", "line_no",
        marker_no().alias("marker_no"), readme_no().alias("readme_no"))


def marker_phrase() -> Column:
    messages = ", ".join(sql_string(m) for _, m in fv.MARKER_PHRASES)
    return F.when(
        F.col("marker_no").isNotNull() & (F.col("n_lines") >= fv.MIN_AI_LINES),
        finding(
            type="ai_marker_phrase", severity=fv.INFO, category=fv.AI_PATTERN, fix="",
            message="", message_sql=f"get(array({messages}), marker_no - 1)",
            pass_no=AI_PASS, check_no=MARKER,
        ),
    )


def readme_comment() -> Column:
    return F.when(
        F.col("readme_no").isNotNull() & (F.col("n_lines") >= fv.MIN_AI_LINES),
        finding(
            type="readme_comment", severity=fv.INFO, category=fv.AI_PATTERN, fix="",
            message=fv.README_MESSAGE, pass_no=AI_PASS, check_no=README,
        ),
    )


def comment_findings(lines: DataFrame) -> DataFrame:
    return emit(comment_lines(lines), marker_phrase(), readme_comment())


def findings(lines: DataFrame, files: DataFrame) -> DataFrame:
    """All findings of the signals."""
    return union_all([generic_naming(files), comment_findings(lines)])


def comment_stats() -> LineStats:
    """Comments per file and how many hold a phrase."""
    return LineStats(
        {"is_comment": text.is_comment(), "marker_no": marker_no(), "readme_no": readme_no()},
        {
            "n_comments": _count_if(F.col("is_comment")),
            "n_markers": F.count("marker_no"),
            "n_readme": F.count("readme_no"),
        },
    )


def marker_phrases() -> Column:
    ratio = _ratio(F.col("n_markers"), F.col("n_comments"))
    some = F.when(F.col("n_markers") > 0, 0.2).otherwise(0.0)
    return F.when(F.col("n_comments") < 3, 0.0).otherwise(
        _step(ratio, (0.15, 1.0), (0.08, 0.7), (0.03, 0.4), otherwise=some))


def readme_comments() -> Column:
    ratio = _ratio(F.col("n_readme"), F.col("n_comments"))
    some = F.when(F.col("n_readme") > 0, 0.3).otherwise(0.0)
    return F.when(F.col("n_comments") < 2, 0.0).otherwise(
        _step(ratio, (0.20, 1.0), (0.10, 0.6), otherwise=some))


# -- lines -----------------------------------------------------------------


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def line_stats() -> LineStats:
    """What the signals of lines are computed from."""
    blank = text.is_blank()
    calls = {
        f"call_{language}_{n}": (F.col("language") == language) & text.matches("line", pattern)
        for language, patterns in fv.REPEATED_CALL_PATTERNS.items()
        for n, pattern in enumerate(patterns)
    }
    n_calls = [_count_if(F.col(c)) for c in calls]
    often = [F.when(n >= fv.MIN_REPEATS, n).otherwise(0) for n in n_calls]
    return LineStats(
        columns={
            "comment": F.when(~blank, text.is_comment()),
            "byte_len": F.when(~blank, F.octet_length("line")),
            "trimmed_bytes": F.when(~blank, F.octet_length("trimmed")),
            "even_indent": F.when(~blank, text.indent("line") % 2 == 0),
            "section": text.matches("line", fv.SECTION_HEADER_PATTERN),
            **calls,
        },
        windowed={"after_comment": previous_non_null("comment")},
        aggregates={
            "n_filled": F.count("comment"),
            "n_comment_lines": _count_if(F.col("comment")),
            "n_code": _count_if(~F.col("comment")),
            "n_even": _count_if(F.col("even_indent")),
            "length_variance": F.var_pop("byte_len"),
            "length_skew": F.skewness("trimmed_bytes"),
            "shortest": F.min("trimmed_bytes"),
            "longest": F.max("trimmed_bytes"),
            "n_sections": _count_if(F.col("section")),
            "n_transitions": _count_if(~F.col("comment") & F.col("after_comment")),
            "n_calls": reduce(Column.__add__, often),
        },
    )


def formatting() -> Column:
    even = _ratio(F.col("n_even"), F.col("n_filled"))
    aligned = F.when(even > 0.95, 1.0).otherwise(0.0)
    alike = F.when(F.col("length_variance") < 100, 1.0 - F.col("length_variance") / 100).otherwise(0.0)
    return F.when((F.col("n_lines") < 10) | (F.col("n_filled") == 0), 0.0).otherwise(
        aligned * 0.5 + alike * 0.5)


def comment_quality() -> Column:
    ratio = _ratio(F.col("n_comment_lines"), F.col("n_code"))
    return F.when(F.col("n_code") == 0, 0.0).otherwise(
        _step(ratio, (0.5, 0.9), (0.3, 0.6), (0.2, 0.3)))


def comment_ratio() -> Column:
    """Share of comments among filled lines; not the ratio of ``comment_quality``."""
    return F.when(F.col("n_code") == 0, 0.0).otherwise(
        _ratio(F.col("n_comment_lines"), F.col("n_code") + F.col("n_comment_lines")))


def structural_pattern() -> Column:
    numbered = F.when(F.col("n_sections") >= 3, 0.9).when(F.col("n_sections") >= 2, 0.6).otherwise(0.0)
    ratio = _ratio(F.col("n_transitions"), F.col("n_code"))
    alternating = F.when((F.col("n_code") > 5) & (ratio > 0.4), F.least(F.lit(1.0), ratio))
    return F.greatest(numbered, alternating)


def line_length_dist() -> Column:
    skew = F.abs("length_skew")
    return (
        F.when(F.col("n_filled") < 20, 0.0)
        .when(F.col("shortest") == F.col("longest"), 0.8)
        .when(skew < 0.3, 0.7)
        .when(skew < 0.7, 0.3)
        .otherwise(0.0)
    )


# -- functions, error blocks, repeated shapes ------------------------------


def function_size_stats(functions: DataFrame) -> DataFrame:
    size = F.col("line_count").cast("long")
    return functions.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_functions"),
        F.sum(size).alias("size_sum"),
        F.sum(size * size).alias("size_squares"),
    )


def function_uniformity() -> Column:
    """By the variance of the sizes, compared in whole numbers."""
    n = F.col("n_functions")
    spread = n * F.col("size_squares") - F.col("size_sum") * F.col("size_sum")
    return (
        F.when(F.coalesce(n, F.lit(0)) < 3, 0.0)
        .when(spread < 10 * n * n, 0.8)
        .when(spread < 25 * n * n, 0.4)
        .otherwise(0.0)
    )


def error_blocks(lines: DataFrame) -> DataFrame:
    """``(file_id, block)``: error handling lines with the up to three lines below."""
    starts = None
    for language, pattern in fv.ERROR_BLOCK_PATTERNS.items():
        hit = (F.col("language") == language) & text.matches("line", pattern)
        starts = hit if starts is None else starts | hit
    below = [F.lead("trimmed", n).over(in_file()) for n in (1, 2, 3)]
    return (
        lines.filter(F.col("language").isin(list(fv.ERROR_BLOCK_PATTERNS)))
        .select("file_id", starts.alias("starts"), F.concat_ws("\n", "line", *below).alias("block"))
        .filter("starts")
        .select("file_id", "block")
    )


def error_block_stats(lines: DataFrame) -> DataFrame:
    return (
        error_blocks(lines)
        .groupBy("file_id", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("file_id")
        .agg(F.sum("n").alias("n_blocks"), F.max("n").alias("n_top_block"))
    )


def error_boilerplate() -> Column:
    share = F.col("n_top_block") / F.col("n_blocks")
    return F.when(F.coalesce("n_blocks", F.lit(0)) < 3, 0.0).otherwise(
        _step(share, (0.7, 0.9), (0.5, 0.5)))


def line_shapes(lines: DataFrame) -> DataFrame:
    """``(file_id, shape)``: longer lines with the quoted texts blanked."""
    no_double = F.regexp_replace("trimmed", '"[^"]*"', '""')
    return lines.filter(F.octet_length("trimmed") >= fv.MIN_SHAPE_BYTES).select(
        "file_id", F.regexp_replace(no_double, "'[^']*'", "''").alias("shape"))


def shape_stats(lines: DataFrame) -> DataFrame:
    return (
        line_shapes(lines)
        .groupBy("file_id", "shape")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= fv.MIN_REPEATS)
        .groupBy("file_id")
        .agg(F.sum("n").alias("n_repeated"))
    )


def generic_repetition() -> Column:
    n = F.coalesce("n_repeated", F.lit(0))
    return F.when(n == 0, 0.0).otherwise(
        _step(n / F.col("n_lines"), (0.15, 0.8), (0.08, 0.5), otherwise=0.2))


def repetitive_structure() -> Column:
    return F.when(F.col("n_calls") == 0, generic_repetition()).otherwise(
        _step(F.col("n_calls") / F.col("n_lines"), (0.15, 1.0), (0.08, 0.7), (0.04, 0.4)))


# -- score -----------------------------------------------------------------

SIGNALS = {
    "token_diversity": token_diversity,
    "formatting": formatting,
    "generic_naming": lambda: F.when(F.col("has_generic"), 1.0).otherwise(0.0),
    "comment_quality": comment_quality,
    "function_uniformity": function_uniformity,
    "marker_phrases": marker_phrases,
    "error_boilerplate": error_boilerplate,
    "naming_entropy": naming_entropy,
    "structural_pattern": structural_pattern,
    "line_length_dist": line_length_dist,
    "readme_comments": readme_comments,
    "repetitive_structure": repetitive_structure,
}


def file_stats(
    files: DataFrame, lines: DataFrame, functions: DataFrame, per_file_stats: DataFrame
) -> DataFrame:
    """All that the signals are computed from, a row per file.

    ``per_file_stats`` holds the ``line_stats`` and ``comment_stats``.  Every part is
    keyed by ``file_id``; on a co-located corpus the joins move nothing.
    """
    parts = [
        identifier_stats(files), function_size_stats(functions), error_block_stats(lines),
        shape_stats(lines),
    ]
    joined = reduce(lambda a, b: a.join(b, "file_id", "left"), parts, per_file_stats)
    return joined.fillna(0, ["n_functions"])


def signals(stats: DataFrame, *kept: str) -> DataFrame:
    """The twelve signals, each from 0 to 1; files under five lines have none.

    Columns named in ``kept`` come along.
    """
    large_enough = F.col("n_lines") >= fv.MIN_AI_LINES
    return stats.select(
        "file_id", "path", "language", "n_lines", *kept,
        *[F.when(large_enough, SIGNALS[s]()).otherwise(0.0).alias(s) for s in fv.SIGNAL_WEIGHTS],
        comment_ratio().alias("comment_ratio"),
        F.col("n_functions").cast("int").alias("n_functions"),
    )


def ai_score() -> Column:
    """The weighted sum of the signals, from 0 to 100."""
    total = reduce(Column.__add__, [F.col(s) * w for s, w in fv.SIGNAL_WEIGHTS.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))
