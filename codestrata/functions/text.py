"""Column expressions for lines of text.

Lengths are in bytes, white space is Unicode white space, and an indent counts a
tab as four blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions.regex import to_java

#: Unicode white space, as stripped from both ends of a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def count_of(c: Column | str, piece: str) -> Column:
    """Number of non-overlapping occurrences of the ASCII string ``piece``."""
    c = _col(c)
    shorter = F.octet_length(F.replace(c, F.lit(piece), F.lit("")))
    freed = F.octet_length(c) - shorter
    found = freed if len(piece) == 1 else (freed / len(piece)).cast("int")
    # most lines hold none, and a search is several times faster than a replacement
    return F.when(~c.contains(piece), F.lit(0)).otherwise(found)


def indent(c: Column | str) -> Column:
    c = _col(c)
    body = F.ltrim(c, F.lit(" \t"))
    width = F.octet_length(c) - F.octet_length(body)
    return width + 3 * count_of(F.substring(c, F.lit(1), width), "\t")


def matches(c: Column | str, pattern: str) -> Column:
    return _col(c).rlike(to_java(pattern))


def group(c: Column | str, pattern: str, n: int) -> Column:
    """Capture group ``n`` of the first match, '' without one."""
    return F.regexp_extract(_col(c), to_java(pattern), n)


def all_matches(c: Column | str, pattern: str, n: int = 0) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(to_java(pattern)), F.lit(n))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds_any(c: Column, literals: tuple[str, ...]) -> Column:
    return any_of([c.contains(x) for x in literals])


def starts_with_any(c: Column | str, prefixes: tuple[str, ...]) -> Column:
    c = _col(c)
    return any_of([c.startswith(p) for p in prefixes])


def is_blank(trimmed: Column | str = "trimmed") -> Column:
    return _col(trimmed) == ""


def is_comment(trimmed: Column | str = "trimmed") -> Column:
    """A line that is a comment in any of the languages."""
    return starts_with_any(trimmed, fv.COMMENT_PREFIXES)


def comment_text_sql(trimmed: str) -> str:
    """The text after a comment marker; the trimmed line if there is none."""
    cases = " ".join(
        f"WHEN startswith({trimmed}, {sql_string(p)})"
        f" THEN btrim(substring({trimmed}, {len(p) + 1}), {sql_string(WHITE_SPACE)})"
        for p in fv.COMMENT_TEXT_PREFIXES
    )
    return f"CASE {cases} ELSE {trimmed} END"


def comment_text(trimmed: str = "trimmed") -> Column:
    return F.expr(comment_text_sql(trimmed))


def is_security_comment(line: Column | str = "line") -> Column:
    return matches(line, fv.SECURITY_COMMENT_PATTERN)


def is_test_path(path: Column | str = "path") -> Column:
    return matches(path, fv.TEST_PATH_PATTERN)


def is_definition_line(lowered: Column) -> Column:
    """The folded line speaks of patterns or texts shown to users."""
    return holds_any(lowered, fv.DEFINITION_LINE_WORDS)


def folded_sql(value: str) -> str:
    """In lower case, as patterns without case see it: the long s counts as an s."""
    return f"replace(lower({value}), '\u017f', 's')"


def folded(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~c.contains("\u017f"), F.lower(c)).otherwise(F.replace(F.lower(c), F.lit("\u017f"), F.lit("s")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Spark interprets the body instead of writing it into the generated loop, which
    also keeps long CASE chains from making that loop too large to be compiled.
    """
    return F.get(F.transform(F.array(value), body), 0)


def bound(value: Column) -> Column:
    """``value`` as the output of a one-row generator.

    Uses of the column then read the result; Spark would copy a plain expression into
    every filter and function above it and evaluate it each time.
    """
    return F.explode_outer(F.array(value))


def sql_string(s: str) -> str:
    """``s`` as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def entropy_sql(value: str) -> str:
    """Shannon entropy of the characters of ``value``, over its length in *bytes*.

    Rounded, so that the order of the additions cannot move it over a threshold.
    """
    share = (
        f"(octet_length({value}) - octet_length(replace({value}, c, '')))"
        f" / octet_length(c) / octet_length({value})"
    )
    return (
        f"round(aggregate(array_distinct(regexp_extract_all({value}, '(?s).', 0)), 0D,"
        f" (total, c) -> total - {share} * log2({share})), 9)"
    )


def secret_value_sql(line: str, pattern: str, groups: int) -> str:
    """The last capture group of more than four bytes, else the whole match."""
    java = sql_string(to_java(pattern))
    cases = " ".join(
        f"WHEN octet_length(regexp_extract({line}, {java}, {n})) > 4"
        f" THEN regexp_extract({line}, {java}, {n})"
        for n in range(groups, 0, -1)
    )
    return f"CASE {cases} ELSE regexp_extract({line}, {java}, 0) END"


def holds_any_sql(value: str, literals: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({value}, {sql_string(x)})" for x in literals) + ")"


def severity_name(severity: Column | str = "severity") -> Column:
    names = F.array(*[F.lit(n) for n in fv.SEVERITY_NAMES])
    return F.coalesce(F.get(names, _col(severity)), F.lit("unknown"))


def severity_label(severity: Column | str = "severity") -> Column:
    names = F.array(*[F.lit(n) for n in fv.SEVERITY_LABELS])
    return F.coalesce(F.get(names, _col(severity)), F.lit("???"))


def category_name(category: Column | str = "category") -> Column:
    names = F.array(*[F.lit(n) for n in fv.CATEGORY_NAMES])
    return F.coalesce(F.get(names, _col(category)), F.lit("Unknown"))


def bar(ratio: Column, width: int) -> Column:
    """A progress bar of ``width`` cells."""
    filled = F.least(F.floor(ratio * width), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def cut(c: Column, over_bytes: int, keep: int) -> Column:
    """Shorten to ``keep`` bytes (whole characters of them) and '...' if longer than ``over_bytes``."""
    head = F.substring(c.cast("binary"), 1, keep).cast("string")
    whole = F.when(F.is_valid_utf8(head), head).otherwise(
        F.regexp_replace(F.make_valid_utf8(head), "\ufffd+$", ""))
    return F.when(F.octet_length(c) > over_bytes, F.concat(whole, F.lit("..."))).otherwise(c)
