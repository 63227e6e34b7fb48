"""Files split into numbered lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from codestrata.functions import text


def split_lines(content: Column | str = "content") -> Column:
    """Split at line feeds only; empty content is one empty line."""
    return F.split(content, "\n", -1)


def line_count(content: Column | str = "content") -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return (text.count_of(content, "\n") + 1).cast("int")


def explode_lines(files: DataFrame) -> DataFrame:
    """``(file_id, path, language, n_lines, line_no, line, trimmed)``, one row per line.

    There is always a line, so the outer form gives the same rows; with it Spark does
    not split every file once more to filter out empty ones.
    """
    counted = files.select(
        "file_id", "path", "language", line_count().alias("n_lines"), "content"
    )  # a step of its own: next to the generator it would be counted for every line
    # stripped before the generator, so that no filter above has to strip again
    both = F.transform(
        split_lines(), lambda x: F.struct(x.alias("line"), text.strip(x).alias("trimmed")))
    return counted.select(
        "file_id", "path", "language", "n_lines", F.posexplode_outer(both).alias("pos", "l")
    ).select(
        "file_id", "path", "language", "n_lines",
        (F.col("pos") + 1).alias("line_no"), "l.line", "l.trimmed",
    )


def explode_chunks(chunks: DataFrame) -> DataFrame:
    """As ``explode_lines``, of ``(file_id, path, language, n_lines, first_line, content)`` with whole lines as content."""
    both = F.transform(
        split_lines(), lambda x: F.struct(x.alias("line"), text.strip(x).alias("trimmed")))
    return chunks.select(
        "file_id", "path", "language", "n_lines", "first_line", F.posexplode_outer(both).alias("pos", "l")
    ).select(
        "file_id", "path", "language", "n_lines",
        (F.col("first_line") + F.col("pos")).alias("line_no"), "l.line", "l.trimmed",
    )


def with_line_columns(lines: DataFrame) -> DataFrame:
    """Add the lengths, indent and flags that describe a line."""
    return lines.withColumns(
        {
            "byte_len": F.octet_length("line"),
            "trimmed_bytes": F.octet_length("trimmed"),
            "indent": text.indent("line"),
            "is_blank": text.is_blank(),
            "is_comment": text.is_comment(),
        }
    )


def in_file() -> WindowSpec:
    """The lines of a file in order."""
    return Window.partitionBy("file_id").orderBy("line_no")


def so_far() -> WindowSpec:
    return in_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier() -> WindowSpec:
    return in_file().rowsBetween(Window.unboundedPreceding, -1)


def next_non_null(column: str) -> Column:
    """The value of the next line on which ``column`` is not NULL."""
    return F.expr(f"lead({column}) IGNORE NULLS OVER (PARTITION BY file_id ORDER BY line_no)")


def previous_non_null(column: str) -> Column:
    return F.expr(f"lag({column}) IGNORE NULLS OVER (PARTITION BY file_id ORDER BY line_no)")


class LineStats(NamedTuple):
    """Aggregates over the lines of a file and the columns of a line they need.

    ``windowed`` columns look at other lines of the file, by way of ``columns``.
    """

    columns: dict[str, Column]
    aggregates: dict[str, Column]
    windowed: dict[str, Column] = {}


def per_file(lines: DataFrame, *stats: LineStats) -> DataFrame:
    """``(file_id, path, language, n_lines, ...)``: all ``stats`` in one aggregate.

    Every file has a line, so every file has a row.
    """
    columns = {k: c for s in stats for k, c in s.columns.items()}
    windowed = {k: c for s in stats for k, c in s.windowed.items()}
    aggregates = {k: c for s in stats for k, c in s.aggregates.items()}
    described = lines.select(
        "file_id", "path", "language", "n_lines", "line_no",
        *[c.alias(k) for k, c in columns.items()],
    )
    if windowed:
        described = described.withColumns(windowed)
    return described.groupBy("file_id", "path", "language", "n_lines").agg(
        *[c.alias(k) for k, c in aggregates.items()])
