"""Named DuckDB table expressions, put together per query.

The statements follow the semantics of the checks, not the Spark plans, and use the
patterns in their own (RE2) dialect.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def query(sql: str, *needs: str) -> str:
    """``sql`` behind all table expressions it needs, directly or not."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {ctes}\n{sql}" if ctes else sql


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def part(column: str, pattern: str, group: int) -> str:
    return f"regexp_extract({column}, {q(pattern)}, {group})"


def hits(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({column}, {q(pattern)}, {group})"


def occurrences(column: str, piece: str) -> str:
    return f"((strlen({column}) - strlen(replace({column}, {q(piece)}, ''))) // {len(piece)})"


def starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {q(p)})" for p in prefixes) + ")"
