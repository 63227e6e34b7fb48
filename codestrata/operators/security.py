"""Line rules for secrets, injection, crypto misuse, authentication and disclosure.

The rules are put together as SQL text: one expression for a whole rule table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions import text
from codestrata.functions.linear import LINEAR
from codestrata.functions.regex import to_java, trie
from codestrata.functions.text import sql_string
from codestrata.operators.findings import ISSUE_COLUMNS, SECURITY_PASS

#: Rules behind one comparison of the rule number.
RULES_A_STEP = 8

#: Lines the rules look at: not blank, no comment, no definition of a pattern or text.
#: ``low`` stands for the line in lower case, folded.
ELIGIBLE = (
    "trimmed <> ''"
    f" AND NOT line RLIKE {sql_string(to_java(fv.SECURITY_COMMENT_PATTERN))}"
    f" AND NOT {text.holds_any_sql('low', fv.DEFINITION_LINE_WORDS)}"
)


def per_lowered_line(body: str) -> str:
    """``body`` with ``low`` bound once to the folded line."""
    return f"get(transform(array({text.folded_sql('line')}), low -> {body}), 0)"


def eligible_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(per_lowered_line(ELIGIBLE))


def looks_random(rule: fv.Rule) -> str:
    """The secret found by ``rule`` has the entropy of a real one."""
    value = text.secret_value_sql("line", rule.pattern, rule.entropy_groups)
    enough = f"v = '' OR {text.entropy_sql('v')} >= {fv.MIN_SECRET_ENTROPY}D"
    return f"get(transform(array({value}), v -> {enough}), 0)"


def secret_values(lines: DataFrame) -> DataFrame:
    """``(file_id, path, line_no, rule_no, value, entropy)`` of all rules that test entropy."""
    found = ", ".join(
        f"CASE WHEN {text.holds_any_sql('low', r.needs)}"
        f" AND line RLIKE {sql_string(to_java(LINEAR.get(r.pattern, r.pattern)))} THEN named_struct('rule_no', {n},"
        f" 'value', {text.secret_value_sql('line', r.pattern, r.entropy_groups)}) END"
        for n, r in enumerate(fv.SECURITY_RULES, start=1)
        if r.entropy_groups
    )
    values = per_lowered_line(f"CASE WHEN {ELIGIBLE} THEN array_compact(array({found})) END")
    return (
        lines.select("file_id", "path", "line_no", F.explode_outer(F.expr(values)).alias("f"))
        .filter(F.col("f").isNotNull())
        .select("file_id", "path", "line_no", "f.rule_no", "f.value")
        .withColumn("entropy", F.expr(text.entropy_sql("value")))
    )


def rule_hit(rule: fv.Rule, gated: bool = True) -> str:
    """Does ``rule`` fire on a line?  A cheap literal test stands before the pattern."""
    tests = [f"line RLIKE {sql_string(to_java(LINEAR.get(rule.pattern, rule.pattern)))}"]
    if gated:
        tests.insert(0, text.holds_any_sql("low", rule.needs))
    if rule.entropy_groups:
        tests.append(looks_random(rule))
    return " AND ".join(tests)


def rules_by_literal(rules: Sequence[fv.Rule]) -> dict[str, list[int]]:
    """The rules that a literal, found as the longest at its place, makes candidates."""
    literals = sorted({x for r in rules for x in r.needs})
    return {
        found: [n for n, r in enumerate(rules, start=1) if any(found.startswith(x) for x in r.needs)]
        for found in literals}


def candidate_rules(rules: Sequence[fv.Rule]) -> str:
    """The numbers of the rules of which the line holds a literal.

    One pattern, a trie of all literals, looks at each place of the folded line once and gives the
    longest literal there; a shorter one that begins it counts as well.
    """
    by_literal = rules_by_literal(rules)
    found = f"regexp_extract_all(low, {sql_string(f'(?=({trie(list(by_literal))}))')}, 1)"
    pairs = ", ".join(f"{sql_string(x)}, array({', '.join(map(str, numbers))})" for x, numbers in by_literal.items())
    return f"array_distinct(flatten(transform(array_distinct({found}), x -> element_at(map({pairs}), x))))"


def fired_rules(rules: Sequence[fv.Rule], gated: bool = True) -> str:
    """The numbers of the rules that fire on a line, in no order; only candidates are tried."""
    def case(first: int, some: Sequence[fv.Rule]) -> str:
        tests = " ".join(f"WHEN {n} THEN {rule_hit(r, False)}" for n, r in enumerate(some, start=first))
        return f"CASE r {tests} END"

    steps = [(n, rules[n:n + RULES_A_STEP]) for n in range(0, len(rules), RULES_A_STEP)]
    chosen = " ".join(f"WHEN r <= {n + len(some)} THEN {case(n + 1, some)}" for n, some in steps)
    candidates = candidate_rules(rules) if gated else f"sequence(1, {len(rules)})"
    # a lambda is interpreted, rule by rule: patterns of rules that are no candidates are not even compiled
    return f"filter({candidates}, r -> CASE {chosen} END)"


def scan(
    lines: DataFrame,
    path_aware: bool = False,
    rules: Sequence[fv.Rule] = fv.SECURITY_RULES,
    gated: bool = True,
) -> DataFrame:
    """Findings of ``rules``, one per rule and line.

    A narrow transformation: no shuffle.  With ``path_aware`` secrets in test files
    count as information only.
    """
    looked_at = lines.select(
        "file_id", "path", "line_no", "line", "trimmed", text.bound(text.folded("line")).alias("low")
    ).filter(ELIGIBLE)
    # the outer form of explode keeps Spark from testing the array in a filter first
    found = looked_at.select(
        "file_id", "path", "line_no", F.explode_outer(F.expr(fired_rules(rules, gated))).alias("rule_no")
    ).filter(F.col("rule_no").isNotNull())
    return described(found, path_aware, rules).select(*ISSUE_COLUMNS)


def described(found: DataFrame, path_aware: bool = False, rules: Sequence[fv.Rule] = fv.SECURITY_RULES) -> DataFrame:
    """``(file_id, path, line_no, rule_no, ...)`` with the columns of a finding."""
    detail = ", ".join(
        f"named_struct('type', {sql_string(r.type)}, 'severity', {r.severity},"
        f" 'message', {sql_string(r.message)}, 'fix', {sql_string(r.fix)})"
        for r in rules
    )
    severity = F.col("d.severity")
    if path_aware:
        is_secret = F.col("d.type") == "hardcoded_secret"
        severity = F.when(is_secret & text.is_test_path(), fv.INFO).otherwise(severity)
    return found.withColumn("d", F.expr(f"get(array({detail}), rule_no - 1)")).withColumns({
        "type": F.col("d.type"), "severity": severity.cast("int"), "category": F.lit(fv.SECURITY),
        "message": F.col("d.message"), "fix": F.col("d.fix"), "pass_no": F.lit(SECURITY_PASS),
        "check_no": F.lit(1), "ord": F.col("line_no").cast("long"), "rule_no": F.col("rule_no").cast("int"),
    }).drop("d")
