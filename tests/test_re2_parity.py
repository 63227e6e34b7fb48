"""Rules, function starts and line patterns against RE2 (DuckDB's), on lines made from each pattern's own syntax."""

import random
import re._constants as sre
import re._parser as parser

import duckdb
import pytest
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.functions.linear import FUNCTION_FORMS, LINEAR
from codestrata.functions.regex import to_java
from codestrata.functions.text import sql_string

#: Lines of each pattern.
LINES = 1000
ODD = "ſKé中 \t\x0b\x0c\r \u0085 _-.\"'`()[]{}<>=:;,+*/\\|&%$#@!?0aZ"


def sample(tree, r):
    """A text that the parsed pattern matches, as a rule."""
    out = []
    for op, arg in tree:
        if op is sre.LITERAL:
            c = chr(arg)
            out.append(c.swapcase() if r.random() < 0.15 else c)
        elif op is sre.NOT_LITERAL:
            out.append(r.choice([c for c in ODD if c != chr(arg)]))
        elif op is sre.ANY:
            out.append(r.choice(ODD))
        elif op is sre.IN:
            out.append(in_class(arg, r))
        elif op is sre.BRANCH:
            out.append(sample(r.choice(arg[1]), r))
        elif op is sre.SUBPATTERN:
            out.append(sample(arg[-1], r))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, part = arg
            out.append("".join(sample(part, r) for _ in range(r.choice((low, low, min(high, low + 1), min(high, low + 4))))))
    return "".join(out)


def in_class(items, r):
    if items[0][0] is sre.NEGATE:
        allowed = [c for c in ODD if not re_class(items[1:], c)]
        return r.choice(allowed or ["~"])
    op, arg = r.choice(items)
    if op is sre.LITERAL:
        return chr(arg)
    if op is sre.RANGE:
        return chr(r.randint(*arg))
    return r.choice({sre.CATEGORY_SPACE: " \t\x0b\x0c", sre.CATEGORY_DIGIT: "0189", sre.CATEGORY_WORD: "aZ_9ſ"}.get(arg, ODD))


def re_class(items, c):
    for op, arg in items:
        if op is sre.LITERAL and chr(arg) == c or op is sre.RANGE and arg[0] <= ord(c) <= arg[1]:
            return True
        if op is sre.CATEGORY and {sre.CATEGORY_SPACE: c.isspace(), sre.CATEGORY_DIGIT: c.isdigit(), sre.CATEGORY_WORD: c.isalnum() or c == "_"}.get(arg):
            return True
    return False


def lines_of(pattern, seed):
    r = random.Random(seed)
    tree = parser.parse(pattern)
    out = []
    for _ in range(LINES):
        text = sample(tree, r).replace("\n", " ")
        for _ in range(r.choice((0, 0, 1, 2))):  # a mutation: drop, double, swap or set a character
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(("", text[at:at + 1] * 2, r.choice(ODD), text[at:at + 3][::-1])) + text[at + 1:]
        out.append(r.choice(("", "", "x", " ", "a b ", "é", "_")) + text + r.choice(("", "", "y", " ", "(", "é", text[:8])))
    return out


RULES = [x.pattern for x in fv.SECURITY_RULES]
FUNCTIONS = sorted({spec for spec in fv.FUNCTION_PATTERNS.values()})
OTHERS = [fv.TODO_PATTERN, fv.JUMP_PATTERN, fv.CLOSURE_PATTERN, fv.SWALLOW_PATTERN, fv.SWALLOW_ALLOWED_PATTERN, fv.CONSTANT_LINE_PATTERN,
          fv.HEX_COLOUR_PATTERN, fv.SNAKE_SEARCH_PATTERN, fv.SECURITY_COMMENT_PATTERN, fv.TEST_PATH_PATTERN, fv.SECTION_HEADER_PATTERN,
          *[p for p, _ in fv.MARKER_PHRASES], *fv.README_PHRASES, *fv.ERROR_BLOCK_PATTERNS.values(),
          *[p for ps in fv.REPEATED_CALL_PATTERNS.values() for p in ps]]


@pytest.mark.parametrize("patterns", (RULES, OTHERS), ids=("rules", "others"))
def test_matches(spark, patterns):
    rows = [(n, t) for n, p in enumerate(patterns) for t in lines_of(p, n)]
    cases = " ".join(f"WHEN {n} THEN line RLIKE {sql_string(to_java(LINEAR.get(p, p)))}" for n, p in enumerate(patterns))
    table = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "k int, n int, line string")
    got = [r.hit for r in table.select("k", F.expr(f"get(transform(array(n), n -> CASE n {cases} END), 0)").alias("hit")).orderBy("k").collect()]
    hits, wrong = 0, []
    for n, p in enumerate(patterns):
        texts = [t for m, t in rows if m == n]
        want = [x for x, in duckdb.execute("SELECT regexp_matches(unnest($1), $2)", [texts, p]).fetchall()]
        mine = got[n * LINES:(n + 1) * LINES]
        hits += sum(want)
        wrong += [(p, t, w) for t, w, g in zip(texts, want, mine, strict=True) if w != g]
    assert wrong == [], (len(wrong), wrong[:5])
    assert hits > len(rows) // 10


def test_function_names(spark):
    """The first filled group, as the forms give it, against the plain pattern."""
    wrong, found = [], 0
    for n, (pattern, groups) in enumerate(FUNCTIONS):
        texts = [t.strip() for t in lines_of(pattern, n)]
        forms = FUNCTION_FORMS.get(pattern, [(pattern, g) for g in groups])
        picked = ", ".join(f"nullif(regexp_extract(line, {sql_string(to_java(form))}, {g}), '')" for form, g in forms)
        table = spark.createDataFrame(list(enumerate(texts)), "k int, line string")
        got = [r.name for r in table.select("k", F.expr(f"coalesce({picked})").alias("name")).orderBy("k").collect()]
        for t, g in zip(texts, got, strict=True):
            values = duckdb.execute("SELECT " + ", ".join(f"regexp_extract($1, $2, {k})" for k in groups), [t, pattern]).fetchone()
            want = next((v for v in values if v), None)
            found += want is not None
            if want != g:
                wrong.append((pattern, t, want, g))
    assert wrong == [], (len(wrong), wrong[:5])
    assert found > 200
