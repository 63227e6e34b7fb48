"""Sequential restatement of the checks that Spark expresses with windows.

Used by the tests only, on small files.
"""

import re

from codestrata import fixed_values as fv
from codestrata.functions.text import WHITE_SPACE


def trim(s):
    return s.strip(WHITE_SPACE)


def regex(p):
    return re.compile(p.replace(r"\s", r"[\t\n\f\r ]").replace(r"[^[\t\n\f\r ]", r"[^\t\n\f\r "), re.ASCII)


def branches(line, language):
    t = trim(line)
    words = fv.BRANCH_KEYWORDS.get(language, fv.BRANCH_KEYWORDS["Go"])
    return sum(w in t for w in words) + t.count("&&") + t.count("||")


def functions(lines, language):
    """[(name, start, end, complexity)]"""
    if language not in fv.FUNCTION_PATTERNS:
        return []
    pattern, groups = fv.FUNCTION_PATTERNS[language]
    pattern = regex(pattern)
    done, open_one, depth, depth_at = [], None, 0, 0

    def finish(end):
        done.append((open_one["name"], open_one["start"], end, open_one["cx"]))

    for no, line in enumerate(lines, start=1):
        t = trim(line)
        m = pattern.search(t)
        if m:
            if open_one:
                finish(no - 1)
            name = next(m[g] for g in groups if m[g])
            open_one, depth_at = {"name": name, "start": no, "cx": 1}, depth
        depth += t.count("{") - t.count("}")
        if not open_one:
            continue
        open_one["cx"] += branches(line, language)
        if depth > depth_at or no == 1:
            continue
        if language in ("Python", "Ruby"):
            if t and line[0] not in " \t" and no > open_one["start"] + 1:
                finish(no - 1)
                open_one = None
        elif language == "Lua" and t == "end":
            finish(no)
            open_one = None
    if open_one:
        finish(len(lines))
    return done


def in_closure(lines, no):
    closed = 0
    for line in reversed(lines[:no]):
        closed += line.count("}") - line.count("{")
        t = trim(line)
        plain = t.startswith("func ") and "= func(" not in t and "(func(" not in t
        if regex(fv.CLOSURE_PATTERN).search(line) and closed <= 0 and not plain:
            return True
    return False


def dead_code(lines):
    out = []
    for no, line in enumerate(lines, start=1):
        if not regex(fv.JUMP_PATTERN).search(trim(line)) or in_closure(lines, no):
            continue
        below = [(n, trim(x)) for n, x in enumerate(lines[no:], start=no + 1) if trim(x)]
        if below and below[0][1] not in fv.LONE_CLOSERS and not below[0][1].startswith(
                ("case ", "default:")):
            out.append(below[0][0])
    return out


def unused_imports(lines):
    out, opened = [], None
    for no, line in enumerate(lines, start=1):
        t = trim(line)
        if t == "import (":
            opened = no
        elif t == ")" and opened:
            opened = None
        elif t.startswith('import "'):
            m = regex(fv.SINGLE_IMPORT_PATTERN).search(t)
            name = m[1].split("/")[-1] if m else "_"
            if not name.startswith("_") and not any(name + "." in x for x in lines[no:]):
                out.append(no)
        elif opened:
            alias, plain = (regex(p).search(line) for p in (fv.IMPORT_ALIAS_PATTERN, fv.IMPORT_PATTERN))
            if not alias and not plain:
                continue
            name = alias[1] if alias else plain[1].split("/")[-1]
            body = lines[opened - 1 + fv.IMPORT_BODY_OFFSET:]
            if name not in ("_", ".") and not any(name + "." in x for x in body):
                out.append(no)
    return out


def duplicates(lines):
    """[(line, first line)]"""
    size, first, out = fv.DUPLICATE_WINDOW, {}, []
    if len(lines) < 2 * size:
        return out
    for start in range(len(lines) - size + 1):
        block = tuple(trim(x) for x in lines[start:start + size])
        if any(block):
            seen = first.setdefault(block, start + 1)
            if seen != start + 1:
                out.append((start + 1, seen))
    return out


def transitions(lines):
    n, before = 0, False
    for line in lines:
        t = trim(line)
        if t:
            comment = t.startswith(fv.COMMENT_PREFIXES)
            n += before and not comment
            before = comment
    return n


def error_blocks(lines, language):
    pattern = fv.ERROR_BLOCK_PATTERNS.get(language)
    if not pattern:
        return []
    return ["\n".join([x, *map(trim, lines[n + 1:n + 4])])
            for n, x in enumerate(lines) if regex(pattern).search(x)]


def generic_names(content):
    """[(name, line)] in the order of first use."""
    seen, out = set(), []
    for token in re.findall(fv.IDENTIFIER_PATTERN, content, re.ASCII):
        low = token.lower()
        if low in fv.GENERIC_NAMES and low not in seen:
            seen.add(low)
            out.append((token, next(
                n for n, x in enumerate(content.split("\n"), start=1) if token in x)))
    return out
