"""RE2 patterns in the Java dialect Spark uses."""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
#: One word and nothing else: classes, digits, groups and repeats between two boundaries.
_ONE_WORD = re.compile(r"\\b((?:\[[A-Za-z0-9_-]+\]|\\d|[A-Za-z0-9_(){},*+])+)\\b")


_PLAIN_ENDS = re.compile(r"(?i)[a-jl-rt-z](?:.*[a-jl-rt-z])?")
#: What folding adds to a letter beyond its other case (the long s, the Kelvin sign).
_FOLDS = {"s": "\u017f", "k": "\u212a"}
_ALL_FOLDS = "".join(_FOLDS.values())


def _folded(ch: str) -> str:
    return _FOLDS.get(ch.lower(), "")


def _folds_of_class(body: str) -> str:
    """What folding adds to a class with the letters and ranges of ``body`` (no escapes)."""
    ranges = re.findall(r"(.)-(.)", body)
    single = re.sub(r".-.", "", body)
    return "".join(
        extra for letter, extra in _FOLDS.items()
        if any(c in single or any(a <= c <= b for a, b in ranges) for c in (letter, letter.upper())))


def to_java(pattern: str) -> str:
    """Return ``pattern`` (RE2 syntax) with the same meaning under ``java.util.regex``.

    Java's ``\\b`` looks at Unicode letters, its ``\\s`` holds the vertical tab and its
    ``.`` stops at a carriage return; RE2 does none of that.  RE2 folds the long s and the
    Kelvin sign, Java only ASCII letters, or with its Unicode option also dotted and
    dotless i; so the two signs are written out.
    """
    flags, fold = "(?d)", False
    if pattern.startswith("(?i)"):
        flags, pattern, fold = "(?id)", pattern[4:], True
    word = _ONE_WORD.fullmatch(pattern)
    if word and fold and not _PLAIN_ENDS.fullmatch(word[1]):
        word = None  # the two signs are no word characters, so the ends tell nothing
    if word:  # the neighbours inside are known, so one look around is enough at either end
        pattern = word[1]
    out: list[str] = []
    in_class, body, first = False, "", 0
    chars = iter(pattern)
    for ch in chars:
        if ch == "\\":
            escaped = next(chars)
            if escaped == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif escaped == "b" and not in_class:
                out.append(_BOUNDARY)
            elif escaped == "w" and fold:
                out.append(rf"\w{_ALL_FOLDS}" if in_class else rf"[\w{_ALL_FOLDS}]")
            elif escaped == "W" and fold:
                raise ValueError("a folded \\W is not translated")
            else:
                out.append(ch + escaped)
            continue
        if ch == "[" and not in_class:
            in_class, body, first = True, "", len(out) + 1
        elif ch == "]" and in_class:
            in_class = False
            if fold:
                out.insert(first + body.startswith("^"), _folds_of_class(body))
        elif in_class:
            body += ch
        elif fold and _folded(ch):
            ch = f"[{ch}{_folded(ch)}]"
        out.append(ch)
    java = "".join(out)
    return f"{flags}(?<!{_WORD}){java}(?!{_WORD})" if word else flags + java


MOST_BRANCHES = 6


def trie(literals: list[str]) -> str:
    """A pattern for the longest of ``literals`` at a place, whose branches differ in their first character."""
    escaped = {c: re.escape(c) for x in literals for c in x}

    def node(rest: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for x in rest:
            if x:
                by_first.setdefault(x[0], []).append(x[1:])
        firsts = sorted(by_first)
        branches = [escaped[c] + node(by_first[c]) for c in firsts]
        if not branches:
            return ""
        if len(branches) > MOST_BRANCHES:  # one look at a class spares a place the branches of the others
            parts = [slice(n, n + MOST_BRANCHES) for n in range(0, len(branches), MOST_BRANCHES)]
            branches = [f"(?=[{''.join(escaped[c] for c in firsts[p])}])(?:{'|'.join(branches[p])})" for p in parts]
        whole = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{whole})?" if "" in rest else whole

    return node(sorted(set(literals)))
