"""Forms of rule and function patterns that look at every character a bounded number of times.

``java.util.regex`` tries a pattern anew at every place. ``HEAD.*TAIL`` with many heads and no tail
thus takes quadratic time. Whether there is a match is decided by the first head alone: a tail behind
any head is behind the first. A head with a tail before the next stop character is likewise decided
by the first head of each stretch without stop characters. An atomic group keeps the first head.
"""

from __future__ import annotations

from codestrata import fixed_values as fv


def then(head: str, tail: str) -> str:
    """HEAD.*TAIL"""
    return rf"(?i)\A(?>.*?(?:{head})).*?(?:{tail})"


def before(stop: str, head: str, tail: str, fold: bool = True) -> str:
    """HEAD[^stop]*TAIL, where neither head nor what stands before the tail holds a stop character."""
    return f"{'(?i)' if fold else ''}(?:\\A|[{stop}])(?>[^{stop}]*?(?:{head}))[^{stop}]*?(?:{tail})"


def _either(*patterns: str) -> str:
    return "(?i)(?:" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns) + ")"


_CLOSE = r")"
_DOM = r"(?:innerHTML|outerHTML|document\.write)\s*(?:=|\()"
_RANDOM = r"(?:iv|nonce|salt)\s*[:=]\s*"
_RSA = r"(?:rsa\.GenerateKey|RSA\.generate)\s*\("

_SECRET = {
    11: r"""(?i)(?:\A|[\s"'])(?>[^\s"']*?(?:mongodb|postgres|mysql|redis|amqp|mssql)://)[^\s"']+@[^\s"']""",
    12: then(r"(?:user|username)[:=]\w", r"(?:pass|password)[:=]\w"),
    13: r"(?:\A|[^A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10}",
}
_INJECTION = {
    1: then(r"""fmt\.Sprintf|format|f"|%s|%v""", r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE)\s"),
    2: then(r"""["']\s*\+\s*\w+\s*\+\s*["']""", r"(?:WHERE|AND|OR|SET|VALUES)\s"),
    4: then(r"""\.raw\s*\(\s*f?["']""", r"\{"),
    5: before(_CLOSE, r"exec\.Command\(", r"\+", fold=False),
    6: before(_CLOSE, r"os\.system\(", r"""\+|%|format|f\"""", fold=False),
    7: before(_CLOSE, r"subprocess\.(?:call|run|Popen)\(", r"shell\s*=\s*True", fold=False),
    8: before(_CLOSE, r"(?:child_process\.exec|execSync)\(", r"\+", fold=False),
    9: before(_CLOSE, r"\beval\s*\(", r"""\+|format|f"|%s|\$\{""", fold=False),
    11: _either(_DOM + r"\s*(?:\$\{|`)", before("\"'", _DOM, r"\+")),
    12: _either(r"\.html\(\s*\$\{", before("\"'", r"\.html\(", r"\+")),
    15: before(_CLOSE, r"(?:os\.(?:Open|ReadFile|Create|Remove)|ioutil\.ReadFile|open)\(",
               r"""\+|format|Sprintf|f"|%s|\$\{"""),
    17: before(_CLOSE, r"(?:sendFile|serveFile|send_file|serve_file)\(", r"""\+|format|f\""""),
    18: before(_CLOSE, r"(?:http\.Get|http\.Post|requests\.get|requests\.post|fetch|axios|urllib)\s*\(",
               r"""\+|format|f"|%s|\$\{"""),
    19: before(_CLOSE, r"(?:net\.Dial|net\.DialTimeout|socket\.connect)\(", r"""\+|format|f\""""),
    21: r"(?i)(?:\A|,)(?>[^,]*?json\.Unmarshal\()[^,]+,\s*(?:interface\{\}|any)",
}
_CRYPTO = {
    7: then(r"\bBlowfish\b", "New|Cipher|Encrypt"),
    9: _either(_RANDOM + r"""b["'][^})"']*(?:\}|["']\))""",
               before("})\"'", _RANDOM + r"(?:\[\]byte\{|bytes\()", r"""\}|["']\)""")),
    12: rf"(?i)(?:\A|,)(?>[^,]*?{_RSA})(?:[^,]*?(?:1024|512)\s*\)|[^,]*+,\s*(?:1024|512)\s*\))",
}
_AUTH = {
    2: then(r"(?://|#)\s*(?:TODO|FIXME|HACK)", "auth|login|password|security|csrf|cors"),
    3: then("cors", r"\*|AllowAll|allow_all"),  # a star behind allowOrigin is one behind cors
    4: then(r"(?:fmt\.Printf|print|console\.log|log\.Print)\s*\(", "password|secret|token|key|credential"),
    7: then(r"\.(?:env|pem|key|pfx|p12|jks)\b", "=|open|read|load"),
}
#: Pattern of a rule -> the form that tells in linear time whether it matches.
LINEAR = {
    rules[n - 1].pattern: form
    for rules, forms in ((fv.SECRET_RULES, _SECRET), (fv.INJECTION_RULES, _INJECTION),
                         (fv.CRYPTO_RULES, _CRYPTO), (fv.AUTH_RULES, _AUTH))
    for n, form in forms.items()
}

_MODIFIERS = r"(?:public|private|protected|static)"
#: Function pattern -> [(form, group of the name)], tried in order. Repeats of the modifiers are
#: possessive: as plain groups they take a stack frame for each. A type or name may itself be a
#: modifier word, hence the three forms for patterns that want one before the name.
FUNCTION_FORMS = {
    fv.FUNCTION_PATTERNS["Java"][0]: [
        (rf"^(?:{_MODIFIERS}++\s++)++\w+\s+(\w+)\s*\(", 1),
        (rf"^(?:{_MODIFIERS}++\s++){{2,}}+(\w+)\s*\(", 1),
        (rf"^(?:{_MODIFIERS}++\s++(?!\()){{2,}}+({_MODIFIERS}++)\s++\(", 1),
    ],
    fv.FUNCTION_PATTERNS["PHP"][0]: [(rf"^(?:{_MODIFIERS}|\s)*+function\s+(\w+)\s*\(", 1)],
}
