"""Format-preserving pseudonyms for personal numbers, dates and addresses of mail.

Found are addresses of mail, IPv4 addresses (octets up to 255), bank accounts (IBAN, remainder 1 of
97), payment cards (13 to 19 digits that pass the Luhn test), United States social security numbers,
telephone numbers and calendar dates from 1900 to 2099. Each is written as a pair of numbers within
radices given by its format and permuted by a keyed Feistel network: in turns, a keyed hash of one
number is added to the other. A shift between the network and its inverse leaves no value as it was.
The result has the same format and passes the same test: letters stay letters (of the same case),
digits digits, separators stay, check digits are computed anew. Equal values get equal pseudonyms in
every document, different values different ones, and the key alone decides.

Of a mail address the part before the @ changes (letters A-Z and digits of it; other letters stay, so a
part without any of A-Z and digits stays whole), of a telephone number all but the country code, or the 0
and the digit after it, of an IBAN the digits after the check digits. Social security numbers with spaces
or without separators are found after their name, IBANs in small letters at their country's length.
Numbers that fail their test stay. Null texts stay null, with counts of 0; texts of any length are rewritten whole. All expressions
are Spark's own. Columns other than the text stay; added columns replace columns of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("mail", "iban", "ip", "date", "ssn", "phone", "card")
ROUNDS = 10
#: Characters of a value that one network permutes.
CHUNK = 24
FIRST_DAY, DAYS = "1900-01-01", (319, 229)  # 319 * 229 days end on 2099-12-31

#: Length of an account number -> countries that use it; numbers of other countries may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
_COMPACT = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
_SPACED = "|".join(
    f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in IBAN_LENGTHS.items())
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: What may stand between two digits of a telephone number.
_BETWEEN = (r"(?:[ .-](?=[0-9]{2})|(?<=\+[0-9]{1,3})[ .-](?=[0-9])|(?<=\+[0-9]{1,3})[ .-]?\((?=[0-9]{1,5}\))"
            r"|(?<=\([0-9]{1,5})\)[ .-]?)")
_BARE_SSN = r"(?!000|666|9)[0-9]{3}(?: (?!00)[0-9]{2} (?!0000)|(?!00)[0-9]{2}(?!0000))[0-9]{4}"
#: One pattern for each kind, tried in this order at every place. All repeats are bounded.
PATTERNS = {
    # a name starts at a letter or digit, whatever sign stands before it
    "mail": r"(?<![\p{L}\p{M}0-9])[\p{L}0-9][\p{L}\p{M}0-9._%+-]{0,63}@[\p{L}\p{M}0-9-]{1,63}(?:\.[\p{L}\p{M}0-9-]{1,63}){1,8}",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Za-z]{{2}}[0-9]{{2}} )(?i:{_SPACED})(?![A-Za-z0-9])"
            rf"|(?<![A-Za-z0-9])(?=[a-z]{{2}}[0-9]{{2}}[a-z0-9])(?i:{_COMPACT})(?![A-Za-z0-9])"
            r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"
            r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}"
            r"|(?:19|20)[0-9]{2}\.[0-9]{2}\.[0-9]{2}"
            r"|(?:19|20)[0-9]{2}\.[0-9]{2}\.[0-9]{2}"
            r"|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}"
            r"|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
           # its name before it
           rf"|(?<=(?<![A-Za-z])(?i:ssn|social security|social security number|social security no)[.:#]{{0,2}} {{0,2}}(?:is )?)(?:{_BARE_SSN})(?![0-9A-Za-z]|[ .-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])"
             # groups of any length, as many as make 8 to 15 digits; brackets and single digits after the country code
             rf"|(?<![0-9A-Za-z+])\+[0-9](?:{_BETWEEN}?[0-9]){{7,14}}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z.+-])(?:1[ .-])?[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
             # within a country: a 0, the area and one or two groups, or pairs of digits
             r"|(?<![0-9A-Za-z.,+/-])0[1-9](?:[0-9]{1,4}[ /-][0-9]{5,9}|[0-9]{1,4}[ /-][0-9]{3,4}[ -][0-9]{3,5}"
             r"|(?:[ .-][0-9]{2}){4})(?![0-9A-Za-z]|[.,/-][0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){3}"
            r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a match looks like where nothing stands around it.
SHAPES = {**PATTERNS, "ssn": f"{PATTERNS['ssn']}|{_BARE_SSN}"}


def _text(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """The body with a name for a value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


class Network:
    """SQL of the keyed permutation of (l, r) within radices (a, b)."""

    def __init__(self, key: str):
        self.key = key

    def _hash(self, tweak: str, turn: str, x: str) -> str:
        digest = f"sha2(concat_ws('|', {_text(self.key)}, {tweak}, {turn}, {x}), 256)"
        return f"CAST(conv(substring({digest}, 1, 15), 16, 10) AS BIGINT)"

    def _turns(self, state: str, tweak: str, a: str, b: str, back: bool) -> str:
        order, sign = (f"sequence({ROUNDS - 1}, 0)", "-") if back else (f"sequence(0, {ROUNDS - 1})", "+")
        move = lambda x, y, m: f"pmod(s.{x} {sign} pmod({self._hash(tweak, 'i', f's.{y}')}, {m}), {m})"
        return (f"aggregate({order}, {state}, (s, i) -> IF(i % 2 = 0, "
                f"named_struct('l', {move('l', 'r', a)}, 'r', s.r), "
                f"named_struct('l', s.l, 'r', {move('r', 'l', b)})))")

    def permuted(self, tweak: str, l: str, r: str, a: str, b: str) -> str:  # noqa: E741
        """There, a step along the first number, and back: no pair stays."""
        step = f"(1 + pmod({self._hash(tweak, _text('step'), a)}, {a} - 1))"
        there = self._turns(f"named_struct('l', CAST({l} AS BIGINT), 'r', CAST({r} AS BIGINT))", tweak, a, b, False)
        moved = _let("t", there, f"named_struct('l', pmod(t.l + {step}, {a}), 'r', t.r)")
        return self._turns(moved, tweak, a, b, True)


_RADIX = "IF({c} RLIKE '[0-9]', 10L, 26L)"
_VALUE = "CAST(IF({c} RLIKE '[0-9]', ascii({c}) - 48, ascii(lower({c})) - 97) AS BIGINT)"


def _radix(chars: str) -> str:
    return f"aggregate({chars}, 1L, (p, c) -> p * {_RADIX.format(c='c')})"


def _number(chars: str) -> str:
    return f"aggregate({chars}, 0L, (p, c) -> p * {_RADIX.format(c='c')} + {_VALUE.format(c='c')})"


def _written(chars: str, x: str) -> str:
    """The number in the classes and cases of these characters."""
    one = ("CASE WHEN c RLIKE '[0-9]' THEN char(48 + q.x % 10) WHEN c RLIKE '[A-Z]' THEN char(65 + q.x % 26) "
           "ELSE char(97 + q.x % 26) END")
    return (f"aggregate(reverse({chars}), named_struct('x', {x}, 'out', ''), (q, c) -> "
            f"named_struct('x', q.x DIV {_RADIX.format(c='c')}, 'out', concat({one}, q.out))).out")


def _permuted_text(network: Network, kind: str, v: str) -> str:
    """v with its ASCII letters and digits permuted in their places."""
    chars = "filter(split(v0, ''), c -> c RLIKE '^[A-Za-z0-9]$')"
    part = (f"transform(sequence(0, greatest(0, (size(cs) - 1) DIV {CHUNK})), k -> "
            + _let("part", f"slice(cs, {CHUNK} * k + 1, {CHUNK})", _let(
                "x", "slice(part, 1, (size(part) + 1) DIV 2)", _let(
                    "y", "slice(part, (size(part) + 1) DIV 2 + 1, size(part))", _let(
                        "ab", f"named_struct('a', {_radix('x')}, 'b', {_radix('y')})", _let(
                            "z", network.permuted(f"concat_ws(',', {_text(kind)}, k, ab.a, ab.b)", _number("x"), _number("y"), "ab.a", "ab.b"),
                            f"concat({_written('x', 'z.l')}, {_written('y', 'z.r')})"))))) + ")")
    fresh = _let("cs", chars, f"IF(size(cs) = 0, '', array_join({part}, ''))")
    filled = ("aggregate(split(v0, ''), named_struct('rest', fresh, 'out', ''), (f, c) -> IF(c RLIKE '^[A-Za-z0-9]$', "
              "named_struct('rest', substring(f.rest, 2), 'out', concat(f.out, substring(f.rest, 1, 1))), "
              "named_struct('rest', f.rest, 'out', concat(f.out, c)))).out")
    return _let("v0", v, _let("fresh", fresh, filled))


_DIGITS = "filter(split({v}, ''), c -> c RLIKE '^[0-9]$')"
_LUHN = ("aggregate(reverse(" + _DIGITS + "), named_struct('i', 0, 'sum', 0L), (u, c) -> named_struct('i', u.i + 1, 'sum', "
         "u.sum + IF(u.i % 2 = 0, (2 * CAST(c AS INT)) DIV 10 + (2 * CAST(c AS INT)) % 10, CAST(c AS INT)))).sum")


def _check_digit(v: str) -> str:
    return f"CAST(pmod(-({_LUHN.format(v=v)}), 10) AS STRING)"


def _mod97(v: str) -> str:
    """Remainder of an IBAN without spaces."""
    return (f"aggregate(split(concat(substring({v}, 5), substring({v}, 1, 4)), ''), 0, (p, c) -> "
            "CASE WHEN c RLIKE '^[0-9]$' THEN (10 * p + CAST(c AS INT)) % 97 "
            "WHEN c RLIKE '^[A-Z]$' THEN (100 * p + ascii(c) - 55) % 97 ELSE p END)")


def _rules(key: str) -> dict[str, tuple[str, str]]:
    """kind -> (test of a match m, its pseudonym)."""
    network = Network(key)
    mail = "concat(" + _let("v", "regexp_extract(m, '^[^@]+', 0)", _permuted_text(network, "mail", "v")) + ", regexp_extract(m, '@.*$', 0))"
    octets = "transform(split(m, '[.]'), o -> CAST(o AS BIGINT))"
    ip = _let("o", octets, _let(
        "z", network.permuted("'ip'", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536L", "65536L"),
        "concat_ws('.', z.l DIV 256, z.l % 256, z.r DIV 256, z.r % 256)"))
    plain = "upper(regexp_replace(m, ' ', ''))"
    body = _let("v", "substring(m, 5)", _digits_only(network, "iban"))
    iban = _let("w", body, _let("p", "upper(regexp_replace(w, ' ', ''))",
                f"concat(substring(m, 1, 2), lpad(CAST(98 - {_mod97('concat(upper(substring(m, 1, 2)), concat(' + _text('00') + ', p))')} AS STRING), 2, '0'), w)"))
    # year, month and day stand where the separators say; day first, unless only month first is a date
    fields = "transform(split(m, '[./-]'), x -> CAST(x AS INT))"
    last_day = ("element_at(array(31, IF(y % 4 = 0 AND (y % 100 != 0 OR y % 400 = 0), 29, 28), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), mo)")
    valid = lambda y, mo, d: (f"({mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND {last_day.replace('mo)', f'greatest(1, least(12, {mo})))').replace('y %', f'{y} %')})")
    order = ("CASE WHEN length(regexp_extract(m, '^[0-9]+', 0)) = 4 THEN IF(" + valid("g[0]", "g[1]", "g[2]") + ", 'ymd', '') "
             "WHEN " + valid("g[2]", "g[1]", "g[0]") + " THEN 'dmy' WHEN " + valid("g[2]", "g[0]", "g[1]") + " THEN 'mdy' ELSE '' END")
    date_test = _let("g", fields, f"({order}) != ''")
    day = ("CASE o WHEN 'ymd' THEN make_date(g[0], g[1], g[2]) WHEN 'dmy' THEN make_date(g[2], g[1], g[0]) "
           "ELSE make_date(g[2], g[0], g[1]) END")
    number = f"CAST(datediff({day}, DATE'{FIRST_DAY}') AS BIGINT)"
    a, b = DAYS
    date = _let("g", fields, _let("o", order, _let("n", number, _let(
        "z", network.permuted("'date'", f"n DIV {b}", f"n % {b}", f"{a}L", f"{b}L"), _let(
            "t", f"date_add(DATE'{FIRST_DAY}', CAST(z.l * {b} + z.r AS INT))",
            "date_format(t, concat(CASE o WHEN 'ymd' THEN 'yyyy-MM-dd' WHEN 'dmy' THEN 'dd-MM-yyyy' ELSE 'MM-dd-yyyy' END))")))))
    date = _let("s", date, "concat_ws(regexp_extract(m, '[./-]', 0), split(s, '-'))")
    part = lambda first, n: f"CAST(substring(n, {first}, {n}) AS INT)"
    ssn = _let("n", "regexp_replace(m, '[ -]', '')", _let("z", network.permuted(
        "'ssn'", f"{part(1, 3)} - IF({part(1, 3)} > 666, 2, 1)", f"({part(4, 2)} - 1) * 9999 + {part(6, 4)} - 1", "898L", "989901L"),
        "concat_ws(regexp_extract(m, '[ -]', 0), lpad(CAST(z.l + IF(z.l >= 665, 2, 1) AS STRING), 3, '0'), "
        "lpad(CAST(z.r DIV 9999 + 1 AS STRING), 2, '0'), lpad(CAST(z.r % 9999 + 1 AS STRING), 4, '0'))"))
    code = r"'^(?:\\+[0-9]{1,3}(?=[ .(-])|\\+[0-9]|1(?=[ .-])|0[1-9])'"
    phone = f"concat(regexp_extract(m, {code}, 0), " + _let("v", f"regexp_replace(m, {code}, '')", _permuted_text(network, "phone", "v")) + ")"
    card = _let("w", _let("v", "substring(m, 1, length(m) - 1)", _permuted_text(network, "card", "v")), f"concat(w, {_check_digit('w')})")
    return {
        "mail": ("true", mail),
        "iban": (f"length({plain}) BETWEEN 15 AND 34 AND " + _let("p", plain, f"{_mod97('p')} = 1"), iban),
        "ip": ("true", ip),
        "date": (date_test, date),
        "ssn": ("true", ssn),
        "phone": ("length(regexp_replace(m, '[^0-9]', '')) BETWEEN 8 AND 15", phone),
        "card": (f"{_check_digit('substring(m, 1, length(m) - 1)')} = right(m, 1)", card),
    }


def _digits_only(network: Network, kind: str) -> str:
    """v with its digits permuted; letters stay."""
    fresh = _permuted_text(network, kind, "regexp_replace(v, '[^0-9]', '')")
    return _let("d", fresh, "aggregate(split(v, ''), named_struct('rest', d, 'out', ''), (f, c) -> IF(c RLIKE '^[0-9]$', "
                "named_struct('rest', substring(f.rest, 2), 'out', concat(f.out, substring(f.rest, 1, 1))), "
                "named_struct('rest', f.rest, 'out', concat(f.out, c)))).out")


def findings(text: str, key: str) -> Column:
    """array<struct<kind, value, pseudonym>> of every match, in text order; kind is null where the
    value failed its test and stays."""
    rules = _rules(key)
    kind = "CASE " + " ".join(
        f"WHEN m RLIKE {_text('^(?:' + SHAPES[k] + ')$')} THEN IF({test}, '{k}', NULL)" for k, (test, _) in rules.items()) + " END"
    pseudonym = "CASE kind " + " ".join(f"WHEN '{k}' THEN {new}" for k, (_, new) in rules.items()) + " ELSE m END"
    one = _let("kind", kind, f"named_struct('kind', kind, 'value', m, 'pseudonym', {pseudonym})")
    return F.expr(f"transform(regexp_extract_all(`{text}`, {_text(ANY)}, 0), m -> {one})")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "findings") -> DataFrame:
    """The documents with the text rewritten, and the findings it was rewritten by."""
    none = "array<struct<kind:string,value:string,pseudonym:string>>"
    # texts without a digit hold nothing to find
    with_found = docs.withColumn(found, F.when(F.col(text).rlike("[0-9]|@"), findings(text, key)).otherwise(F.array().cast(none)))
    rewritten = F.expr(f"array_join(zip_with(split(`{text}`, {_text(ANY)}, -1), transform(`{found}`, x -> x.pseudonym), "
                       "(gap, new) -> concat(gap, coalesce(new, ''))), '')")
    return with_found.withColumn(text, F.when(F.size(found) > 0, rewritten).otherwise(F.col(text)))


def counts(found: str = "findings") -> list[Column]:
    """The number of rewritten values of each kind."""
    return [F.expr(f"size(filter(`{found}`, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
