"""Format-preserving pseudonyms for personal data (operator 6), in SQL expressions only.

E-mail addresses, payment card numbers (Luhn-valid), phone numbers, IPv4
addresses, US social security numbers (of valid areas) and calendar dates are
found, validated and replaced by keyed Feistel permutations of their own
format: a card stays a Luhn-valid card of its length and grouping, a date a
valid date in its notation, a letter a letter.  A date with slashes is read
as day/month; where that is no calendar day, as month/day, and it becomes one
of the days that are read so too.  A phone number has ten digits grouped 3-3-4,
or a plus sign, 8 to 15 digits and any grouping; its country code stays.
Digits that follow such a number in a grouping of its own kind are taken as
part of it.  The permutation depends on the
key and the kind only, so equal values get equal pseudonyms in all documents
and different values of one format stay different.  Anything that fails its
validation is left alone.

One narrow pass: the text is split at the matches and put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feistel rounds; even, so that both halves end where they began.
ROUNDS = 8
#: Days of 400 Gregorian years from FIRST_DAY: 146097 = 189 * 773.
FIRST_DAY = "1800-01-01"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GAP = r"[ ./\x{A0}\x{202F}\x{2011}-]"
#: After a plus sign: a card, a date, an address or a social security number.
_NO_PHONE = rf"\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}}(?!\d)|\d{{4}}[ -]\d{{6}}[ -]\d{{5}}(?!\d)|\d{{4}}([-/])\d\d\1\d\d(?!\d)|\d\d([./])\d\d\2\d{{4}}(?!\d)|\d{{3}}-\d\d-\d{{4}}(?!\d)|(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
#: Country codes of one and of two digits; all others have three.
_CODES = (r"^[17]", r"^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
#: Every pattern can only start at the start of its run of characters, and its
#: runs are possessive or of bounded length: matching is linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "date": r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/-]|\.\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
             rf"|(?<![\p{{L}}\d+])\+(?!{_NO_PHONE})\(?[1-9](?:(?:{_GAP}?\(|\){_GAP}?|{_GAP})?\d){{7,14}}(?!\d)",
    "card": r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\d])",
}
ANY = "|".join(PATTERNS.values())


def _q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Character ranges that a permutation stays in: digits, ASCII letters, Latin-1 letters (fixed values: first code, count).
_RANGES = ((48, 10), (65, 26), (97, 26), (192, 23), (216, 7), (223, 24), (248, 8))


def _shifted(x: str, digest: str) -> str:
    """Each character of x moved inside its range by the next 16 bits of the digest (repeated after 16 characters)."""
    step = f"CAST(conv(substr({digest}, 1 + 4 * (fi % 16), 4), 16, 10) AS INT)"
    cases = " ".join(f"WHEN ascii(fc) BETWEEN {lo} AND {lo + n - 1} THEN chr({lo} + (ascii(fc) - {lo} + {step}) % {n})" for lo, n in _RANGES)
    return f"array_join(transform(split({x}, ''), (fc, fi) -> CASE {cases} ELSE fc END), '')"


def permuted_text(x: str, key: str, kind: str) -> str:
    """Feistel over characters: halves by position; each round moves one half's characters by a digest of the other."""
    digest = f"sha2(concat_ws('|', {_q(key)}, {_q(kind)}, CAST(fr AS STRING), CAST(length(fs.a) AS STRING), fs.b), 256)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({x}, 1, CAST(floor(length({x}) / 2) AS INT)), "
        f"'b', substr({x}, 1 + CAST(floor(length({x}) / 2) AS INT))), "
        f"(fs, fr) -> named_struct('a', fs.b, 'b', {_shifted('fs.a', digest)}), fs -> concat(fs.a, fs.b))"
    )


def permuted_number(left: str, right: str, a: int | str, b: int | str, key: str, kind: str) -> str:
    """Feistel over a pair (left modulo a, right modulo b); gives struct(l, r)."""
    def moved(x: str, n: int, by: str, side: str) -> str:
        digest = f"sha2(concat_ws('|', {_q(key)}, {_q(kind)}, {_q(side)}, CAST(fr AS STRING), CAST({by} AS STRING)), 256)"
        return f"(({x} + CAST(conv(substr({digest}, 1, 12), 16, 10) AS BIGINT)) % {n})"

    # l first, then r by the new l.
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (fs, fr) -> "
        f"aggregate(array({moved('fs.l', a, 'fs.r', 'l')}), named_struct('l', CAST(0 AS BIGINT), 'r', CAST(0 AS BIGINT)), (fy, fn) -> "
        f"named_struct('l', fn, 'r', {moved('fs.r', b, 'fn', 'r')})))"
    )


def _let(name: str, value: str, body: str) -> str:
    """The string body with name bound to value, evaluated once."""
    return f"aggregate(array({value}), CAST(NULL AS STRING), (z_{name}, {name}) -> {body})"


def _luhn(digits: str, double_first: bool) -> str:
    """Luhn sum from the right; double_first doubles the rightmost digit (for a number without its check digit)."""
    odd = 0 if double_first else 1
    value = "CAST(lc AS INT)"
    return (f"aggregate(transform(split(reverse({digits}), ''), (lc, li) -> IF(li % 2 = {odd}, "
            f"IF({value} > 4, {value} * 2 - 9, {value} * 2), {value})), 0, (ls, lx) -> ls + lx)")


def _in_place(old: str, new: str, first: str = "0") -> str:
    """The digits of ``old``, after the first few, replaced in order by those of ``new``; other characters stay."""
    at = f"(length(regexp_replace(substr({old}, 1, pi + 1), '[^0-9]', '')) - {first})"
    return f"array_join(transform(split({old}, ''), (pc, pi) -> IF(pc BETWEEN '0' AND '9' AND {at} > 0, substr({new}, {at}, 1), pc)), '')"


def _card(key: str) -> str:
    body = permuted_text("substr(d, 1, length(d) - 1)", key, "card")
    check = f"CAST((10 - {_luhn('p', True)} % 10) % 10 AS STRING)"
    new = _let("p", body, f"concat(p, {check})")
    valid = f"IF({_luhn('d', False)} % 10 = 0, {_let('w', new, _in_place('m', 'w'))}, m)"
    return _let("d", "regexp_replace(m, '[^0-9]', '')", valid)


def _phone(key: str) -> str:
    """The national digits are permuted; a country code stays."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    code = f"IF(m LIKE '+%', CASE WHEN d RLIKE {_q(_CODES[0])} THEN 1 WHEN d RLIKE {_q(_CODES[1])} THEN 2 ELSE 3 END, 0)"
    new = permuted_text(f"substr(d, 1 + {code})", key, "phone")
    return _let("d", digits, _let("w", new, _in_place("m", "w", code)))


def _ip(key: str) -> str:
    """Each octet stays among the octets of as many digits, so the length stays too."""
    text = "split(m, '[.]')[{}]".format
    low = lambda k: f"element_at(array(0, 10, 100), length({text(k)}))"
    many = lambda k: f"element_at(array(10, 90, 156), length({text(k)}))"
    at = lambda k: f"(CAST({text(k)} AS BIGINT) - {low(k)})"
    new = permuted_number(f"({at(0)} * {many(1)} + {at(1)})", f"({at(2)} * {many(3)} + {at(3)})", f"({many(0)} * {many(1)})", f"({many(2)} * {many(3)})", key, "ip")
    octets = [f"CAST(v.{side} {op} {many(second)} + {low(k)} AS STRING)" for side, k, second, op in (("l", 0, 1, "DIV"), ("l", 1, 1, "%"), ("r", 2, 3, "DIV"), ("r", 3, 3, "%"))]
    return f"aggregate(array({new}), '', (z_v, v) -> concat_ws('.', {', '.join(octets)}))"


def _ssn(key: str) -> str:
    """898 areas (1 to 899 without 666) by 99 groups and 9999 serials."""
    area = "CAST(substr(m, 1, 3) AS BIGINT)"
    left = f"IF({area} > 666, {area} - 2, {area} - 1)"
    right = "((CAST(substr(m, 5, 2) AS BIGINT) - 1) * 9999 + CAST(substr(m, 8, 4) AS BIGINT) - 1)"
    new = permuted_number(left, right, 898, 989901, key, "ssn")
    text = ("concat_ws('-', lpad(CAST(IF(v.l >= 665, v.l + 2, v.l + 1) AS STRING), 3, '0'), "
            "lpad(CAST(v.r DIV 9999 + 1 AS STRING), 2, '0'), lpad(CAST(v.r % 9999 + 1 AS STRING), 4, '0'))")
    return f"aggregate(array({new}), '', (z_v, v) -> {text})"


def _late_day(key: str) -> str:
    """Month/day dates: the days of the 400 years after the 12th of a month, which are no day/month, are permuted among themselves.

    Such days are numbered on their own: 88497 = 9 * 9833.  The month of a
    number is among the five nearest to its share of the 4800."""
    first = f"(datediff(add_months(DATE'{FIRST_DAY}', {{0}}), DATE'{FIRST_DAY}') - 12 * {{0}})".format
    month = "((CAST(substr(m, 7, 4) AS INT) - 1800) * 12 + CAST(substr(m, 1, 2) AS INT) - 1)"
    number = f"({first(month)} + CAST(substr(m, 4, 2) AS INT) - 13)"
    new = permuted_number("(u % 9)", "(u DIV 9)", 9, 9833, key, "date month/day")
    near = "CAST(floor(j / 18.436875D) AS INT)"
    at = f"array_max(filter(sequence({near} - 2, {near} + 2), k -> {first('k')} <= j))"
    day = f"date_format(date_add(add_months(DATE'{FIRST_DAY}', k0), CAST(12 + j - {first('k0')} AS INT)), 'MM/dd/yyyy')"
    text = f"aggregate(transform(array({new}), v -> v.r * 9 + v.l), '', (z_j, j) -> {_let('k0', at, day)})"
    return _let("u", number, text)


def _date(key: str) -> str:
    """Dates of the 400 years from FIRST_DAY; others, and days that do not exist, stay.

    A date with slashes that is no day/month is read as month/day."""
    shape = "CASE WHEN m LIKE '____-%' THEN 'yyyy-MM-dd' WHEN m LIKE '____/%' THEN 'yyyy/MM/dd' WHEN m LIKE '__.%' THEN 'dd.MM.yyyy' ELSE 'dd/MM/yyyy' END"
    day = ("CASE WHEN substr(m, 5, 1) IN ('-', '/') THEN make_day(substr(m, 1, 4), substr(m, 6, 2), substr(m, 9, 2)) "
           "ELSE make_day(substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2)) END")
    day = day.replace("make_day(", "concat_ws('-', ")
    since = f"datediff(try_cast({{}} AS DATE), DATE'{FIRST_DAY}')".format
    new = permuted_number("(n % 189)", "(n DIV 189)", 189, 773, key, "date")
    text = f"aggregate(array({new}), '', (z_v, v) -> date_format(date_add(DATE'{FIRST_DAY}', CAST(v.r * 189 + v.l AS INT)), {shape}))"
    other = since("concat_ws('-', substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2))")
    late = f"IF(m LIKE '__/%' AND substr(m, 4, 2) > '12' AND {other} BETWEEN 0 AND 146096, {_late_day(key)}, m)"
    return _let("n", since(day), f"IF(n BETWEEN 0 AND 146096, {text}, {late})")


def _email(key: str) -> str:
    """Everything but the top-level domain is permuted, the local part and the domain each on its own."""
    local = permuted_text("substring_index(m, '@', 1)", key, "email-local")
    domain = "substring_index(m, '@', -1)"
    top = f"substring_index({domain}, '.', -1)"
    host = permuted_text(f"substr({domain}, 1, length({domain}) - length({top}) - 1)", key, "email-host")
    return f"concat({local}, '@', {host}, '.', {top})"


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of match m."""
    full = {k: _q(f"^(?:{p})$") for k, p in PATTERNS.items()}
    forms = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
    return "CASE " + " ".join(f"WHEN m RLIKE {full[k]} THEN {forms[k](key)}" for k in PATTERNS) + " ELSE m END"


def kind_of() -> str:
    """SQL for the kind of match m."""
    return "CASE " + " ".join(f"WHEN m RLIKE {_q(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS.items()) + " END"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", list_col: str = "pii") -> DataFrame:
    """``docs`` with the text column pseudonymised and, added as ``list_col``, array<struct<kind, value>> of what was put in.

    Null text stays null and empty text empty, both with an empty list.  All
    other columns and all rows, repeated ones too, pass through; an empty
    table gives an empty result.  A column of that name in the input is
    replaced; choose another name to keep it."""
    t = f"`{text_col}`"
    found = f"regexp_extract_all({t}, {_q(ANY)}, 0)"
    # Only texts with a digit or an at sign can hold a match.
    found = f"IF({t} RLIKE '[0-9@]', {found}, CAST(array() AS ARRAY<STRING>))"
    out = docs.withColumn(list_col, F.expr(f"transform({found}, m -> named_struct('old', m, 'kind', {kind_of()}, 'value', {pseudonym(key)}))"))
    between = f"split({t}, {_q(ANY)}, -1)"
    whole = f"array_join(transform({between}, (bt, bi) -> IF(bi < size(`{list_col}`), concat(bt, `{list_col}`[bi].value), bt)), '')"
    out = out.withColumn(text_col, F.expr(f"IF(coalesce(size(`{list_col}`), 0) < 1, {t}, {whole})"))
    changed = f"transform(filter(`{list_col}`, x -> x.old <> x.value), x -> named_struct('kind', x.kind, 'value', x.value))"
    return out.withColumn(list_col, F.expr(f"coalesce({changed}, CAST(array() AS ARRAY<STRUCT<kind: STRING, value: STRING>>))"))
