r"""PII pseudonyms: a keyed Feistel permutation within each value's format.

Found and validated: e-mail addresses, IPv4 addresses (octets to 255), IPv6
addresses, telephone numbers (grouped, or with a country code; a number or
address after a blank is not part of them), payment numbers (13 to 19 digits,
Luhn check, also in groups of 4-6-5), national numbers 3-2-4 (with hyphens or
blanks; area not 000, 666 or 9xx), IBANs (mod 97, also in groups of four),
calendar dates from 1900-01-01 on (73,170 days; others stay), and secrets after
token, key, secret or password (quoted, or of 12 and more characters with a
digit) and cloud key ids. What fails its validation stays.

A value maps to another of the same format by a Feistel network, which is a
bijection: equal values get equal pseudonyms in all documents, different ones
different pseudonyms. Spellings that differ in blanks, hyphens, dots and
brackets only are equal values: bare digits (and letters, in IBANs) are
permuted and put where they stood.

- Strings: characters at even and odd places take turns. Each is moved within
  its class (digits, small letters, capitals; others stay) by an amount drawn
  from SHA-256 over key, round and the other places.
- Payment numbers: all digits but the last, then the Luhn digit anew. IBANs:
  the part after the check digits, then these anew.
- IPv6: its 32 hexadecimal digits; the pseudonym is written in full.
- IPv4: two 16-bit halves. Dates: the day number as two digits of radix 271
  and 270, whose product is the size of the domain; dates that are valid only
  as day/month/year are walked until they are so again.

Only built-in functions: texts without a digit or @ pass unread by the long
pattern; others are split at the matches, and only matches are transformed.
Row by row, so there is no shuffle and no skew.

Defined results: a null text stays null, with a count of 0; an empty text
stays empty; repeated rows each get a row; an empty table gives an empty
result; other columns pass through, whatever their names; very long texts are
worked on whole (possessive patterns, no backtracking over long runs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of tests; a session's own, kept secret, is read from KEY_SETTING.
KEY, ROUNDS = "bandscan", 8
KEY_SETTING = "spark.bandscan.pii.key"

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}+"
_SECRET = r"(?i:token|api[_-]?key|secret|password)\s{0,3}[=:]\s{0,3}(?:\"[!#-~]{8,}+\"|(?=[A-Za-z_+/=-]{0,200}[0-9])[A-Za-z0-9_+/=-]{12,}+)"
_CLOUD = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,20}}[0-9]){_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:]|[.][0-9])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
_NATIONAL = r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9]|[ -][0-9]))"
#: A number written without breaks is complete by itself; else country, area and two groups, and a third one
#: only if it is joined on: without a blank, or as a pair after a pair ("123 45 67"), so that what follows stays apart.
_THIRD = r"(?:-?[0-9]{2,4}|(?<=\.[0-9]{2,4})\.[0-9]{2,4}|(?<= [0-9]{2}) [0-9]{2}(?![./-]?[0-9]))?"
_AFTER_BLANK = r" (?![0-9]++(?:[./][0-9]|-[0-9]{2}-))[0-9]{2,4}"
_PHONE = (
    r"(?:\+(?:[0-9]{10,19}|[0-9]{1,3}[ .-][0-9]{8,16}|[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{2,4}"
    rf"(?:[.-]?[0-9]{{2,4}}|{_AFTER_BLANK}){_THIRD})|(?<![0-9(-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}})(?![0-9])"
)
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9])"
PATTERN = "|".join((_EMAIL, _SECRET, _CLOUD, _IBAN, _IP6, _IP, _DATE, _NATIONAL, _PHONE, _CARD))


def _let(name: str, value: str, body: str) -> str:
    """Evaluates value once and names it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _draw(key: str, what: str, start: str = "1") -> str:
    """A number below 2**28 from a keyed digest."""
    return f"cast(conv(substr(sha2(concat('{key}|', {what}), 256), {start}, 7), 16, 10) AS bigint)"


def _moved(c: str, by: str) -> str:
    spans = (("0", "9", 48, 10), ("a", "z", 97, 26), ("A", "Z", 65, 26))
    return "CASE " + " ".join(f"WHEN {c} >= '{lo}' AND {c} <= '{hi}' THEN chr({base} + (ascii({c}) - {base} + {by}) % {n})" for lo, hi, base, n in spans) + f" ELSE {c} END"


def string_feistel(x: str, key: str, rounds: int = ROUNDS) -> str:
    """SQL for the pseudonym of a string, each character within its class."""
    by = _draw(key, "concat(o, '|', i div 8)", "1 + 8 * (i % 8)")
    other = "concat(k, '|', size(s), '|', array_join(filter(s, (c, i) -> i % 2 != k % 2), ''))"
    step = _let("o", other, f"transform(s, (c, i) -> IF(i % 2 != k % 2, c, {_moved('c', by)}))")
    return f"array_join(aggregate(sequence(0, {rounds - 1}), regexp_extract_all({x}, '(?s).', 0), (s, k) -> {step}), '')"


def _filled(x: str, moved: str, kind: str = "0-9") -> str:
    """SQL: x with its characters of a kind replaced by those of moved, one after the other."""
    step = f"IF(c RLIKE '[{kind}]', named_struct('t', concat(a.t, substr(a.m, 1, 1)), 'm', substr(a.m, 2)), named_struct('t', concat(a.t, c), 'm', a.m))"
    return f"aggregate(regexp_extract_all({x}, '(?s).', 0), named_struct('t', '', 'm', {moved}), (a, c) -> {step}, a -> a.t)"


def hex_feistel(x: str, key: str, rounds: int = ROUNDS) -> str:
    """SQL for the pseudonym of a string of small hexadecimal digits."""
    by = _draw(key, "concat(o, '|', i div 8)", "1 + 8 * (i % 8)")
    moved = f"substr('0123456789abcdef', cast((instr('0123456789abcdef', c) - 1 + {by}) % 16 + 1 AS int), 1)"
    other = "concat(k, '|', array_join(filter(s, (c, i) -> i % 2 != k % 2), ''))"
    step = _let("o", other, f"transform(s, (c, i) -> IF(i % 2 != k % 2, c, {moved}))")
    return f"array_join(aggregate(sequence(0, {rounds - 1}), regexp_extract_all({x}, '.', 0), (s, k) -> {step}), '')"


def _halves(left: str, right: str, a: int, b: int, key: str, body: str, rounds: int = ROUNDS) -> str:
    """SQL: a Feistel network on two digits of radix a and b; body reads p.l and p.r."""
    step = f"IF(k % 2 = 0, named_struct('l', (q.l + {_draw(key, "concat(k, '|', q.r)")}) % {a}, 'r', q.r), named_struct('l', q.l, 'r', (q.r + {_draw(key, "concat(k, '|', q.l)")}) % {b}))"
    start = f"named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint))"
    return _let("p", f"aggregate(sequence(0, {rounds - 1}), {start}, (q, k) -> {step})", body)


def _luhn_sum(digits: str, first_doubled: bool) -> str:
    """The Luhn sum of a string of digits from its right end; whether the rightmost counts double."""
    d = f"cast(substr(reverse(n), j, 1) AS int) * IF(j % 2 = {1 if first_doubled else 0}, 2, 1)"
    return _let("n", digits, f"aggregate(sequence(1, length(n)), 0L, (t, j) -> t + ({d}) div 10 + ({d}) % 10)")


def _mod97(alnum: str) -> str:
    """A string of digits and capitals, the latter as 10 to 35, modulo 97."""
    step = "IF(c <= '9', (t * 10 + cast(c AS int)) % 97, (t * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(regexp_extract_all({alnum}, '.', 0), 0, (t, c) -> {step})"


def _date(x: str, fmt: str, key: str) -> str:
    """A date's pseudonym, null outside of the domain."""
    day = "datediff(d, DATE'1900-01-01')"
    moved = _halves(f"{day} div 270", f"{day} % 270", 271, 270, key, f"date_format(date_add(DATE'1900-01-01', cast(p.l * 270 + p.r AS int)), '{fmt}')")
    return _let("d", f"try_to_date({x}, '{fmt}')", f"IF({day} >= 0 AND {day} < 73170, {moved}, NULL)")


def pseudonym(x: str, key: str) -> str:
    """SQL for what takes the place of a match of PATTERN."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    local = f"regexp_extract({x}, '^(.*)\\\\.', 1)"
    email = f"concat({string_feistel(local, key + 'e')}, substr({x}, length({local}) + 1))"
    quoted = f"regexp_extract({x}, '\"(.*)\"', 1)"
    secret = f"concat(substr({x}, 1, instr({x}, '\"')), {string_feistel(quoted, key + 's')}, '\"')"
    bare = f"regexp_extract({x}, '[=:]\\\\s*(.*)$', 1)"
    unquoted = f"concat(substr({x}, 1, length({x}) - length({bare})), {string_feistel(bare, key + 's')})"
    cloud = f"concat('AKIA', {string_feistel(f'substr({x}, 5)', key + 'a')})"
    octets = _let("o", f"transform(split({x}, '[.]'), v -> cast(v AS int))", f"IF(array_max(o) <= 255, {_halves('o[0] * 256 + o[1]', 'o[2] * 256 + o[3]', 65536, 65536, key + 'i', "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)")}, {x})")
    kept = f"substr({digits}, 1, length({digits}) - 1)"
    card = _let("m", string_feistel(kept, key + "c"), f"concat(m, (10 - {_luhn_sum('m', True)} % 10) % 10)")
    card = f"IF(length({digits}) BETWEEN 13 AND 19 AND {_luhn_sum(digits, False)} % 10 = 0, {_filled(x, card)}, {x})"
    body = string_feistel("substr(n, 5)", key + "b")
    made = _let("m", body, f"concat(substr(n, 1, 2), lpad(98 - {_mod97("concat(m, substr(n, 1, 2), '00')")}, 2, '0'), m)")

    def iban_of(y: str) -> str:
        """The pseudonym of y, or null."""
        return _let("n", f"replace({y}, ' ', '')", f"IF({_mod97('concat(substr(n, 5), substr(n, 1, 4))')} = 1, {_filled(y, made, '0-9A-Z')}, NULL)")

    # the last group may be a word that follows
    shorter = f"regexp_replace({x}, ' [A-Z0-9]{{1,4}}$', '')"
    iban = f"coalesce({iban_of(x)}, IF({x} LIKE '% %', {_let('y', shorter, f'concat({iban_of("y")}, substr({x}, length(y) + 1))')}, NULL), {x})"
    groups = "filter(split(h, ':'), g -> g != '')"
    zeros = "array_repeat('0000', 8 - size(filter(split(h, ':'), g -> g != '')))"
    padded = "transform({0}, g -> lpad(g, 4, '0'))"
    split_at = "regexp_extract(h, '^(.*)::', 1)"
    left, right = (f"filter(split({side}, ':'), g -> g != '')" for side in (split_at, "regexp_extract(h, '::(.*)$', 1)"))
    whole = f"array_join(IF(h LIKE '%::%', concat({padded.format(left)}, {zeros}, {padded.format(right)}), {padded.format(groups)}), '')"
    ip6 = _let("h", f"lower({x})", _let("m", hex_feistel(whole, key + "6"), "array_join(transform(sequence(0, 7), g -> substr(m, 4 * g + 1, 4)), ':')"))
    national = f"IF({x} RLIKE '^(000|666|9)', {x}, {_filled(x, string_feistel(digits, key + 'n'))})"
    turned = f"concat(substr(w, 4, 3), substr(w, 1, 3), substr(w, 7))"
    walk = _date(turned, "MM/dd/yyyy", key + "d")
    again = f"aggregate(sequence(1, 64), {x}, (w, z) -> IF(z > 1 AND substr(w, 1, 2) > '12', w, {_let('y', walk, "coalesce(concat(substr(y, 4, 3), substr(y, 1, 3), substr(y, 7)), w)")}))"
    slashed = f"coalesce({_date(x, 'MM/dd/yyyy', key + 'd')}, {again})"
    cases = (
        (f"{x} LIKE '%@%' AND {x} NOT LIKE '%\"'", email), (f"{x} LIKE '%\"'", secret), (f"{x} RLIKE '^(?i:token|api|secret|password)'", unquoted),
        (f"{x} LIKE 'AKIA%' AND length({x}) = 20", cloud), (f"{x} RLIKE '^[0-9A-Fa-f]{{1,4}}:'", ip6), (f"{x} RLIKE '^[A-Z]'", iban),
        (f"{x} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'", octets),
        (f"{x} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'", f"coalesce({_date(x, 'yyyy-MM-dd', key + 'd')}, {x})"),
        (f"{x} RLIKE '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$'", slashed),
        (f"{x} RLIKE '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$'", f"coalesce({_date(x, 'dd.MM.yyyy', key + 'd')}, {x})"),
        (f"{x} RLIKE '^[0-9]{{3}}[ -][0-9]{{2}}[ -][0-9]{{4}}$'", national),
        (f"length({digits}) < 13 OR {x} LIKE '+%'", _filled(x, string_feistel(digits, key + "p"))),
    )
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases) + f" ELSE {card} END"


def session_key(docs: DataFrame) -> str:
    """The session's key, or that of tests."""
    return docs.sparkSession.conf.get(KEY_SETTING, KEY)


def masked(text: Column, key: str) -> tuple[Column, Column]:
    """The text with its personal values replaced, and how many were."""
    if "'" in key or "\\" in key:
        raise ValueError("the key may hold no quote and no backslash")
    some = text.rlike("[0-9@\"]")
    found = F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    parts = F.when(some, F.split(text, PATTERN, -1))
    return found, parts


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """The documents, all columns, with the text replaced; count_col, if given, gets how many values changed. key: None for the session's."""
    key = session_key(docs) if key is None else key
    found, parts = masked(F.col(f"`{text_col}`"), key)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), found.alias("found"), parts.alias("parts"))
    row = row.select("r", "found", "parts", F.when(F.size("found") > 0, F.expr(f"transform(found, x -> {pseudonym('x', key)})")).alias("new"))
    text = F.when(F.size("new") > 0, F.expr("array_join(transform(parts, (p, i) -> concat(p, coalesce(get(new, i), ''))), '')")).otherwise(F.col("r").getField(text_col))
    out = [text.alias(c) if c == text_col else F.col("r").getField(c).alias(c) for c in names]
    if count_col:
        out.append(F.coalesce(F.expr("size(filter(zip_with(found, new, (a, b) -> a != b), x -> x))"), F.lit(0)).cast("long").alias(count_col))
    return row.select(*out)
