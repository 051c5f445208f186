"""Format-preserving pseudonyms by keyed Feistel networks, in SQL expressions only.

Found values are validated (check digits, ranges, calendar) and permuted within their format, so a value gets
the same pseudonym in every document and in every notation, and a pseudonym is again a valid value. Everything
runs inside one projection: no shuffle, no Python.

The key comes from the setting ``KEY_SETTING``; it stands, hashed, in the plan as ``kinfold-key:`` and 64 hex digits, so
that ``spark.sql.redaction.string.regex`` can hide it in event logs and explanations.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.plans.runtime import table

#: Names the secret key. Without it each application draws a key of its own: values are linked within it, not beyond.
KEY_SETTING = "spark.kinfold.pseudonym.key"
ROUNDS = 8
#: Characters up to which a secret is permuted as two strings; longer ones go in pieces, in time linear in their length.
SHORT = 128

# Lengths of account numbers by country (ISO 13616), for those written with blanks.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# Beginnings of issued access tokens, which stay.
TOKEN_HEADS = r"A[KS]IA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza"
#: Words before a value that is a secret whatever it looks like, up to the value.
LABELLED = r"(?i:passwords?|passwd|pwd|api[_-]?key|access[_-]?key|secret|token)[\"']?+\s{0,3}+[=:]\s{0,3}+[\"']?+"

#: What is looked for, first match first. All runs are possessive and start at their first character, and no group repeats
#: without a bound but possessively, so scanning is linear and needs no stack, whatever the text is.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{18,}+(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2} [A-Z0-9]{4} )(?:" + "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\+[1-9](?:[ .()-]{0,2}+[0-9]){7,14}(?![0-9])|(?<![0-9A-Za-z+_]|[0-9][.,-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z_]|[.,-][0-9])",
}
# A labelled value that is of another kind is left to that kind, so that it has one pseudonym with and without a label.
PATTERNS["labelled"] = rf"(?<![A-Za-z0-9]){LABELLED}(?!{PATTERNS['email']}|{PATTERNS['secret']}|{PATTERNS['token']}|{PATTERNS['iban']}|[0-9+(][0-9 ()./-]*+(?![A-Za-z0-9_]))[^\s\"'<>,;]{{6,}}+"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def feistel_number(n: str, a: str, b: str, tweak: str) -> str:
    """SQL for a keyed permutation of 0 .. a*b-1 in rounds that change places: quotient (modulo a) and remainder (modulo b) each get a keyed number made from the other."""
    f = f"cast(conv(substr(sha2(concat({tweak}, '|', r, '|', s.q), 256), 1, 12), 16, 10) as bigint)"
    step = f"named_struct('p', s.q, 'q', pmod(s.p + {f}, if(r % 2 = 0, {a}, {b})))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('p', cast(({n}) div ({b}) as bigint), 'q', cast(pmod({n}, {b}) as bigint)), (s, r) -> {step}, s -> s.p * ({b}) + s.q)"


def _pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,20}}', 0)"


def feistel_string(text: str, tweak: str, letters: str = "26") -> str:
    """SQL for a keyed permutation of strings: digits stay digits, letters stay letters of their case, all else stays.

    The halves, in pieces of 20 characters, are vectors; each round adds a keyed stream made from one half (its hash, if
    it is long) to the other, each character modulo the size of its class, and changes their places. Classes do not
    change, so every round can be undone. Time is linear in the length.
    """
    k, c = "cast(conv(substr(z, 3 * i - 2, 3), 16, 10) as int)", "ascii(substr(h, i, 1))"
    turned = f"array_join(transform(sequence(1, length(h)), i -> case when {c} between 48 and 57 then char(48 + ({c} - 48 + {k}) % 10) when {c} between 97 and 96 + {letters} then char(97 + ({c} - 97 + {k}) % {letters}) when {c} between 65 and 90 then char(65 + ({c} - 65 + {k}) % 26) else substr(h, i, 1) end), '')"
    stream = f"substr(sha2(concat({tweak}, '|', r, '|', j, '|', o), 256), 1, 60)"
    added = _let("array_join(s.q, '')", "e", _let("if(length(e) > 64, sha2(e, 256), e)", "o", f"transform(s.p, (h, j) -> {_let(stream, 'z', turned)})"))
    start = f"named_struct('p', {_pieces(f'substr({text}, 1, length({text}) div 2)')}, 'q', {_pieces(f'substr({text}, length({text}) div 2 + 1)')})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> named_struct('p', s.q, 'q', {added}), s -> array_join(concat(s.p, s.q), ''))"


def permuted(text: str, tweak: str, letters: str = "26") -> str:
    """SQL for a keyed permutation of strings of any length: their digits and letters are permuted by class, all else stays in its place.

    A single digit or letter has no second half and is permuted as a number.
    """
    first = "named_struct('c', case when w between '0' and '9' then 48L when w between 'a' and 'z' then 97L else 65L end, 'n', case when w between '0' and '9' then 5L else 13L end)"
    single = _let(first, "f", f"char(f.c + {feistel_number('ascii(w) - f.c', '2L', 'f.n', tweak)})")
    # Strings of over SHORT characters have enough of them to be permuted where they stand.
    stripped = _let(f"if(length({text}) <= {SHORT}, regexp_replace({text}, '[^A-Za-z0-9]', ''), {text})", "w", _let(f"if(length(w) = 1, {single}, {feistel_string('w', tweak, letters)})", "u", f"if(length(u) = length({text}), u, {_refill(text, 'u', 'A-Za-z0-9')})"))
    return stripped


def _refill(form: str, chars: str, places: str = "0-9") -> str:
    """The characters ``chars`` one by one in those places of ``form`` that hold one of the class."""
    step = f"if(c rlike '[{places}]', named_struct('o', concat(s.o, substr({chars}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k))"
    return f"aggregate(regexp_extract_all({form}, '(?s).', 0), named_struct('o', '', 'k', 1), (s, c) -> {step}, s -> s.o)"


def _luhn(digits: str) -> str:
    """Sum of a digit string with every second digit from the right, beginning with the last but one, doubled."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _mod97(text: str) -> str:
    """Remainder of an account number whose first four characters stand last, letters counted from A = 10."""
    c = f"ascii(substr({text}, i, 1))"
    return f"aggregate(sequence(1, length({text})), 0L, (t, i) -> if({c} >= 65, (t * 100 + {c} - 55) % 97, (t * 10 + {c} - 48) % 97))"


def _valid_iban(w: str) -> str:
    """Remainder 1, and check digits as they are given out: 02 to 98."""
    return f"substr({w}, 3, 2) between '02' and '98' and {_mod97(f'concat(substr({w}, 5), substr({w}, 1, 4))')} = 1"


def _kind() -> str:
    """SQL for what a found value ``m`` is. Upper-case hex may look like an account number and is one only if its check digits are right."""
    hexadecimal = "m rlike '^[0-9A-Fa-f]{18,}$'"
    account = f"m rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' and {_valid_iban('m')}"
    tests = {
        "labelled": f"m rlike {_sql('^' + LABELLED)}",
        "email": "m like '%@%'",
        "token": f"m rlike {_sql('^(?:' + TOKEN_HEADS + ')')}",
        "iban": f"m rlike '^[A-Z]{{2}}' and (not {hexadecimal} or {account})",
        "ip": "m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$'",
        "date": "m rlike '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$'",
        "ssn": "m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'",
        "secret": f"{hexadecimal} and m rlike '[A-Fa-f]'",
        "phone": "m rlike '^[+(]' or m rlike '^([0-9]{3}[ .-][0-9]{3}[ .-]?[0-9]{4}|[0-9]{10})$'",
    }
    return "case " + " ".join(f"when {test} then '{name}'" for name, test in tests.items()) + " else 'card' end"


def _as_string(key: str) -> str:
    """SQL for (head, body, tail, tweak, letters) of a value whose ``body`` is permuted as a string; null for values of other kinds and invalid ones.

    What follows a token's head or a label is permuted, unless it is a plain word; of an address the part before the
    sign, lower-cased and apart for each domain; of a card all digits but the first and the last; of an account number
    what follows the check digits; of a phone number of fewer than ten digits all but the first.
    """
    struct = lambda head, body, tail, tweak, letters="26": f"named_struct('head', {head}, 'body', {body}, 'tail', {tail}, 'tweak', concat({key}, {tweak}), 'letters', {letters})"
    after = lambda rx: _let(f"regexp_extract(m, {_sql('^(?:' + rx + ')')}, 0)", "b", struct("b", "substr(m, length(b) + 1)", "''", "'secret'"))
    return f"""case k
      when 'labelled' then if(m rlike {_sql('^' + LABELLED + '[A-Za-z]++$')}, null, {after(LABELLED)})
      when 'token' then {after(TOKEN_HEADS)}
      when 'email' then {struct("''", "substring_index(lower(m), '@', 1)", "concat('@', substring_index(m, '@', -1))", "'email', lower(substring_index(m, '@', -1))")}
      when 'secret' then {struct("''", "lower(m)", "''", "'secret'", "6")}
      when 'iban' then {_let("replace(m, ' ', '')", "w", f"if({_valid_iban('w')}, {struct('substr(w, 1, 2)', 'substr(w, 5)', "''", "'iban', substr(w, 1, 2)")}, null)")}
      when 'card' then if({_luhn('d')} % 10 <> 0 or d rlike '^0', null, {struct('substr(d, 1, 1)', 'substr(d, 2, length(d) - 2)', "''", "'card', substr(d, 1, 1)")})
      when 'phone' then if(length(d) between 7 and 9, {struct('substr(d, 1, 1)', 'substr(d, 2)', "''", "'phone'")}, null) end"""


def _from_string() -> str:
    """SQL for the value again, from ``x`` (see above) and the permuted body ``p``: check digits are made right, digits and letters go where they were, letters of a secret get their case back."""
    upper = "transform(sequence(1, length(a)), i -> if(substr(a, i, 1) between 'A' and 'F', upper(substr(b, i, 1)), substr(b, i, 1)))"
    mixed = f"array_join(zip_with({_pieces('m')}, {_pieces('p')}, (a, b) -> array_join({upper}, '')), '')"
    account = _let("concat(x.head, lpad(98 - " + _mod97("concat(p, x.head, '00')") + ", 2, '0'), p)", "q", f"if(length(q) = length(m), q, {_refill('m', 'q', 'A-Z0-9')})")
    check = _let("concat(q, '0')", "g", f"(10 - {_luhn('g')} % 10) % 10")
    digits = _let("concat(x.head, p)", "q", _let(f"if(k = 'phone', q, concat(q, {check}))", "z", _refill("m", "z")))
    return f"case k when 'secret' then case when m = x.body then p when m = upper(x.body) then upper(p) else {mixed} end when 'iban' then {account} when 'card' then {digits} when 'phone' then {digits} else concat(x.head, p, x.tail) end"


def _as_number(key: str) -> str:
    """SQL for (n, a, b, tweak, d, form) of a value that is permuted as a number n below a * b; null for values of other kinds and invalid ones.

    Addresses: 65,536 x 65,536. Dates, day first where slashed (form 0): within their century, whose 36,524 or 36,525
    days are 92 x 397 or 75 x 487. Dates that can only be read month first are permuted among themselves: days to 28 with
    their month and year of the century (form 1; 120 x 160); later days keep day and month and get a year of the century
    (form 2; 10 x 10) or, for February 29, a leap year (form 3; 5 x 5 or 4 x 6). Social security numbers: 898 areas (001 to
    899 without 666), 99 groups, 9,999 serials. Of phone numbers the last ten digits: those of a North American number
    (area and exchange from 200 on; form 0) among themselves, 80,000 x 80,000, all others (form 1) too, 60,000 x 60,000.
    """
    struct = lambda n, a, b, tweak, d="cast(null as date)", form="0": f"named_struct('n', cast({n} as bigint), 'a', cast({a} as bigint), 'b', cast({b} as bigint), 'tweak', concat({key}, {tweak}), 'd', {d}, 'form', {form})"
    day = "if(m like '____-%', try_to_date(m, 'yyyy-MM-dd'), try_to_date(translate(m, '/', '.'), 'dd.MM.yyyy'))"
    dated = _let(f"named_struct('d', coalesce({day}, if(m like '%/%', try_to_date(m, 'MM/dd/yyyy'), null)), 'day', {day} is not null)", "e", _let("named_struct('y', year(e.d), 'c', year(e.d) div 100, 'f', case when e.day then 0 when day(e.d) <= 28 then 1 when month(e.d) <> 2 then 2 else 3 end)", "f", "if(e.d is null or f.y < 1, null, " + struct(
        "case f.f when 0 then datediff(e.d, make_date(f.c * 100, 1, 1)) when 1 then (f.y % 100 * 12 + month(e.d) - 1) * 16 + day(e.d) - 13 when 2 then f.y % 100 else f.y % 100 div 4 - if(f.c % 4 = 0, 0, 1) end",
        "case f.f when 0 then if(f.c % 4 = 0, 75, 92) when 1 then 120 when 2 then 10 else if(f.c % 4 = 0, 5, 4) end",
        "case f.f when 0 then if(f.c % 4 = 0, 487, 397) when 1 then 160 when 2 then 10 else if(f.c % 4 = 0, 5, 6) end",
        "case f.f when 0 then 'date' when 1 then 'month first' when 2 then 'year' else 'leap' end, f.c", "e.d", "f.f") + ")"))
    at = lambda a, n: f"cast(substr(m, {a}, {n}) as bigint)"
    ssn = f"if({at(1, 3)} in (0, 666) or {at(1, 3)} > 899 or {at(5, 2)} = 0 or {at(8, 4)} = 0, null, {struct(f'(({at(1, 3)} - if({at(1, 3)} > 666, 2, 1)) * 99 + {at(5, 2)} - 1) * 9999 + {at(8, 4)} - 1', '88902', '9999', "'ssn'")})"
    ten = lambda a, n: f"cast(substr(t, {a}, {n}) as bigint)"
    known = struct(f"((({ten(1, 1)} - 2) * 100 + {ten(2, 2)}) * 8 + {ten(4, 1)} - 2) * 1000000 + {ten(5, 6)}", "80000", "80000", "'phone'")
    other = struct(f"if({ten(1, 1)} < 2, cast(t as bigint), 2000000000 + ((({ten(1, 1)} - 2) * 100 + {ten(2, 2)}) * 2 + {ten(4, 1)}) * 1000000 + {ten(5, 6)})", "60000", "60000", "'phone0'", form="1")
    phone = _let("right(d, 10)", "t", f"if(t rlike '^[2-9][0-9]{{2}}[2-9]', {known}, {other})")
    address = _let("transform(split(m, '[.]'), x -> cast(x as bigint))", "o", f"if(array_max(o) > 255, null, {struct('o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]', '65536', '65536', "'ip'")})")
    return f"case k when 'ip' then {address} when 'date' then {dated} when 'ssn' then {ssn} when 'phone' then if(length(d) between 10 and 15, {phone}, null) end"


def _from_number() -> str:
    """SQL for the value again, from ``y`` (see above) and the permuted number ``v``."""
    address = "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)"
    written = "case when m like '____-%' then date_format(e, 'yyyy-MM-dd') when m like '%/%' then date_format(e, 'dd/MM/yyyy') else date_format(e, 'dd.MM.yyyy') end"
    c, month = "year(y.d) div 100", "concat(substr(m, 1, 6), lpad({c} * 100 + {y}, 4, '0'))"
    early = f"concat(lpad(v div 16 % 12 + 1, 2, '0'), '/', v % 16 + 13, '/', lpad({c} * 100 + v div 192, 4, '0'))"
    dated = f"case y.form when 0 then {_let(f'date_add(make_date({c} * 100, 1, 1), cast(v as int))', 'e', written)} when 1 then {early} when 2 then {month.format(c=c, y='v')} else {month.format(c=c, y=f'(v + if({c} % 4 = 0, 0, 1)) * 4')} end"
    area = "v div 989901"
    ssn = f"concat_ws('-', lpad({area} + if({area} >= 665, 2, 1), 3, '0'), lpad(v div 9999 % 99 + 1, 2, '0'), lpad(v % 9999 + 1, 4, '0'))"
    known = "concat(v div 800000000 + 2, lpad(v div 8000000 % 100, 2, '0'), v div 1000000 % 8 + 2, lpad(v % 1000000, 6, '0'))"
    other = "if(v < 2000000000, lpad(v, 10, '0'), concat((v - 2000000000) div 200000000 + 2, lpad((v - 2000000000) div 2000000 % 100, 2, '0'), (v - 2000000000) div 1000000 % 2, lpad((v - 2000000000) % 1000000, 6, '0')))"
    phone = _let(f"concat(substr(d, 1, length(d) - 10), if(y.form = 0, {known}, {other}))", "z", _refill("m", "z"))
    return f"case k when 'ip' then {address} when 'date' then {dated} when 'ssn' then {ssn} else {phone} end"


def found_sql(key: str) -> str:
    """SQL for (kind, value, pseudonym) of a found value ``m``; both permutations stand in it once, as every part of a plan costs the driver."""
    by_string = _let(permuted("x.body", "x.tweak", "x.letters"), "p", _from_string())
    by_number = _let(feistel_number("y.n", "y.a", "y.b", "y.tweak"), "v", _from_number())
    value = _let(_as_string(key), "x", _let(_as_number(key), "y", f"case when x is not null then {by_string} when y is not null then {by_number} else m end"))
    return _let("regexp_replace(m, '[^0-9]', '')", "d", _let(_kind(), "k", f"named_struct('kind', k, 'value', m, 'pseudonym', {value})"))


def pattern() -> str:
    """All patterns in one; back references are numbered on."""
    return "|".join(PATTERNS.values())


def session_key(spark: SparkSession) -> str:
    """The key that the session is configured with, else one drawn for this application, which is nowhere kept."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_drawn: dict[str, str] = {}


def pseudonymize(df: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with the values found in ``text`` replaced by their pseudonyms under ``key``.

    ``found`` names a further column: an array of (kind, value, pseudonym). Values that fail validation stay. Null
    texts stay null and have no values, empty texts stay empty; values keep their lengths, but for addresses, whose
    numbers may get more or fewer digits; repeated rows get equal results. Only ``text`` is read; a
    column that is called like ``found`` is replaced. Texts and values may have any length. An empty key is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    rx, k = _sql(pattern()), _sql("kinfold-key:" + hashlib.sha256(b"kinfold pseudonyms|" + key.encode()).hexdigest() + "|")
    hits = f"transform(regexp_extract_all(`{text}`, {rx}, 0), m -> {found_sql(k)})"
    name = found or next(n for n in ("_found" + "_" * i for i in range(len(df.columns) + 1)) if n not in df.columns)
    out = df.withColumn(name, F.expr(hits))
    rebuilt = f"array_join(zip_with(split(`{text}`, {rx}, -1), `{name}`, (a, b) -> concat(a, coalesce(b.pseudonym, ''))), '')"
    out = out.withColumn(text, F.expr(f"if(size(`{name}`) > 0, {rebuilt}, `{text}`)"))
    if found:
        return out.withColumn(found, F.expr(f"filter(`{found}`, x -> x.value <> x.pseudonym)"))
    return out.drop(name)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and what was replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, session_key(spark), found="found").select("doc_id", "text", F.coalesce(F.size("found"), F.lit(0)).alias("n_found"), F.expr("array_join(array_sort(array_distinct(found.kind)), ',')").alias("kinds"))
