"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Whole texts are searched with one expression.  What is found is checked (Luhn
sum, IBAN remainder, octets, area numbers, calendar) and then permuted within
its format by a keyed Feistel network: a number becomes another valid number of
the same length and punctuation, a date another date in the same notation.  The
permutation depends on the key, the kind and the value alone, so equal values
stay equal in all documents and different ones stay different.

A network keeps two parts a and b, of ma and mb values, and adds to each in
turn, modulo its range, a keyed SHA-256 of the other.  Dates are numbered
within the 400 years from 1800, whose 146097 days are 189 * 773, so every
permuted date is a date and nothing has to be drawn twice.

kind    found and checked                      what is permuted
email   local part at a domain                 local part, to "u" and 12 digits of its keyed hash
card    13 to 19 digits, whole, in fours or    all but the first and the last; the last is set anew
        4-6-5, with a Luhn sum of 0
iban    in one or in fours, remainder 1        digits after the fourth character; check digits set anew
phone   international or (ddd) ddd-dddd        all digits after a leading +d
ssn     ddd-dd-dddd or with blanks; area not   the last six, walked on until group and serial are not 0
        0, 666, 9xx, group and serial not 0
ipv4    four octets up to 255                  the 32 bits
date    yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy,    the day's number, 1800 to 2199; where no month has that
        mm/dd/yyyy where dd is past 12,        number in dd/mm, walked on until the day is past 12 again
        Jan 5, 1980, 5 January 1980
secret  32 to 64 lower-case hexadecimals       to as many of its keyed hash's

To walk on is to permute again until the value is a valid one (WALK times at most;
of random values one in 10**15 needs more, and that one stays as it is), which is
a permutation of the valid ones.  IPv6 addresses and plain runs of ten digits, which
nothing tells from other numbers, are not looked for.

Emails and secrets are neither numbers nor dates: they turn into keyed hashes,
equal for equal values, and different ones collide with negligible probability.

Cases: a null text stays null with a count of 0; an empty one stays empty.
What looks like a number but fails its check stays as it is.  Other columns,
also of the same names as used here, pass through untouched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Most steps of a cycle walk.
WALK = 40
#: Names of the months as dates hold them, whole and short (fixed values).
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

#: Possessive or bounded, and anchored to a token's start, so that a text is read in linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}|" + f"(?:{MONTHS}|{SHORT})" + r" [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} " + f"(?:{MONTHS}|{SHORT})" + r" [0-9]{4})(?![0-9A-Za-z]))",
    "ssn": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?! [0-9]))(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9](?:(?:[ .-]?[0-9]){7,14}(?![0-9A-Za-z])|(?:[ .-]?[0-9]){15}(?![0-9A-Za-z]))|(?<![0-9A-Za-z+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{1,3})?|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5})(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(PATTERNS.values())
#: Only texts with one of these can hold a match.
_MAYBE = "[0-9@]|[0-9a-f]{32}"


def _hash(key: str, kind: str, value: str, digits: int = 12) -> str:
    """SQL: hexadecimals of a keyed hash of ``value`` (SQL)."""
    return f"substr(sha2(concat({key}, '|{kind}|', {value}), 256), 1, {digits})"


def _number(key: str, kind: str, value: str) -> str:
    return f"CAST(conv({_hash(key, kind, value)}, 16, 10) AS BIGINT)"


def _feistel(key: str, kind: str, a: str, b: str, ma: str, mb: str) -> str:
    """SQL: struct(a, b), the permuted pair of numbers below ma and mb."""
    part = lambda side: _number(key, kind, f"concat(r, ':', {ma}, ':', {mb}, ':', s.{side})")
    start = f"named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT))"
    step = f"IF(r % 2 = 0, named_struct('a', (s.a + {part('b')}) % {ma}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {part('a')}) % {mb}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step})"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(key: str, kind: str, d: str) -> str:
    """SQL: the string of digits ``d``, permuted among those of its length; one of less than two stays."""
    h = f"(length({d}) DIV 2)"
    ma, mb = f"CAST(pow(10, {h}) AS BIGINT)", f"CAST(pow(10, length({d}) - {h}) AS BIGINT)"
    pair = _feistel(key, kind, f"substr({d}, 1, {h})", f"substr({d}, {h} + 1)", ma, mb)
    return f"IF(length({d}) < 2, {d}, {_let('p', pair, f'''concat(lpad(CAST(p.a AS STRING), {h}, '0'), lpad(CAST(p.b AS STRING), length({d}) - {h}, '0'))''')})"


def _walked(start: str, step, valid) -> str:
    """SQL: ``start`` stepped once, and on until ``valid``; null if WALK steps don't reach it.  Both are functions of SQL."""
    walk = f"aggregate(sequence(2, {WALK}), {step(start)}, (w, k) -> IF({valid('w')}, w, {step('w')}))"
    return _let("w", walk, f"IF({valid('w')}, w, NULL)")


def _refilled(form: str, digits: str) -> str:
    """SQL: ``form`` with its digits replaced, in order, by those of ``digits``."""
    step = "IF(c BETWEEN '0' AND '9', named_struct('i', s.i + 1, 'o', concat(s.o, substr(t, s.i, 1))), named_struct('i', s.i, 'o', concat(s.o, c)))"
    return _let("t", digits, f"aggregate(split({form}, ''), named_struct('i', 1, 'o', ''), (s, c) -> {step}).o")


def _luhn(d: str) -> str:
    """SQL: the Luhn sum modulo 10 of a string of digits."""
    v = f"CAST(substr({d}, length({d}) - k, 1) AS INT)"
    return f"(aggregate(sequence(0, length({d}) - 1), 0, (s, k) -> s + IF(k % 2 = 0, {v}, IF({v} > 4, 2 * {v} - 9, 2 * {v}))) % 10)"


def _mod97(x: str) -> str:
    """SQL: an IBAN's remainder; letters count as 10 to 35."""
    step = "IF(c BETWEEN '0' AND '9', (s * 10 + CAST(c AS INT)) % 97, (s * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(filter(split(concat(substr({x}, 5), substr({x}, 1, 4)), ''), c -> c NOT IN ('', ' ')), 0, (s, c) -> {step})"


def _replaced(key: str) -> str:
    """SQL over m.k (kind) and m.v (what was found): the pseudonym, or null where a check fails."""
    v = "m.v"
    only = f"regexp_replace({v}, '[^0-9]', '')"
    email = f"concat('u', lpad(CAST({_number(key, 'email', f'''lower(regexp_extract({v}, '^[^@]+', 0))''')} % 1000000000000 AS STRING), 12, '0'), regexp_extract({v}, '@.*$', 0))"
    secret = f"substr(concat({_hash(key, 'secret', v, 64)}), 1, length({v}))"
    card_new = _let("n", f"concat(substr(d, 1, 1), {_digits(key, 'card', 'substr(d, 2, length(d) - 2)')})", f"concat(n, CAST((10 - {_luhn('''concat(n, '0')''')}) % 10 AS STRING))")
    card = _let("d", only, f"IF({_luhn('d')} = 0, {_refilled(v, card_new)}, NULL)")
    body = f"regexp_replace(substr({v}, 5), '[^0-9]', '')"
    iban_body = _refilled(f"substr({v}, 5)", _digits(key, "iban", body))
    iban_new = _let("w", f"concat(substr({v}, 1, 2), '00', {iban_body})", f"concat(substr(w, 1, 2), lpad(CAST(98 - {_mod97('w')} AS STRING), 2, '0'), substr(w, 5))")
    iban = f"IF({_mod97(v)} = 1, {iban_new}, NULL)"
    country = f"regexp_extract({v}, '^[+][0-9]', 0)"
    phone = _let("d", f"regexp_replace(substr({v}, length({country}) + 1), '[^0-9]', '')", f"IF(length(d) BETWEEN 7 AND 15, concat({country}, {_refilled(f'substr({v}, length({country}) + 1)', _digits(key, 'phone', 'd'))}), NULL)")
    whole = lambda six: f"(substr({six}, 1, 2) != '00' AND substr({six}, 3) != '0000')"
    ssn_new = _let("n", _walked("six", lambda x: _digits(key, "ssn", x), whole), f"IF(n IS NULL, NULL, concat(substr({v}, 1, 4), {_refilled(f'substr({v}, 5)', 'n')}))")
    ssn = _let("six", f"substr({only}, 4)", f"IF(substr({v}, 1, 3) IN ('000', '666') OR substr({v}, 1, 1) = '9' OR NOT {whole('six')}, NULL, {ssn_new})")
    octets = f"transform(split({v}, '[.]'), o -> CAST(o AS INT))"
    pair = _feistel(key, "ipv4", "q[0] * 256 + q[1]", "q[2] * 256 + q[3]", "65536", "65536")
    ipv4 = _let("q", octets, f"IF(forall(q, o -> o < 256), {_let('p', pair, '''concat_ws('.', CAST(p.a DIV 256 AS STRING), CAST(p.a % 256 AS STRING), CAST(p.b DIV 256 AS STRING), CAST(p.b % 256 AS STRING))''')}, NULL)")
    form = f"CASE WHEN {v} LIKE '____-%' THEN 'yyyy-MM-dd' WHEN {v} LIKE '__/%' THEN IF(CAST(substr({v}, 4, 2) AS INT) > 12, 'MM/dd/yyyy', 'dd/MM/yyyy') WHEN {v} LIKE '__.%' THEN 'dd.MM.yyyy'"
    form += f" WHEN {v} RLIKE '^({SHORT}) ' THEN IF({v} RLIKE ' [0-9]{{2}},', 'MMM dd, yyyy', 'MMM d, yyyy') WHEN {v} RLIKE '^[A-Z]' THEN IF({v} RLIKE ' [0-9]{{2}},', 'MMMM dd, yyyy', 'MMMM d, yyyy')"
    form += f" WHEN {v} RLIKE ' ({SHORT}) ' THEN IF({v} LIKE '__ %', 'dd MMM yyyy', 'd MMM yyyy') ELSE IF({v} LIKE '__ %', 'dd MMMM yyyy', 'd MMMM yyyy') END"
    moved = lambda n: _let("p", _feistel(key, "date", f"({n} DIV 773)", f"({n} % 773)", "189", "773"), "CAST(p.a * 773 + p.b AS INT)")
    of = lambda n: f"date_add(DATE'1800-01-01', {n})"
    # what a form can't be told from another by its day's number stays among such days, so that different values stay different
    same = lambda n: f"CASE WHEN f = 'MM/dd/yyyy' THEN day({of(n)}) > 12 WHEN f LIKE '%MMM%' AND f NOT LIKE '%dd%' THEN day({of(n)}) < 10 ELSE true END"
    day = f"datediff(try_to_timestamp({v}, f), DATE'1800-01-01')"
    written = _let("o", _walked("n", moved, same), f"date_format({of('o')}, f)")
    date = _let("f", form, _let("n", day, f"IF(n BETWEEN 0 AND 146096 AND {same('n')}, {written}, NULL)"))
    each = {"email": email, "iban": iban, "secret": secret, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}
    return "CASE m.k " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in each.items()) + " END"


def found(text: Column | str) -> Column:
    """array<struct<k, v>>: kind and string of everything in ``text`` that looks like personal data."""
    c = F.col(text) if isinstance(text, str) else text
    raw = F.when(c.rlike(_MAYBE), F.regexp_extract_all(c, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(raw, lambda v: F.struct(_kind_column(v).alias("k"), v.alias("v")))


def _kind_column(v: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        test = v.rlike("^(?:" + p + ")$")
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised; ``found_col``, if named, gets an array of struct(k kind, v, w pseudonym or null).

    The secret ``key`` is any string; who knows it can invert the numbers.
    """
    taken = set(docs.columns)
    name, held = [n for n in ("_pii", "_pii_key", *(f"_pii{i}" for i in range(1000))) if n not in taken][:2]
    # what the numbers can be inverted with is a subquery's result: neither it nor the key is a literal of the plan that runs
    tag = docs.sparkSession.sql("SELECT t FROM VALUES (:t) AS k(t)", args={"t": hashlib.sha256(key.encode()).hexdigest()})
    out = docs.withColumn(name, found(F.col(f"`{text_col}`"))).withColumn(held, tag.scalar())
    new = f"transform(`{name}`, m -> named_struct('k', m.k, 'v', m.v, 'w', {_replaced(f'`{held}`')}))"
    out = out.withColumn(name, F.expr(new)).drop(held)
    pieces = F.split(F.col(f"`{text_col}`"), _ANY, -1)
    swapped = F.expr(f"transform(`{name}`, m -> coalesce(m.w, m.v))")
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(swapped, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    out = out.withColumn(text_col, F.when(F.size(name) > 0, joined).otherwise(F.col(f"`{text_col}`")))
    return out.withColumnRenamed(name, found_col) if found_col else out.drop(name)
