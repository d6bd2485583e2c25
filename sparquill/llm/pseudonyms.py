"""Format-preserving Feistel pseudonyms, with DataFrame operations only.

Candidates are found by one pattern and validated (Luhn and issuer ranges for
cards, mod 97 for IBANs, octets, calendar dates, number ranges). A valid value
becomes a vector of numbers with a modulus each: digits mod 10, letters mod 26,
octets mod 256, a date two numbers mod 270 (72,900 days from 1900-01-01), parts of
a social security number by their ranges. Rounds of an unbalanced Feistel network
add to one half what a keyed hash of the other half says, so every format is
permuted onto itself: the result is valid, keeps length (but for octets of an
address), separators and letter case, and equal values get equal pseudonyms in all documents. Check digits are
computed anew. What is permuted is the bare value: separators take no part, so a
card, an IBAN or a phone number has one pseudonym in all notations, with or without
its country code, and a date one in all its forms.

Candidates: mail addresses; phones after + (of the countries in ``NATIONAL`` as many
digits as a number there has, the longest reading where lengths differ; what follows is
no part of them) or with a bracketed area code, and ten digits parted by - or . whose
area is no less than 200 (a 1 may stand before them); IPv4; IPv6 in eight groups or with
a ``::`` inside, written in eight groups afterwards; dates as year-month-day with - or /,
also before a time of day, which stays, day.month.year, day-month-year and
day/month/year, or month/day/year where that is the only valid reading; social security
numbers with hyphens; cards; IBANs in capitals, or in small letters without spaces; secrets of 32 to 64 hexadecimal digits of one case
and keys with the prefixes in ``KEYS``. Digits without form (a bare ten-digit number,
a social security number without hyphens) stay: nothing tells them from others.

Defined results: a null or empty text stays as it is; candidates that aren't valid
and all other text stay as they are; a value that stands glued to word characters
isn't a candidate; of a mail address the part before @ is permuted and letters
outside a-z stay. A month-first date stays month-first. Other columns pass through
whatever their names, but for ``found``, which is replaced; repeated rows get equal
texts; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
DAYS = 270 * 270
EPOCH = "1900-01-01"

_STOP = r"(?![\p{L}\p{N}_])"
#: A date may stand before the time of a timestamp.
_TIME = r"(?<=(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2})(?=T[0-9]{2}:[0-9]{2})"
#: Prefixes of keys, which stay, and the form of what follows (fixed values).
KEYS = {"(?:AKIA|ASIA)": "[0-9A-Z]{16}", "gh[opsu]_": "[0-9A-Za-z]{36,}", "sk-": "[0-9A-Za-z_-]{20,}", "xox[abprs]-": "[0-9A-Za-z-]{10,}", "AIza": "[0-9A-Za-z_-]{35}", "glpat-": "[0-9A-Za-z_-]{20,}"}
_HEX = r"[0-9a-f]{32,64}|[0-9A-F]{32,64}"
#: Country codes of the international numbering plan: one digit, two, or any three (fixed values).
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Digits of a whole number after the country code, least and most (fixed values of the national plans).
NATIONAL = {
    "1": (10, 10), "7": (10, 10), "20": (9, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (8, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13),
    "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (7, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10),
    "61": (9, 9), "62": (8, 12), "63": (10, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 11), "84": (9, 10), "86": (11, 11), "90": (10, 10), "91": (10, 10), "92": (10, 10), "94": (9, 9),
    "98": (10, 10), "351": (9, 9), "353": (7, 9), "358": (6, 11), "380": (9, 9), "420": (9, 9), "421": (9, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
_PLANNED = "|".join(rf"{c}(?:[ .-]?\d){{{a},{b}}}" for c, (a, b) in NATIONAL.items())
#: Kind of value and the form of its candidates, in the order they are tried.
FORMS = {
    "email": r"[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+(?:" + _PLANNED + rf"){_STOP}|\+(?!(?:{'|'.join(NATIONAL)})[ .-]?\d)\d{{1,3}}" + r"(?:[ .-]?\d{2,4}){2,5}|(?:1-)?[2-9]\d{2}-\d{3}-\d{4}|(?:1\.)?[2-9]\d{2}\.\d{3}\.\d{4}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?!\.\d)",
    "ipv6": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?!:)|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?!:)",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?|[a-z]{2}\d{2}[a-z0-9]{11,30}",
    "secret": "|".join([_HEX, *(a + b for a, b in KEYS.items())]),
}
KINDS = tuple(FORMS)


def _pattern(kinds: tuple[str, ...]) -> str:
    forms = [FORMS[k] for k in kinds]
    # the card form has the pattern's only group
    return f"(?:(?<![\\p{{L}}\\p{{N}}_+.-])|(?<=[.+-])(?<![\\p{{L}}\\p{{N}}_][.+-])){'(?:' + '|'.join(f'(?:{f})' for f in forms) + ')'}(?:{_STOP}|{_TIME})"


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute(values: Column, moduli: Column, key: str, tweak: Column) -> Column:
    """The Feistel network over an array of ints below their moduli (arrays of one length)."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def turn(now: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(now, half + 1, n - half)).otherwise(F.slice(now, F.lit(1), half))
        said = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        # a hash has words for 16 places; longer values take more hashes, by a counter
        hashes = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / 16).cast("int")), lambda c: F.sha2(F.when(c == 0, said).otherwise(F.concat_ws("|", said, c.cast("string"))).cast("binary"), 256))
        word = F.array_join(hashes, "")

        def add(w: Column) -> Column:
            part = lambda i: F.conv(F.substring(w, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.transform(now, lambda v, i: F.when((i < half) == left, (v + part(i)) % F.element_at(moduli, i + 1)).otherwise(v))

        return _once(word, add)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


_ZERO, _LOWER, _UPPER = (F.ascii, 97, 65)


def _letters(s: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """Permute the ASCII letters and digits of a string, each within its class."""

    def classes(c: Column) -> Column:
        code = F.ascii(c)
        if hexadecimal:
            return F.struct(F.conv(c, 16, 10).cast("int").alias("v"), F.lit(16).alias("m"))
        kind = lambda a, b: code.between(a, b) & (F.octet_length(c) == 1)
        digit, lower, upper = kind(48, 57), kind(97, 122), kind(65, 90)
        value = F.when(digit, code - 48).when(lower, code - 97).when(upper, code - 65).otherwise(0)
        return F.struct(value.cast("int").alias("v"), F.when(digit, 10).when(lower | upper, 26).otherwise(1).alias("m"))

    def back(chars: Column) -> Column:
        def after(of: Column) -> Column:
            new = permute(F.transform(of, lambda x: x["v"]), F.transform(of, lambda x: x["m"]), key, F.lit(tweak))

            def put(c: Column, v: Column) -> Column:
                if hexadecimal:
                    small = F.lower(F.conv(v.cast("string"), 10, 16))
                    return F.when(F.upper(s) == s, F.upper(small)).otherwise(small)
                code = F.ascii(c)
                kind = lambda a, b: code.between(a, b) & (F.octet_length(c) == 1)
                return F.when(kind(48, 57), F.chr(v + 48)).when(kind(97, 122), F.chr(v + 97)).when(kind(65, 90), F.chr(v + 65)).otherwise(c)

            return F.array_join(F.zip_with(chars, new, put), "")

        return _once(F.transform(chars, classes), after)

    return _once(_chars(s), back)


def _refill(shape: Column, filling: Column, places: str = "0-9") -> Column:
    """``shape`` with its digits (or what ``places`` says) replaced, in order."""
    place = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike(f"^[{places}]$"), F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{places}]", ""))))
    return _once(filling, lambda d: F.array_join(F.zip_with(_chars(shape), place, lambda c, p: F.when(p.isNull(), c).otherwise(F.substring(d, p, F.lit(1)))), ""))


def _numbers(d: Column, key: str, tweak: str) -> Column:
    """A string of digits, permuted."""
    values = F.transform(_chars(d), lambda c: c.cast("int"))
    return _once(values, lambda v: F.array_join(F.transform(permute(v, F.transform(v, lambda _: F.lit(10)), key, F.lit(tweak)), lambda x: x.cast("string")), ""))


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a string of digits."""

    def value(c: Column, i: Column) -> Column:
        x = c.cast("int")
        double = (F.length(d) - i) % 2 == 0
        return F.when(double, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.transform(_chars(d), value), F.lit(0), lambda a, x: a + x)


def card_valid(s: Column) -> Column:
    d = _digits(s)
    issuer = d.rlike(r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[068]\d{12}|6(?:011|5\d\d|4[4-9]\d)\d{12}|35\d{14})$")
    return issuer & (luhn_sum(d) % 10 == 0)


def _card(s: Column, key: str) -> Column:
    """First and check digit apart: the first keeps the issuer's kind, the last is computed."""

    def close(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    d = _digits(s)
    # two digits name an issuer for all kinds but those that begin with 4
    fixed = F.when(d.startswith("4"), 1).when(d.startswith("6"), 4).otherwise(2)
    return _refill(s, _once(F.concat(F.substring(d, F.lit(1), fixed), _numbers(F.substring(d, fixed + 1, F.length(d) - fixed - 1), key, "card")), close))


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0).cast("long"), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def iban_valid(s: Column) -> Column:
    bare = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    return F.length(bare).between(15, 34) & (_mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))) == 1)


def _iban(s: Column, key: str) -> Column:
    """The country stays; all else of the bare value is permuted, then parted as it was."""
    bare = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    country = F.substring(bare, F.lit(1), F.lit(2))
    rest = _letters(F.substring(bare, F.lit(5), F.length(bare)), key, "iban")

    def close(r: Column) -> Column:
        check = 98 - _mod97(F.concat(r, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), r)

    new = _refill(F.upper(s), _once(rest, close), "0-9A-Z")
    return F.when(F.lower(s) == s, F.lower(new)).otherwise(new)


def ip_valid(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))


def _ip(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(permute(o, F.array(*[F.lit(256)] * 4), key, F.lit("ip")), lambda x: x.cast("string")), ".")


def _groups(s: Column) -> Column:
    """The eight groups of an address, with those that :: stands for."""
    ends = F.transform(F.split(s, "::"), lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
    left, right = F.element_at(ends, 1), F.coalesce(F.try_element_at(ends, F.lit(2)), F.array().cast("array<string>"))
    return F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)


def ipv6_valid(s: Column) -> Column:
    """Eight groups, or fewer around one ``::``; a digit tells it from names of code."""
    colons = F.length(s) - F.length(F.replace(s, F.lit(":"), F.lit("")))
    return s.rlike("[0-9]") & (F.size(_groups(s)) == 8) & F.when(s.contains("::"), (F.size(F.split(s, "::")) == 2) & (colons <= 7)).otherwise(colons == 7)


def _ipv6(s: Column, key: str) -> Column:
    new = permute(F.transform(_groups(s), lambda g: F.conv(g, 16, 10).cast("int")), F.array_repeat(F.lit(1 << 16), 8), key, F.lit("ipv6"))
    text = F.lower(F.array_join(F.transform(new, lambda x: F.conv(x.cast("string"), 10, 16)), ":"))
    return F.when(F.upper(s) == s, F.upper(text)).otherwise(text)


def _parts(s: Column, *places: int) -> Column:
    """A date of its year, month and day, each where it stands in the text."""
    year, month, day = places
    return F.try_to_date(F.concat_ws("-", F.substring(s, year, 4), F.substring(s, month, 2), F.substring(s, day, 2)), "yyyy-MM-dd")


def _year_first(s: Column) -> Column:
    return F.substring(s, 5, 1).isin("-", "/")


def _month_first(s: Column) -> Column:
    """Whether only this reading of month/day/year makes a date."""
    return ~_year_first(s) & (F.substring(s, 3, 1) == "/") & _parts(s, 7, 4, 1).isNull()


def _date(s: Column) -> Column:
    return F.when(_year_first(s), _parts(s, 1, 6, 9)).otherwise(F.coalesce(_parts(s, 7, 4, 1), F.when(F.substring(s, 3, 1) == "/", _parts(s, 7, 1, 4))))


def date_valid(s: Column) -> Column:
    same = F.when(_year_first(s), F.substring(s, 5, 1) == F.substring(s, 8, 1)).otherwise(F.substring(s, 3, 1) == F.substring(s, 6, 1))
    return _date(s).isNotNull() & (_date(s) >= F.lit("1000-01-01").cast("date")) & same


def _other_date(s: Column, key: str) -> Column:
    day = F.datediff(_date(s), F.lit(EPOCH).cast("date"))
    block, at = F.floor(day / DAYS).cast("int"), F.pmod(day, F.lit(DAYS))
    pair = F.array(F.floor(at / 270).cast("int"), (at % 270).cast("int"))

    def put(p: Column) -> Column:
        new = F.date_add(F.lit(EPOCH).cast("date"), block * DAYS + F.element_at(p, 1) * 270 + F.element_at(p, 2))
        y, m, d = (F.date_format(new, x) for x in ("yyyy", "MM", "dd"))
        sep = F.when(_year_first(s), F.substring(s, 5, 1)).otherwise(F.substring(s, 3, 1))
        return F.when(_year_first(s), F.concat(y, sep, m, sep, d)).when(_month_first(s), F.concat(m, sep, d, sep, y)).otherwise(F.concat(d, sep, m, sep, y))

    return _once(permute(pair, F.array(F.lit(270), F.lit(270)), key, F.concat(F.lit("date"), block.cast("string"))), put)


def ssn_valid(s: Column) -> Column:
    a, g, n = (F.substring(s, p, k).cast("int") for p, k in ((1, 3), (5, 2), (8, 4)))
    return a.between(1, 899) & (a != 666) & (g > 0) & (n > 0)


def _ssn(s: Column, key: str) -> Column:
    a, g, n = (F.substring(s, p, k).cast("int") for p, k in ((1, 3), (5, 2), (8, 4)))
    values = F.array(a - F.when(a > 666, 2).otherwise(1), g - 1, n - 1)

    def put(v: Column) -> Column:
        area = F.element_at(v, 1) + 1
        return F.format_string("%03d-%02d-%04d", F.when(area >= 666, area + 1).otherwise(area), F.element_at(v, 2) + 1, F.element_at(v, 3) + 1)

    return _once(permute(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn")), put)


def _email(s: Column, key: str) -> Column:
    local = F.substring_index(s, "@", 1)
    return F.concat(_letters(local, key, "email"), F.substring(s, F.length(local) + 1, F.length(s)))


def phone_valid(s: Column) -> Column:
    return F.length(_digits(s)).between(8, 15)


def _phone(s: Column, key: str) -> Column:
    """The country code stays; the national number is permuted, whatever its separators.

    In ten digits of the American plan the first of area and of exchange stays below 2
    or stays above 1, so what is a number there remains one.
    """
    bare = _digits(s)
    country = F.when(s.startswith("+"), F.regexp_extract(bare, _COUNTRY, 0)).when(s.rlike(r"^1[-.]"), "1").otherwise("")

    def number(d: Column) -> Column:
        american = (F.length(d) == 10) & country.isin("", "1")
        least = lambda c, i: F.when(american & i.isin(0, 3) & (c >= 2), 2).otherwise(0)
        digits = F.transform(_chars(d), lambda c: c.cast("int"))
        moduli = F.transform(digits, lambda c, i: F.when(american & i.isin(0, 3), F.when(c >= 2, 8).otherwise(2)).otherwise(10))
        new = permute(F.transform(digits, lambda c, i: c - least(c, i)), moduli, key, F.lit("phone"))
        return F.array_join(F.zip_with(new, F.transform(digits, least), lambda x, y: (x + y).cast("string")), "")

    return _refill(s, F.concat(country, _once(F.substring(bare, F.length(country) + 1, F.length(bare)), number)))


def _secret(s: Column, key: str) -> Column:
    prefix = F.regexp_extract(s, f"^(?:{'|'.join(KEYS)})", 0)
    return F.when(s.rlike(f"^(?:{_HEX})$"), _letters(s, key, "secret", True)).otherwise(F.concat(prefix, _letters(F.substring(s, F.length(prefix) + 1, F.length(s)), key, "secret")))


def kind_of(s: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    valid = {"email": F.lit(True), "phone": phone_valid(s), "ip": ip_valid(s), "ipv6": ipv6_valid(s), "date": date_valid(s), "ssn": ssn_valid(s), "card": card_valid(s), "iban": iban_valid(s), "secret": s.rlike("[0-9]") & s.rlike("[a-zA-Z]")}
    out = F
    for k in kinds:
        test = s.rlike(f"^(?:{FORMS[k]})$")
        out = out.when(test, F.when(valid[k], F.lit(k)))
    return out


def pseudonym(s: Column, kind: Column, key: str, kinds: tuple[str, ...] = KINDS) -> Column:
    make = {"email": _email, "phone": _phone, "ip": _ip, "ipv6": _ipv6, "date": _other_date, "ssn": _ssn, "card": _card, "iban": _iban, "secret": _secret}
    out = F
    for k in kinds:
        out = out.when(kind == k, make[k](s, key))
    return out.otherwise(s)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows of ``docs`` with ``text`` changed and ``found``: for each valid value its kind, in order."""
    pattern = _pattern(kinds)
    taken = [c for c in docs.columns if c.lower() != "found"]
    values, named = fresh(docs.columns, "hits", "kinds")
    hits = docs.select(*taken).withColumn(values, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    marked = hits.withColumn(named, F.transform(values, lambda s: kind_of(s, kinds)))
    new = F.zip_with(values, named, lambda s, k: F.when(k.isNull(), s).otherwise(pseudonym(s, k, key, kinds)))
    # gaps and values take turns; the pattern finds the same places in both
    gaps = F.split(F.col(text), pattern, -1)
    whole = F.array_join(F.zip_with(gaps, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    changed = F.when(F.exists(named, lambda k: k.isNotNull()), whole).otherwise(F.col(text))
    found = F.array_compact(F.coalesce(named, F.array().cast("array<string>")))
    return marked.withColumn(text, changed).withColumn("found", found).select(*taken, "found")
