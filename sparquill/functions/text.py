"""Text, number, date and URL functions as column expressions.

Accents fold by a translation table for Latin letters, built from Unicode's own
decompositions; ``exact_fold`` is an Arrow UDF for texts beyond it. Java regular
expressions are used throughout, so everything else stays inside generated code.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def _table() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one, and to several; combining marks fold to nothing."""
    one, to, several = [], [], {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c:
            continue
        if len(folded) == 1:
            one.append(c)
            to.append(folded)
        else:
            several[c] = folded
    marks = [chr(x) for x in range(0x300, 0x370) if unicodedata.combining(chr(x))]
    return "".join(one + marks), "".join(to), several


_FROM, _TO, _SEVERAL = _table()


def text(x) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))


def bound(x: Column, f) -> Column:
    """``f`` of a value that is computed once; else an expression is computed again at each use inside a function of arrays."""
    return F.element_at(F.transform(F.array(x), f), 1)


def fold(x: Column) -> Column:
    """Accents removed (compatibility decomposition without combining marks), Latin letters."""
    out = x
    for c in "ĲĳǄǅǆǇǈǉǊǋǌ":  # digraphs; other characters of several parts aren't letters
        out = F.replace(out, F.lit(c), F.lit(_SEVERAL[c]))
    # most texts have nothing to fold
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(out, _FROM, _TO))


def exact_fold() -> Column:
    """UDF for texts with letters outside the table."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))

    return run


def normalize(x: Column) -> Column:
    """Folded, lower case, runs of anything but a-z and 0-9 as one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(fold(text(x))), "[^a-z0-9]+", " "))


def normalize_ascii(x: Column) -> Column:
    """Folded to ASCII, white space collapsed, lower case; punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(fold(text(x)), r"[^\x00-\x7F]", ""), r"\s+", " ")))


def normalize_name(x: Column) -> Column:
    return F.nullif(normalize_ascii(x), F.lit(""))


def normalize_reference(x: Column) -> Column:
    """Upper case ASCII letters and digits, null if there are none; accented letters go."""
    return F.nullif(F.regexp_replace(F.upper(text(x)), "[^A-Z0-9]+", ""), F.lit(""))


def joined(*values: Column) -> Column:
    """Values with one space between, null as ''."""
    return F.array_join(F.array(*(text(v) for v in values)), " ")


def tokens(*values: Column) -> Column:
    """Distinct tokens of two letters or more, without stop words, sorted."""
    words = F.split(normalize(joined(*values)), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*lexicon.STOPWORDS))))


def words(values) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")") if values else F.array().cast("array<string>")


def tokens_without(ignored: Column, *values: Column) -> Column:
    return F.array_except(tokens(*values), ignored)


def part_tokens(name: Column, reference: Column) -> Column:
    return tokens_without(words(lexicon.GENERIC_PART), name, reference)


def contains_pattern(normalized: Column, of: Column, pattern: str) -> Column:
    """Several words: as a phrase; one word: as a token."""
    if not pattern:
        return F.lit(False)
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(f" {pattern} ") if " " in pattern else F.array_contains(of, pattern)


def long_tokens(*values: Column) -> Column:
    """Tokens of three characters or more in order of appearance, distinct."""
    lists = [F.regexp_extract_all(normalize_ascii(v), F.lit("[a-z0-9]+"), F.lit(0)) for v in values]
    return F.array_distinct(F.filter(F.concat(*lists), lambda w: F.length(w) >= 3))


def search_tokens(*values: Column) -> Column:
    """Parts between anything but ASCII letters, digits and Latin letters, lower case, two or more, in order, distinct."""
    whole = F.lower(F.array_join(F.array_compact(F.array(*(F.nullif(F.trim(text(v)), F.lit("")) for v in values))), " "))
    return F.array_distinct(F.filter(F.split(whole, "[^a-z0-9áéíóúüñ]+"), lambda w: F.length(w) >= 2))


def unescape_html(x: Column) -> Column:
    """The common entities and decimal code points."""
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#039", "'"), ("aacute", "á"), ("eacute", "é"), ("iacute", "í"), ("oacute", "ó"), ("uacute", "ú"), ("ntilde", "ñ"), ("ndash", "–"), ("mdash", "—"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(c))
    return x


def strip_html(x: Column) -> Column:
    """Entities undone, tags as spaces, white space collapsed; letter case stays."""
    x = F.regexp_replace(unescape_html(text(x)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(unescape_html(text(x)), r"[\s ]+", " "))


def repair_mojibake():
    """UDF: UTF-8 that was read as Latin-1, where its marks show."""

    @F.pandas_udf("string")
    def run(s):
        def one(v):
            if v is None or not any(m in v for m in ("Ã", "Â", "â")):
                return v
            try:
                return v.encode("latin-1").decode("utf-8")
            except UnicodeError:
                return v

        return s.map(one)

    return run


def slug_words(x: Column) -> Column:
    return F.trim(F.regexp_replace(text(x), "[-_/]+", " "))


def slug_name(x: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text(x), "[-_]+", " ")))


# -- values -------------------------------------------------------------------


def present(x: Column, reject_missing: bool = True) -> Column:
    """Trimmed text, null if blank (or one of the words that say so)."""
    x = F.nullif(F.trim(x.cast("string")), F.lit(""))
    return F.when(~F.lower(x).isin(*lexicon.MISSING), x) if reject_missing else x


def first_text(*values: Column, reject_missing: bool = True) -> Column:
    return F.coalesce(*(present(v, reject_missing) for v in values))


def as_int(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("int")


def strict_int(x: Column) -> Column:
    x = F.trim(x.cast("string"))
    return F.when(x.rlike(r"^\d+$"), x.try_cast("long"))


def as_decimal(x: Column) -> Column:
    return F.trim(F.regexp_replace(x.cast("string"), "[$,]", "")).try_cast("decimal(38,6)")


def price_int(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x.cast("string"), "[^0-9]", ""), F.lit("")).try_cast("long")


def as_bool(x: Column) -> Column:
    v = normalize_ascii(x)
    return F.when(v.isin("1", "true", "yes", "si", "on"), True).when(v.isin("0", "false", "no", "off"), False)


def as_timestamp(x: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.trim(x.cast("string")), "Z$", "+00:00"))


def sha256(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.sha2(F.trim(x).cast("binary"), 256))


def quote_key(message_id: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(text(message_id), F.lit("\n"), text(url)).cast("binary"), 256), 1, 24)


def quote_date(received_at: Column, generated_at: Column) -> Column:
    """The first ten characters of either, else "unknown-date"."""
    cut = lambda x: F.nullif(F.substring(F.trim(text(x)), 1, 10), F.lit(""))
    return F.coalesce(cut(received_at), cut(generated_at), F.lit("unknown-date"))


def insurer(subject: Column) -> Column:
    """What follows the last underscore of a subject."""
    s = present(subject, False)
    return F.when(s.contains("_"), F.nullif(F.element_at(F.split(s, "_"), -1), F.lit("")))


_YEAR = r"(?<![0-9])(20[0-9]{2})(?![0-9])"
_RANGE = r"(?<![0-9])(20[0-9]{2})\s*[-/]\s*(20[0-9]{2})(?![0-9])"


def years(x: Column, swap: bool = True, most: int | None = 15) -> Column:
    """Years 20xx and ranges of them, sorted and distinct.

    ``swap`` orders the ends of a range; ranges over more than ``most`` years give
    their ends only. Retrieval uses neither (``swap=False, most=None``).
    """
    x = text(x)
    one = F.transform(F.regexp_extract_all(x, F.lit(_YEAR), F.lit(1)), lambda y: y.cast("int"))
    starts, ends = (F.regexp_extract_all(x, F.lit(_RANGE), F.lit(k)) for k in (1, 2))

    def span(a: Column, b: Column) -> Column:
        a, b = a.cast("int"), b.cast("int")
        lo, hi = (F.least(a, b), F.greatest(a, b)) if swap else (a, b)
        ok = (hi >= lo) if most is None else (hi >= lo) & (hi - lo <= most)
        return F.when(ok, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.concat(one, F.flatten(F.zip_with(starts, ends, span)))))


def page_span(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "n/a").when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def vector_literal(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.format_string("%.8f", v.cast("double"))), ","), F.lit("]")))


def token_group(of: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The first label whose tokens are among ``of``."""
    out = F
    for label, members in groups.items():
        out = out.when(F.arrays_overlap(of, words(members)), label)
    return out


# -- mail ---------------------------------------------------------------------


def sender(x: Column) -> Column:
    x = text(x)
    inside = F.regexp_extract(x, "<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inside != "", inside).otherwise(x)))


def received_at(date: Column, epoch_ms: Column) -> Column:
    """A mail date as UTC text, else the epoch in milliseconds, else ''."""
    bare = F.regexp_replace(F.trim(text(date)), r"^[A-Za-z]{3},\s*|\s*\([^)]*\)$", "")
    at = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.timestamp_millis(epoch_ms.try_cast("long")))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def body_text(data: Column) -> Column:
    """URL-safe base64, with or without padding, as UTF-8."""
    plain = F.translate(F.rtrim(text(data)), "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")), "UTF-8")


def header_value(headers: Column, name: str) -> Column:
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit(""))


# -- URLs -----------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def canonical_url(url: Column) -> Column:
    """Without fragment and path parameters; the query stays."""
    bare = F.regexp_replace(text(url), "#.*$", "")
    return F.regexp_replace(bare, r"^([^?]*);[^?/]*", "$1")


def page_number(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text(url), r"(?:[?&](?:page|paged|pg)=|/page/)([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(1))


def mask_query(url: Column) -> Column:
    """The whole query replaced."""
    return F.regexp_replace(text(url), r"\?[^#]*", "?[redacted]")


def mask_values(url: Column) -> Column:
    """Each value of the query replaced."""
    return F.regexp_replace(text(url), "=[^&#]*", "=[redacted]")


def same_host(url: Column, allowed: str) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return (h == allowed) | h.endswith("." + allowed)


def matches_any(x: Column, patterns) -> Column:
    # one expression that computes the text once, whatever the number of patterns
    return F.lower(text(x)).rlike("|".join(f"\\Q{p.lower()}\\E" for p in patterns)) if patterns else F.lit(False)


# Parts of paths.
PRODUCT_PATHS = ("/producto/", "/product/", "/products/", "/tienda/", "/shop/", "/p/")
CATEGORY_PATHS = ("/categoria", "/category", "/categorias", "/categories", "/collections/", "/linea", "/marca", "/catalogo", "/catalog", "/product-category/", "/servicios", "/page/")
IGNORED = ("/feed", "rss", ".xml")
# End of the fixed values.


def product_like(url: Column) -> Column:
    return matches_any(url, PRODUCT_PATHS) | F.lower(text(url)).endswith(".html")


def category_like(url: Column) -> Column:
    return matches_any(url, CATEGORY_PATHS)


def ignored(x: Column, keywords=()) -> Column:
    return matches_any(x, (*IGNORED, *keywords))


def query_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.trim(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))), F.lit(""))


def query_url(url: Column, parameters: dict[str, Column]) -> Column:
    """An address with the given query parameters; those that are null or blank are left out."""
    pairs = [F.when(_said(v), F.concat(F.lit(f"{k}="), F.replace(F.url_encode(v), F.lit("+"), F.lit("%20")))) for k, v in parameters.items()]
    said = F.array_join(F.array_compact(F.array(*pairs)), "&")
    bare = F.regexp_replace(text(url), "#.*$", "")
    joint = F.when(bare.contains("?"), F.when(bare.rlike("[?&]$"), "").otherwise("&")).otherwise("?")
    return F.when(said != "", F.concat(bare, joint, said)).otherwise(bare)


def _said(x: Column) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))


def sender_query(address: str, day: Column) -> Column:
    """A mail search for a sender; with a day for that day alone (from it, before the next)."""
    span = F.concat(F.lit(" after:"), F.date_format(day, "yyyy/MM/dd"), F.lit(" before:"), F.date_format(F.date_add(day, 1), "yyyy/MM/dd"))
    return F.concat(F.lit(f"from:{address}"), F.coalesce(span, F.lit("")))


def escape_html(x: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(c), F.lit(name))
    return x
