"""Rendered cards of listing pages as records: lines of text say brand, title, reference and price.

Lines are parted before white space is collapsed. Everything is a column expression
over the array of lines: the one line that names the brand is found by its place and
taken out, what is left are title and description in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .pages import absolute

# What lines say that are no content, and words of brand lines.
NOISE = (
    "agregar a cotización", "confirmar", "agotado", "ver detalle", "puedes intentar solicitando una cotización para buscar más opciones de compra", "costo de envío:",
    "vehículos compatibles", "impuesto incluido", "cantidad:", "entrega:", "marca:", "n° de parte:", "nº de parte:", "n de parte:",
)
BRAND_WORDS = ("genuine parts", "oem", "track one", "acdelco", "echlin", "quantum")
PRODUCT_PATHS = ("/producto/", "/product/")
# End of the fixed values.


def noise(line: Column) -> Column:
    """Whether a line is a button, a label, a bare price or a bullet."""
    low = F.lower(F.trim(line))
    return (low == "") | t.matches_any(low, NOISE) | low.rlike(r"^(?:desde\s*)?\$?[0-9.,]+$") | low.isin("-", "•")


def brand_like(line: Column) -> Column:
    """Whether a line looks like a brand: a known sign, a few words in capitals, or three short words."""
    low, words = F.lower(F.trim(line)), F.size(F.split(F.trim(line), r"\s+"))
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & (words <= 4) & (F.length(line) <= 40)
    short = (words <= 3) & (F.length(line) <= 32) & line.rlike(r"\p{L}")
    return (low != "") & (low.contains("marca:") | t.matches_any(low, BRAND_WORDS) | capitals | short)


def _without(lines: Column, place: Column) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.when(i + 1 != place, x)), lambda x: x.isNotNull())


def card_records(cards: DataFrame, host: str) -> DataFrame:
    """A record for each card (card_id, seed_url, text, links, images) that says a title, a reference or a brand."""
    raw = t.text("text")
    lines = F.filter(F.transform(F.split(raw, r"[\r\n]+"), t.strip_html), lambda x: x != "")
    said = F.try_element_at(F.filter(lines, lambda x: F.lower(x).startswith("marca:")), F.lit(1))
    d = cards.select(
        "card_id", "seed_url", t.strip_html(raw).alias("whole"), F.filter(lines, lambda x: ~noise(x)).alias("kept"), F.nullif(F.trim(F.regexp_replace(said, r"^[^:]*:", "")), F.lit("")).alias("said"),
        t.present(F.regexp_extract(raw, r"(?i)n[°ºo]\s*(?:de\s*(?:parte|pieza)|parte)\s*:\s*([^\r\n]+)", 1), False).alias("reference"), F.nullif(F.regexp_extract(raw, r"(?i)(?:desde\s*)?\$\s*[0-9.,]+", 0), F.lit("")).alias("price"),
        F.filter(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: t.canonical_url(absolute(x, F.col("seed_url")))), lambda u: u.isNotNull() & (t.host(u) == host) & ~t.ignored(u)).alias("urls"),
        F.try_element_at(F.filter(F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.startswith("http")), F.lit(1)).alias("image_url"),
    )
    place = F.when(F.col("said").isNotNull(), F.array_position("kept", F.col("said"))).otherwise(F.array_position(F.transform("kept", brand_like), F.lit(True)))
    d = d.withColumn("place", F.coalesce(place, F.lit(0))).withColumn("brand", F.coalesce("said", F.when(F.col("place") > 0, F.try_element_at("kept", F.col("place").cast("int")))))
    d = d.withColumn("lines", _without(F.col("kept"), F.col("place")))
    first, second = (F.try_element_at("lines", F.lit(i)) for i in (1, 2))
    title = F.when((F.size("lines") > 1) & brand_like(first) & F.col("reference").isNull(), second).otherwise(first)
    tail = F.when(F.size("lines") > 1, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.col("price").isNotNull() & ~F.array_contains(tail, F.col("price")), F.concat(F.array("price"), tail)).otherwise(tail)
    product = F.try_element_at(F.filter("urls", lambda u: t.matches_any(F.try_parse_url(u, F.lit("PATH")), PRODUCT_PATHS)), F.lit(1))
    # a generator: the filter of titles must not compute them again, nor before the cards are dealt
    row = F.struct(
        "card_id", F.coalesce(title, "reference", "brand").alias("title"), "brand", "reference", F.coalesce(F.nullif(t.collapse(F.array_join(tail, " ")), F.lit("")), "whole").alias("description"),
        F.coalesce(product, F.try_element_at("urls", F.lit(-1))).alias("detail_url"), "image_url",
    )
    return d.select(F.inline(F.array(row))).where(F.col("title").isNotNull())
