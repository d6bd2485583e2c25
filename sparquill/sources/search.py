"""Landed answers of a product search API as records.

An answer is a JSON object; it is read by a schema, so other fields don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .pages import absolute

PRODUCT = (
    "struct<productId:string,productName:string,productReference:string,brand:string,link:string,description:string,image:string,categories:array<string>,"
    "items:array<struct<itemId:string,ean:string,referenceId:array<struct<Key:string,Value:string>>,images:array<struct<imageUrl:string>>>>,"
    "specificationGroups:array<struct<name:string,specifications:array<struct<name:string,values:array<string>>>>>,properties:array<struct<name:string,values:array<string>>>>"
)
#: The schema of one page of answers.
ANSWER = f"struct<recordsFiltered:int,products:array<{PRODUCT}>>"
# The root of category paths, and words that name vehicles.
CATEGORY_ROOT = "categorias"
VEHICLE_WORDS = ("marca de vehículo", "familia", "modelo", "cilindraje", "compatibilidad")
# End of the fixed values.


def _texts(x: Column) -> Column:
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), t.strip_html), lambda v: v != "")


def _first(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def reference(p: Column) -> Column:
    """The product's own reference, else of its first item that has one a reference id, or its EAN."""
    of_item = F.transform(p["items"], lambda i: F.coalesce(_first(_texts(F.transform(i["referenceId"], lambda r: r["Value"]))), t.present(i["ean"], False)))
    return F.coalesce(t.present(p["productReference"], False), _first(F.array_compact(of_item)))


def sku(p: Column) -> Column:
    return F.coalesce(_first(F.array_compact(F.transform(p["items"], lambda i: t.present(i["itemId"], False)))), t.present(p["productId"], False))


def image(p: Column) -> Column:
    """The first web address among the images of all items, else the product's own."""
    every = F.flatten(F.array_compact(F.transform(p["items"], lambda i: F.transform(i["images"], lambda m: F.trim(m["imageUrl"])))))
    web = lambda x: F.filter(x, lambda u: u.startswith("http"))
    return F.coalesce(_first(web(every)), _first(web(F.array(F.trim(p["image"])))))


def category_path(url: Column) -> Column:
    """The path of a category address without its slashes, null for other addresses."""
    path = F.trim(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    return F.when(F.lower(path).contains(CATEGORY_ROOT), path)


def categories(paths: Column) -> tuple[Column, Column]:
    """Category and subcategory: the last two parts of the deepest path (the first of equals); of one part the category alone."""
    bare = F.filter(F.transform(paths, lambda c: F.trim(c, F.lit("/"))), lambda c: F.lower(c).startswith(f"{CATEGORY_ROOT}/"))
    parts = F.transform(bare, lambda c: F.filter(F.transform(F.slice(F.split(c, "/"), 2, 99), lambda x: t.strip_html(F.replace(x, F.lit("-"), F.lit(" ")))), lambda x: x != ""))
    best = F.array_max(F.transform(parts, lambda p, i: F.struct(F.size(p).alias("n"), (-i).alias("first"), p.alias("p"))))["p"]
    return F.when(F.size(best) > 0, F.element_at(best, F.when(F.size(best) > 1, -2).otherwise(-1))), F.when(F.size(best) > 1, F.element_at(best, -1))


def specification_text(p: Column) -> Column:
    """Groups with the names and values of their specifications, then properties, as one text."""
    none = F.array().cast("array<string>")
    spec = lambda g, s: F.concat_ws(" ", t.present(g, False), t.present(s["name"], False), F.array_join(_texts(s["values"]), " "))
    groups = F.flatten(F.transform(F.coalesce(p["specificationGroups"], F.from_json(F.lit("[]"), "array<struct<name:string,specifications:array<struct<name:string,values:array<string>>>>>")), lambda g: F.coalesce(F.transform(g["specifications"], lambda s: spec(g["name"], s)), none)))
    more = F.flatten(F.transform(F.coalesce(p["properties"], F.from_json(F.lit("[]"), "array<struct<name:string,values:array<string>>>")), lambda s: F.concat(_texts(F.array(s["name"])), _texts(s["values"]))))
    return t.collapse(F.array_join(F.concat(groups, more), " "))


def complete_pages(answers: DataFrame, size: int) -> DataFrame:
    """The pages (surface, offset, doc) that a walk by ``size`` takes: up to the first short page, or the number of all records."""
    n, total = F.size("doc.products"), F.col("doc.recordsFiltered")
    ends = answers.where((n < size) | (F.col("offset") + size >= total)).groupBy(F.col("surface").alias("_s")).agg(F.min("offset").alias("_end"))
    return answers.join(ends, F.col("surface") == F.col("_s"), "left").where(F.col("_end").isNull() | (F.col("offset") <= F.col("_end"))).drop("_s", "_end")


def records(answers: DataFrame, base_url: str) -> DataFrame:
    """A record for each product with a name and an address; ``answers`` has surface, offset, doc."""
    d = answers.select("surface", "offset", F.posexplode("doc.products").alias("pos", "p"))
    p = F.col("p")
    url = t.canonical_url(absolute(t.present(p["link"], False), F.lit(base_url)))
    main, sub = categories(p["categories"])
    d = d.select(
        "surface", "offset", "pos", t.present(p["productName"], False).alias("product_name"), url.alias("detail_url"), t.present(p["brand"], False).alias("brand"), reference(p).alias("reference"), sku(p).alias("sku"),
        F.nullif(t.strip_html(p["description"]), F.lit("")).alias("description"), image(p).alias("image_url"), main.alias("category_name"), sub.alias("subcategory_name"), specification_text(p).alias("specification_text"),
    ).where(F.col("product_name").isNotNull() & F.col("detail_url").isNotNull() & ~t.ignored(F.col("detail_url")))
    vehicle = t.matches_any(F.concat_ws(" ", "product_name", "category_name", "description", "specification_text"), VEHICLE_WORDS)
    kind = F.when(F.col("reference").isNotNull(), "exact_reference").when(vehicle, "vehicle_compatible").otherwise("category_only")
    return d.withColumn("match_type", kind).withColumn("match_confidence", F.when(kind == "exact_reference", "high").otherwise("medium")).withColumn("requires_manual_confirmation", kind != "exact_reference")
