"""Provider snapshots as one table of catalog items.

Each provider has an adapter: a function from its parsed snapshots to items. The
registry is an allow-list; snapshots of other providers are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.matching import taxonomies

_S, _A = "string", "array<string>"
PRODUCT = (
    "struct<product_name:string,title:string,name:string,brand:string,reference:string,sku:string,supplier_item_code:string,category_name:string,subcategory_name:string,"
    "taxonomy_label:string,description:string,vehicle_scope:string,detail_url:string,product_url:string,url:string,category_url:string,searchable_tokens:array<string>,match_type:string,requires_manual_confirmation:boolean,"
    "series_label:string,line:string,product_names:array<string>,brands_by_product:map<string,array<struct<name:string>>>,segment:string,taxonomy:string,label:string>"
)
#: The fields of all known snapshots; what a snapshot lacks is null.
SNAPSHOT = "snapshot_date string, notes array<string>, " + ", ".join(f"{c} array<{PRODUCT}>" for c in ("products", "items", "catalog_products", "categories", "category_pages", "brand_pages", "service_families", "service_series"))

ITEM_FIELDS = ["provider_id", "provider_name", "provider_type", "detail_url", "title", "category_name", "subcategory_name", "brand", "reference", "sku", "code", "taxonomies", "tokens", "raw_match_type", "manual", "notes"]


def _first(*cols: Column) -> Column:
    return t.first_text(*cols, reject_missing=False)


def _rows(snapshots: DataFrame, *lists: str) -> DataFrame:
    """Entries of the first of some lists that isn't empty, with ``pos``."""
    some = F.coalesce(*(F.when(F.size(f"doc.{c}") > 0, F.col(f"doc.{c}")) for c in lists))
    return snapshots.select("provider_id", "provider_name", "notes", F.posexplode(some).alias("pos", "p"))


def _item(kind: str, title: Column, *, category: Column, sub: Column | None = None, brand: Column | None = None, reference: Column | None = None, sku: Column | None = None, code: Column | None = None, url: Column | None = None, taxonomy_from: tuple[Column, ...] = (), more_tokens: tuple[Column, ...] = (), manual: Column | None = None) -> list[Column]:
    none = F.lit(None).cast(_S)
    shown = [x for x in (title, category, sub, brand, reference, sku, code, *more_tokens) if x is not None]
    own = F.transform(F.coalesce(F.col("p.searchable_tokens"), F.array().cast(_A)), t.normalize)
    words = F.array_sort(F.array_distinct(F.concat(t.tokens(*shown), F.filter(own, lambda w: F.length(w) > 1))))
    opt = lambda x: none if x is None else x
    return [
        F.col("provider_id"), F.col("provider_name"), F.lit(kind).alias("provider_type"), opt(url).alias("detail_url"), title.alias("title"), category.alias("category_name"),
        opt(sub).alias("subcategory_name"), opt(brand).alias("brand"), opt(reference).alias("reference"), opt(sku).alias("sku"), opt(code).alias("code"),
        taxonomies(*(taxonomy_from or (title, category))).alias("taxonomies"), words.alias("tokens"), F.col("p.match_type").alias("raw_match_type"),
        F.coalesce(F.lit(True) if manual is None else manual, F.lit(False)).alias("manual"), F.col("notes"), F.col("pos"),
    ]


def products(snapshots: DataFrame, *lists: str, kind: str = "product_catalog", fields: tuple[str, ...] = ("sub", "sku", "code")) -> DataFrame:
    """Adapter for lists of products; ``fields`` says which optional ones a provider has."""
    p = lambda c: F.col(f"p.{c}")
    title = _first(p("product_name"), p("title"), p("name"))
    category = _first(p("category_name"), p("taxonomy_label"))
    d = _rows(snapshots, *(lists or ("products", "items"))).where(title.isNotNull())
    got = _item(
        kind, title, category=category, sub=_first(p("subcategory_name")) if "sub" in fields else None, brand=_first(p("brand")), reference=_first(p("reference")) if "reference" not in fields[3:] else None,
        sku=_first(p("sku")) if "sku" in fields else None, code=_first(p("supplier_item_code")) if "code" in fields else None, url=_first(p("detail_url"), p("product_url"), p("url")),
        taxonomy_from=(title, category, p("subcategory_name"), p("description"), p("vehicle_scope")), more_tokens=(p("description"), p("vehicle_scope")), manual=p("requires_manual_confirmation"),
    )
    return d.select(*got)


def partial_products(snapshots: DataFrame) -> DataFrame:
    """Adapter for a catalog with internal codes only: no references, the category is the taxonomy label."""
    p = lambda c: F.col(f"p.{c}")
    title = _first(p("product_name"), p("title"), p("name"))
    d = _rows(snapshots, "products").where(title.isNotNull())
    return d.select(*_item("product_catalog_partial", title, category=_first(p("taxonomy_label"), p("category_name")), code=_first(p("supplier_item_code")), url=_first(p("detail_url"), p("product_url")), manual=F.lit(True)))


def categories(snapshots: DataFrame, *lists: str) -> DataFrame:
    """Adapter for pages of categories or brands: items that name a family, never a product."""
    p = lambda c: F.col(f"p.{c}")
    title = _first(p("category_name"), p("title"), p("name"), p("label"))
    out = [_rows(snapshots, *c).where(title.isNotNull()).select(*_item("category_only", title, category=title, sub=_first(p("subcategory_name")), brand=_first(p("brand")), url=_first(p("category_url"), p("detail_url"), p("url")), manual=F.lit(True))) for c in (lists or (("categories", "category_pages"), ("brand_pages",)))]
    return reduce(DataFrame.unionByName, out)


def grouped_names(snapshots: DataFrame) -> DataFrame:
    """Adapter for category groups: an item for each product name, its brands looked up by name."""
    d = _rows(snapshots, "products").withColumn("g", F.explode("p.product_names")).where(t.present(F.col("g"), False).isNotNull())
    title = F.trim(F.col("g"))
    brands = F.nullif(F.array_join(F.transform(F.element_at("p.brands_by_product", F.col("g")), lambda b: b["name"]), ", "), F.lit(""))
    category = _first(F.col("p.category_name"))
    return d.select(*_item("category_only", title, category=category, sub=_first(F.col("p.segment")), brand=brands, url=_first(F.col("p.category_url")), taxonomy_from=(title, category, F.col("p.taxonomy")), manual=F.lit(True)))


def services(snapshots: DataFrame) -> DataFrame:
    """Adapter for service families and series: a series' label stands for a reference."""
    p = lambda c: F.col(f"p.{c}")
    family, label = _first(p("name"), p("title"), p("label")), _first(p("series_label"))
    a = _rows(snapshots, "service_families").where(family.isNotNull()).select(*_item("category_only", family, category=_first(p("taxonomy"), p("category_name")), url=_first(p("url"), p("detail_url")), taxonomy_from=(family, p("taxonomy"))))
    title = F.nullif(F.concat_ws(" ", p("brand"), p("line"), label), F.lit(""))
    b = _rows(snapshots, "service_series").where(title.isNotNull()).select(*_item("category_only", title, category=_first(p("category_name"), p("taxonomy")), brand=_first(p("brand")), reference=label, url=_first(p("url"), p("detail_url")), taxonomy_from=(title, p("category_name"), p("taxonomy"))))
    return a.unionByName(b)


def seeded(snapshots: DataFrame) -> DataFrame:
    """Adapter for crawled catalogs: products, and categories and brand pages."""
    return products(snapshots).unionByName(categories(snapshots))


#: Kinds of catalogs by name; a provider's registry entry names one of them.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "seeded": seeded,
    "groups": grouped_names,
    "services": services,
    "store": products,
    "cards": lambda s: products(s, fields=("code",)),
    "fallback_lists": lambda s: products(s, "products", "catalog_products", "items"),
    "partial": partial_products,
}


def items(snapshots: DataFrame, registry: dict[str, str]) -> DataFrame:
    """Items of all registered providers, with ``item_id`` from provider, adapter and place.

    ``snapshots`` has provider_id, provider_name, notes and doc (``SNAPSHOT``), one row
    for each provider; ``registry`` maps provider ids to kinds.
    """
    out = []
    for kind in sorted(set(registry.values())):
        own = snapshots.where(F.col("provider_id").isin(*[p for p, k in registry.items() if k == kind]))
        out.append(ADAPTERS[kind](own))
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("item_id", F.sha2(F.concat_ws("|", "provider_id", "provider_type", F.lpad(F.col("pos").cast("string"), 9, "0"), "title").cast("binary"), 256)).select("item_id", *ITEM_FIELDS)


def provider_specs(providers: DataFrame, latest: DataFrame) -> DataFrame:
    """provider_id, display_name, snapshot_date: defaults for matches that don't say."""
    return providers.join(latest.select("provider_id", F.col("snapshot").alias("snapshot_date")), "provider_id").select("provider_id", F.coalesce("display_name", "provider_id").alias("display_name"), "snapshot_date")


def item_notes(common: Column, metadata_note: Column, notes: Column) -> Column:
    every = F.concat(F.array(common, metadata_note), F.coalesce(notes, F.array().cast(_A)))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))
