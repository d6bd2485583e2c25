"""Landed web pages and mails as rows: titles, links, product data, cards, listings, quotes, messages.

Everything that a regular expression can say is a column expression. Arrow UDFs
remain for recursion: nested JSON-LD, MIME trees, and anchors of mail bodies.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, as clean text, null if there is none."""
    return F.nullif(t.strip_html(F.regexp_extract(t.text(x), pattern, group)), F.lit(""))


def title(html: Column) -> Column:
    """The first heading, else the title up to " - ", a bar or an en dash."""
    head = found(html, "(?is)<h1[^>]*>(.*?)</h1>")
    return F.coalesce(head, F.nullif(F.trim(F.regexp_replace(found(html, "(?is)<title[^>]*>(.*?)</title>"), r"(?s)\s+[-|–]\s.*$", "")), F.lit("")))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by property or name, attributes in either order."""
    n = re.escape(name)
    one = found(html, rf"(?is)<meta[^>]+(?:property|name)=[\"']{n}[\"'][^>]+content=[\"']([^\"']*)[\"']")
    return F.coalesce(one, found(html, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:property|name)=[\"']{n}[\"']"))


#: Addresses of feeds (fixed values).
FEEDS = ("/feed/", ".rss", ".xml")


def hrefs(html: Column) -> Column:
    """Link values that aren't places of the same page or feeds."""
    every = F.regexp_extract_all(t.text(html), F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(every, lambda h: ~h.startswith("#") & ~t.matches_any(h, FEEDS))


def absolute(link: Column, base: Column) -> Column:
    """A link resolved against its page: absolute, by scheme, by host, or by folder."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    link = F.trim(t.unescape_html(link))
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def links(html: Column, base: Column) -> Column:
    """Absolute web addresses of a page in order, each once, without feeds."""
    every = F.transform(hrefs(html), lambda h: t.canonical_url(absolute(h, base)))
    return F.array_distinct(F.filter(every, lambda u: u.isNotNull() & u.rlike("(?i)^https?://")))


def pdf_links(html: Column, base: Column) -> Column:
    return F.filter(links(html, base), lambda u: F.lower(u).rlike(r"\.pdf(\?|$)"))


# -- JSON-LD ----------------------------------------------------------------------

LD_PRODUCT = "struct<name:string,brand:string,mpn:string,sku:string,category:string,description:string,image:string,price:string,url:string>"


def _nodes(value):
    if isinstance(value, list):
        for v in value:
            yield from _nodes(v)
    elif isinstance(value, dict):
        yield value
        if "@graph" in value:
            yield from _nodes(value["@graph"])


def pick_text(value, keys=("name", "text", "@id", "url")):
    """The first text in a scalar, a list or an object's usual fields."""
    if isinstance(value, (str, int, float)) and not isinstance(value, bool):
        return " ".join(str(value).split()) or None
    if isinstance(value, list):
        return next((x for x in map(pick_text, value) if x), None)
    if isinstance(value, dict):
        return next((x for x in (pick_text(value.get(k)) for k in keys) if x), None)
    return None


def json_ld():
    """UDF: products and breadcrumb names of a page's JSON-LD; blocks that aren't JSON, even without control characters, are ignored."""

    @F.pandas_udf(f"struct<products:array<{LD_PRODUCT}>,breadcrumbs:array<string>>")
    def run(pages):
        import pandas as pd

        blocks = re.compile(r"<script[^>]+application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)
        rows = []
        for html in pages:
            products, crumbs = [], []
            for raw in blocks.findall(html or ""):
                for attempt in (raw, re.sub(r"[\x00-\x1f]+", " ", raw)):
                    try:
                        value = json.loads(attempt)
                        break
                    except ValueError:
                        value = None
                for node in _nodes(value):
                    kinds = node.get("@type")
                    kinds = kinds if isinstance(kinds, list) else [kinds]
                    if "Product" in kinds:
                        offer = node.get("offers")
                        offer = offer[0] if isinstance(offer, list) and offer else offer
                        price = offer.get("price") if isinstance(offer, dict) else None
                        products.append({k: pick_text(node.get(k)) for k in ("name", "brand", "mpn", "sku", "category", "description", "image", "url")} | {"price": pick_text(price)})
                    elif "BreadcrumbList" in kinds:
                        for e in node.get("itemListElement") or []:
                            name = pick_text(e.get("name") or e.get("item")) if isinstance(e, dict) else None
                            if name:
                                crumbs.append(name)
            rows.append({"products": products, "breadcrumbs": crumbs})
        return pd.DataFrame(rows, columns=["products", "breadcrumbs"])

    return run


def product_records(pages: DataFrame) -> DataFrame:
    """page_id, url, record fields: JSON-LD products, else one record from title and meta fields of product-like addresses."""
    d = pages.withColumn("ld", json_ld()("html"))
    crumbs = F.filter("ld.breadcrumbs", lambda c: ~F.lower(c).isin("home", "inicio"))
    many = d.where(F.size("ld.products") > 0).withColumn("p", F.explode("ld.products"))
    at = lambda i: F.try_element_at(crumbs, F.lit(i))
    a = many.select("page_id", "url", F.coalesce("p.name", title(F.col("html"))).alias("product_name"), F.col("p.brand").alias("brand"), F.coalesce("p.mpn", "p.sku").alias("reference"), F.col("p.sku").alias("sku"), F.coalesce("p.category", at(1)).alias("category_name"), at(2).alias("subcategory_name"), F.coalesce("p.description", meta(F.col("html"), "description")).alias("description"), F.coalesce("p.image", meta(F.col("html"), "og:image")).alias("image_url"), t.price_int(F.col("p.price")).alias("price"), F.lit("json_ld").alias("found_by"))
    body = t.strip_html(F.col("html"))
    none = F.lit(None).cast("string")
    b = d.where((F.size("ld.products") == 0) & t.product_like(F.col("url"))).select("page_id", "url", title(F.col("html")).alias("product_name"), none.alias("brand"), found(body, r"(?i)\b(?:ref(?:erencia)?|codigo|mpn)\b\s*[.:#]\s*([A-Za-z0-9][A-Za-z0-9\-./]{2,})").alias("reference"), found(body, r"(?i)\bsku\b\s*[.:#]?\s*([A-Za-z0-9][A-Za-z0-9\-./]{1,})").alias("sku"), none.alias("category_name"), none.alias("subcategory_name"), meta(F.col("html"), "description").alias("description"), meta(F.col("html"), "og:image").alias("image_url"), F.lit(None).cast("long").alias("price"), F.lit("page").alias("found_by"))
    return a.unionByName(b.where(F.col("product_name").isNotNull()))


def category_records(pages: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    name = title(F.col("html"))
    d = pages.where(t.category_like(F.col("url")) & ~t.ignored(F.col("url"), excluded) & name.isNotNull())
    return d.select("page_id", "url", name.alias("category_name"), F.lit("category_only").alias("match_type"))


def enriched(records: DataFrame, pages: DataFrame, fields: list[str]) -> DataFrame:
    """Records with what their own page says in place of what the listing said; ``warnings`` names what neither has."""
    p = pages.select(F.col("url").alias("_u"), *(F.col(f).alias(f"_{f}") for f in fields))
    d = records.join(p, F.col("url") == F.col("_u"), "left")
    d = d.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop("_u", *(f"_{f}" for f in fields))
    return d.withColumn("warnings", F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f"missing_{f}")) for f in fields))))


# -- blocks, cards, listings ----------------------------------------------------------


def blocks(html: Column, start: str) -> Column:
    """Parts of a page that begin with a marker (a pattern), up to the next one."""
    return F.filter(F.split(t.text(html), f"(?={start})"), lambda b: b.rlike(f"(?s)^{start}"))


def cards(pages: DataFrame, start: str, fields: dict[str, str], required: str) -> DataFrame:
    """A row for each card of each page: fields by patterns; cards without ``required`` are none."""
    d = pages.select("page_id", "url", F.posexplode(blocks(F.col("html"), start)).alias("pos", "b"))
    return d.select("page_id", "url", "pos", *(found(F.col("b"), p).alias(n) for n, p in fields.items())).where(F.col(required).isNotNull())


def numeric_code(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^\d{3,}$"), F.trim(x))


def attributes(x: Column) -> Column:
    """``LABEL: value`` pairs as a map, later ones win."""
    keys, values = (F.regexp_extract_all(t.text(x), F.lit(r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]+):\s*(.*?)(?=\s+[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]+:|$)"), F.lit(k)) for k in (1, 2))
    return _last_wins(F.zip_with(keys, values, lambda k, v: F.struct(F.trim(k).alias("key"), F.trim(v).alias("value"))))


def _last_wins(entries: Column) -> Column:
    """Entries as a map; of equal keys the last one counts."""
    ordered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    kept = t.bound(ordered, lambda x: F.filter(x, lambda e: ~F.exists(x, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"]))))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def labelled_rows(html: Column) -> Column:
    """Table rows of a page (``th``, ``td``) as a map, later ones win."""
    row = r"(?is)<tr[^>]*>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"
    keys, values = (F.regexp_extract_all(t.text(html), F.lit(row), F.lit(k)) for k in (1, 2))
    return _last_wins(F.zip_with(keys, values, lambda k, v: F.struct(t.strip_html(k).alias("key"), t.strip_html(v).alias("value"))))


def category_slugs(css: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t.text(css), F.lit(r"product_cat-([\w-]+)"), F.lit(1)))


def category_names(slugs: Column, top: Column, names: Column) -> tuple[Column, Column]:
    """Category and subcategory of slugs: the first top-level one, and the first other."""
    is_top = F.filter(slugs, lambda s: F.array_contains(top, s))
    main = F.coalesce(F.try_element_at(is_top, F.lit(1)), F.try_element_at(slugs, F.lit(1)))
    sub = F.try_element_at(F.filter(slugs, lambda s: s != main), F.lit(1))
    shown = lambda s: F.coalesce(F.try_element_at(names, s), t.slug_name(s))
    return F.when(main.isNotNull(), shown(main)), F.when(sub.isNotNull(), shown(sub))


def code_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(t.text(name), r"\(([A-Za-z0-9][A-Za-z0-9\-./ ]{2,})\)", 1), F.lit(""))


def heading_parts(heading: Column) -> Column:
    """brand, line and series of a heading like "Brand Line – Series 1"."""
    h = t.strip_html(heading)
    parts = F.split(h, r"\s+[-–|:]\s+|\s+(?=(?i:serie)\b)", 2)
    words = F.split(F.element_at(parts, 1), " ", 2)
    return F.when(h != "", F.struct(F.element_at(words, 1).alias("brand"), F.try_element_at(words, F.lit(2)).alias("line"), F.try_element_at(parts, F.lit(2)).alias("series")))


def first_keyword(x: Column, keywords: dict[str, str], default: str | None = None) -> Column:
    """The label of the first keyword that a normalised text contains."""
    out, low = F, t.normalize(x)
    for k, label in keywords.items():
        out = out.when(low.contains(k), label)
    return out.otherwise(default) if default is not None else out


def catalog_match_type(reference: Column, vehicle_text: Column, vehicle_words: tuple[str, ...] = ("modelo", "compatible", "aplicacion", "vehiculo")) -> Column:
    """Match type, confidence and need of confirmation of a catalog record."""
    exact, vehicle = t.present(reference).isNotNull(), t.matches_any(t.normalize(vehicle_text), vehicle_words)
    kind = F.when(exact, "exact_reference").when(vehicle, "vehicle_compatible").otherwise("category_only")
    return F.struct(kind.alias("match_type"), F.when(exact, "high").when(vehicle, "medium").otherwise("low").alias("confidence"), (~exact).alias("requires_manual_confirmation"))


# -- quote pages ------------------------------------------------------------------------


def label_value(html: Column, label: str) -> Column:
    """The text that follows a label's element."""
    return found(html, rf"(?is)>\s*{re.escape(label)}\s*:?\s*</[^>]+>\s*<[^>]+>(.*?)</")


def section(html: Column, label: str, others: list[str]) -> Column:
    """What stands between a label and the next one."""
    stop = "|".join(re.escape(o) for o in others if o != label) or r"\z"
    return F.regexp_extract(t.text(html), rf"(?is){re.escape(label)}(.*?)(?={stop}|\z)", 1)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in any of three quoting styles."""
    pats = [rf"(?i)\b{name}\s*=\s*\"([^\"]*)\"", rf"(?i)\b{name}\s*=\s*'([^']*)'", rf"(?i)\b{name}\s*=\s*([^\s\"'>]+)"]
    return F.coalesce(*(F.nullif(F.regexp_extract(t.text(tag), p, 1), F.lit("")) for p in pats))


def visible(tag: Column) -> Column:
    return ~t.text(tag).rlike(r"(?i)\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")


def quote_parts(pages: DataFrame, start: str, fields: dict[str, str], needed: tuple[str, ...]) -> DataFrame:
    """Parts of quote pages by block: their fields, and raw_status loaded or partial_missing_<fields>."""
    d = pages.select("page_id", "url", F.posexplode(blocks(F.col("html"), start)).alias("pos", "b"))
    d = d.select("page_id", "url", "pos", *(found(F.col("b"), p).alias(n) for n, p in fields.items()))
    lack = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in needed)))
    return d.withColumn("raw_status", F.when(F.size(lack) == 0, "loaded").otherwise(F.concat(F.lit("partial_missing_"), F.array_join(lack, "_"))))


def quotes(pages: DataFrame, parts: DataFrame, header: dict[str, str]) -> DataFrame:
    """One row for each quote page: header fields, parts in order, load_status and warnings."""
    g = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in parts.columns if c not in ("page_id", "url", "pos")]))).alias("parts"))
    d = pages.select("page_id", "url", *(found(F.col("html"), p).alias(n) for n, p in header.items())).join(g, "page_id", "left")
    bad = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(f"missing_{n}")) for n in header), F.when(F.coalesce(F.size("parts"), F.lit(0)) <= 0, F.lit("no_parts"))))
    return d.withColumn("warnings", bad).withColumn("load_status", F.when(F.size("warnings") == 0, "loaded").otherwise("partial"))


def page_state(html: Column, shell: str, part: str, footer: str, notice: str) -> Column:
    """ready, empty, loaded or waiting."""
    has = lambda s: t.text(html).contains(s)
    return F.when(has(shell) & has(part), "ready").when(has(shell) & has(footer) & ~has(notice), "empty").when(has(shell), F.when(has(footer), "ready").otherwise("loaded")).otherwise("waiting")


# -- mail -----------------------------------------------------------------------------------

MESSAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("internalDate", T.StringType()), T.StructField("payload", T.StringType())])


def mail_bodies():
    """UDF: HTML and plain bodies of a JSON payload's MIME tree, depth first."""

    @F.pandas_udf("struct<html:array<string>,text:array<string>>")
    def run(payloads):
        import base64

        import pandas as pd

        def decode(data):
            try:
                return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
            except ValueError:
                return ""

        def walk(node, html, plain):
            if not isinstance(node, dict):
                return
            data = (node.get("body") or {}).get("data")
            if data:
                kind = str(node.get("mimeType") or "")
                (html if kind == "text/html" else plain if kind == "text/plain" else []).append(decode(data))
            for part in node.get("parts") or []:
                walk(part, html, plain)

        rows = []
        for raw in payloads:
            html, plain = [], []
            try:
                walk(json.loads(raw or "null"), html, plain)
            except ValueError:
                pass
            rows.append({"html": html, "text": plain})
        return pd.DataFrame(rows, columns=["html", "text"])

    return run


def anchors(html: Column) -> Column:
    """href, text, title and aria_label of each anchor, in order."""
    whole = F.regexp_extract_all(t.text(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    return F.transform(whole, lambda a: F.struct(t.unescape_html(attribute(F.regexp_extract(a, "(?is)^<a[^>]*>", 0), "href")).alias("href"), t.strip_html(a).alias("text"), attribute(F.regexp_extract(a, "(?is)^<a[^>]*>", 0), "title").alias("title"), attribute(F.regexp_extract(a, "(?is)^<a[^>]*>", 0), "aria-label").alias("aria_label")))


def anchor_excerpt(anchor: Column) -> Column:
    """An anchor (href, text) for a log: the query of its address hidden, markup escaped."""
    return F.concat(F.lit('<a href="'), t.escape_html(t.mask_query(anchor["href"])), F.lit('">'), t.escape_html(t.text(anchor["text"])), F.lit("</a>"))


def is_quote_url(url: Column, quote_host: str, path: str) -> Column:
    """http(s), exactly this host and path, and a query."""
    part = lambda p: F.coalesce(F.try_parse_url(url, F.lit(p)), F.lit(""))
    return F.lower(part("PROTOCOL")).isin("http", "https") & (F.lower(part("HOST")) == quote_host) & (F.rtrim(part("PATH")) == path) & (part("QUERY") != "")


def quote_urls(html: Column, wanted: str, quote_host: str, path: str) -> Column:
    """Quote links of a mail: those whose visible text says ``wanted``, else whose title or label does; in order, each once."""
    every = F.filter(anchors(html), lambda a: is_quote_url(a["href"], quote_host, path))
    says = lambda x: t.normalize(x).contains(wanted)
    shown = F.filter(every, lambda a: says(a["text"]))
    labelled = F.filter(every, lambda a: says(a["title"]) | says(a["aria_label"]))
    return F.array_distinct(F.transform(F.when(F.size(shown) > 0, shown).otherwise(labelled), lambda a: a["href"]))


def messages(mails: DataFrame, expected_sender: str, wanted: str, quote_host: str, path: str) -> DataFrame:
    """Mails (id, internalDate, payload as JSON) with sender, subject, time, quote links and status."""
    headers = F.from_json(F.get_json_object("payload", "$.headers"), "array<struct<name:string,value:string>>")
    d = mails.select("id", "internalDate", headers.alias("h"), mail_bodies()("payload").alias("body"))
    d = d.select("id", F.col("internalDate").alias("internal_date_ms"), t.sender(t.header_value(F.col("h"), "from")).alias("sender"), t.header_value(F.col("h"), "subject").alias("subject"), t.received_at(t.header_value(F.col("h"), "date"), F.col("internalDate")).alias("received_at"), quote_urls(F.array_join("body.html", "\n"), wanted, quote_host, path).alias("quote_urls"))
    status = F.when(F.col("sender") != expected_sender, "sender_mismatch").when(F.size("quote_urls") == 0, "link_not_found").otherwise("extracted")
    return d.withColumn("status", status).withColumn("quote_keys", F.transform("quote_urls", lambda u: t.quote_key(F.col("id"), u)))
