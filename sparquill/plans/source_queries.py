"""Landed pages, mails, API answers and catalogs: documents that are made from the tables and read back as records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import snapshots, views
from ..operators.ranks import placed
from ..shared import dealt, shared_folder, staged
from ..sources import cards, catalogs, documents, pages, search
from .registry import query

_s = lambda c: F.col(c).cast("string")


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS ty, p_size AS s, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part WHERE p_partkey % 4 <> 3)
SELECT k AS page_id, n || ' ' || k AS product_name, CASE WHEN k % 4 < 2 THEN b END AS brand, 'REF-' || k AS reference, CASE WHEN k % 4 = 1 THEN NULL ELSE 'SKU' || k END AS sku, CASE k % 4 WHEN 0 THEN ty WHEN 1 THEN 'Luces' END AS category_name, CASE WHEN k % 4 = 1 THEN ty END AS subcategory_name,
CASE WHEN k % 4 = 0 THEN 'd ' || s ELSE 'About ' || s END AS description, 'http://i.example.com/' || k || '.png' AS image_url, CASE WHEN k % 4 < 2 THEN price END AS price, CASE WHEN k % 4 < 2 THEN 'json_ld' ELSE 'page' END AS found_by FROM p""")  # fmt: skip
def q_product_pages(read, spark):
    """Products of pages with JSON-LD, with a graph and breadcrumbs, and without either."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), _s("p_partkey"))
    price = F.concat(F.lit("$ "), F.replace(F.format_number(F.floor("p_retailprice"), 0), F.lit(","), F.lit(".")))
    one = F.format_string(
        '<script type="application/ld+json">{"@type":"Product","name":"%s","brand":{"name":"%s"},"sku":"SKU%d","mpn":"REF-%d","category":"%s","description":"d %d","image":["http://i.example.com/%d.png"],"offers":[{"price":"%s"}]}</script>',
        name, "p_brand", k, k, "p_type", "p_size", k, price,
    )
    graph = F.format_string(
        '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"%s","brand":"%s","mpn":"REF-%d","offers":{"price":"%s"}},{"@type":"BreadcrumbList","itemListElement":[{"name":"Inicio"},{"name":"Luces"},{"item":{"name":"%s"}}]}]}</script><script type="application/ld+json">no json</script>',
        name, "p_brand", k, price, "p_type",
    )
    head = F.format_string('<html><head><meta name="description" content="About %d"><meta property="og:image" content="http://i.example.com/%d.png">', "p_size", k)
    plain = F.concat(F.lit("<h1>"), name, F.lit("</h1><p>Referencia: <b>REF-"), _s("p_partkey"), F.lit("</b> SKU: SKU"), _s("p_partkey"), F.lit("</p>"))
    html = F.concat(head, F.when(k % 4 == 0, one).when(k % 4 == 1, graph).otherwise(""), F.lit("</head><body>"), plain, F.lit("</body></html>"))
    url = F.concat(F.lit("https://shop.example.com"), F.when(k % 4 == 3, "/about/").otherwise("/producto/"), _s("p_partkey"))
    got = pages.product_records(read("part").select(k.alias("page_id"), url.alias("url"), html.alias("html")))
    return got.drop("url")


@query("""WITH x AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS a FROM supplier), c AS (SELECT n, COUNT(*) AS cards, string_agg(k || ':' || CASE WHEN k >= 100 THEN CAST(k AS VARCHAR) ELSE '-' END || ':' || CAST(abs(floor(a)) AS BIGINT), ',' ORDER BY k) AS said FROM x WHERE k % 5 <> 4 GROUP BY n)
SELECT n_nationkey AS page_id, COALESCE(c.cards, 0) AS cards, COALESCE(c.said, '') AS said, 'Nation ' || n_name AS category_name, GREATEST(n_nationkey % 7 + 1, 1) AS last_page, 2 AS links, 1 AS pdfs FROM nation LEFT JOIN c ON n = n_nationkey""")  # fmt: skip
def q_listing_pages(read, spark):
    """Cards, category, last page, links and documents of listing pages, one page for each nation."""
    k = F.col("s_suppkey")
    card = F.concat(
        F.lit('<div class="card"><a class="n">'), F.when(k % 5 != 4, F.concat(F.lit("Supplier "), _s("s_suppkey"))).otherwise(" "), F.lit("</a><i>"), _s("s_suppkey"), F.lit("</i><em>$ "), F.format_number(F.abs(F.floor("s_acctbal")), 0), F.lit("</em></div>")
    )
    body = read("supplier").groupBy(F.col("s_nationkey").alias("_n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), card.alias("c")))), lambda x: x["c"]), "\n").alias("cards"))
    d = read("nation").join(body, F.col("n_nationkey") == F.col("_n"), "left")
    foot = F.concat(F.lit('<a href="?page=1">1</a><a href="/categoria/x?page='), (F.col("n_nationkey") % 7 + 1).cast("string"), F.lit('">last</a><a href="docs/list.PDF?v=1">pdf</a><a href="#top">top</a><a href="/feed/">feed</a>'))
    one = d.select(F.col("n_nationkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/categoria/n"), _s("n_nationkey"), F.lit("?page=1")).alias("url"), F.concat(F.lit("<title>Nation "), "n_name", F.lit(" | Shop</title>"), F.coalesce("cards", F.lit("")), foot).alias("html"))
    found = pages.cards(one, '<div class="card">', {"name": r'(?is)class="n">(.*?)</a>', "code": "(?is)<i>(.*?)</i>", "price": "(?is)<em>(.*?)</em>"}, "name")
    said = F.concat_ws(":", F.regexp_extract("name", r"(\d+)", 1), F.coalesce(pages.numeric_code(F.col("code")), F.lit("-")), t.price_int(F.col("price")).cast("string"))
    g = found.groupBy(F.col("page_id").alias("_p")).agg(F.count("*").alias("cards"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), ",").alias("said"))
    cats = pages.category_records(one).select(F.col("page_id").alias("_c"), "category_name")
    links = pages.links(F.col("html"), F.col("url"))
    out = one.join(g, F.col("page_id") == F.col("_p"), "left").join(cats, F.col("page_id") == F.col("_c"), "left")
    return out.select("page_id", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("said", F.lit("")).alias("said"), "category_name", views.max_page(F.col("html")).cast("long").alias("last_page"), (F.size(links) - 1).cast("long").alias("links"), F.size(pages.pdf_links(F.col("html"), F.col("url"))).cast("long").alias("pdfs"))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
g AS (SELECT c, string_agg('Pieza & ' || k || ':' || n || ':' || CASE WHEN k % 3 = 0 THEN 'partial_missing_price' ELSE 'loaded' END, ';' ORDER BY n) AS parts FROM o GROUP BY c)
SELECT c_custkey AS page_id, CASE WHEN g.c IS NOT NULL THEN 'ready' WHEN c_custkey % 4 = 1 THEN 'ready' WHEN c_custkey % 4 = 2 THEN 'loaded' ELSE 'empty' END AS state, 'A-' || c_custkey AS notice, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS brand,
COALESCE(g.parts, '') AS parts, CASE WHEN g.c IS NOT NULL AND c_custkey % 5 <> 0 THEN 'loaded' ELSE 'partial' END AS load_status, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'missing_brand' END, CASE WHEN g.c IS NULL THEN 'no_parts' END) AS warnings FROM customer LEFT JOIN g ON c = c_custkey""")  # fmt: skip
def q_quote_pages(read, spark):
    """Quote pages with their header, parts by block, and what is missing: a page for each customer, a part for each order."""
    k = F.col("o_orderkey")
    rows = read("orders").groupBy(F.col("o_custkey").alias("_c")).agg(F.array_sort(F.collect_list(k)).alias("ks"))
    block = lambda x, i: F.concat(F.lit('<li class="part"><b class="n">Pieza &amp; '), x.cast("string"), F.lit('</b><i class="q">'), (i + 1).cast("string"), F.lit("</i>"), F.when(x % 3 == 0, "<u></u>").otherwise("<u>$ 10</u>"), F.lit("</li>"))
    d = read("customer").join(rows, F.col("c_custkey") == F.col("_c"), "left")
    c = F.col("c_custkey")
    # without parts, a page has a notice, no footer, or neither notice nor parts
    foot = F.when(F.col("ks").isNull() & (c % 4 == 2), "").when(F.col("ks").isNull() & (c % 4 == 1), "<footer>Total</footer><p>Sin avisos</p>").otherwise("<footer>Total</footer>")
    head = F.concat(F.lit('<main class="shell"><span>Aviso:</span> <b>A-'), _s("c_custkey"), F.lit("</b><span>Marca</span><b>"), F.when(c % 5 != 0, F.col("c_mktsegment")).otherwise(" "), F.lit("</b><ul>"))
    page = d.select(c.alias("page_id"), F.concat(F.lit("https://q.example.com/ver?id="), _s("c_custkey")).alias("url"), F.concat(head, F.coalesce(F.array_join(F.transform("ks", block), ""), F.lit("")), F.lit("</ul>"), foot).alias("html"))
    parts = pages.quote_parts(page, '<li class="part">', {"name": '(?is)class="n">(.*?)</b>', "quantity": '(?is)class="q">(.*?)</i>', "price": "(?is)<u>(.*?)</u>"}, ("name", "price"))
    value = lambda label: rf"(?is)>\s*{label}\s*:?\s*</[^>]+>\s*<[^>]+>(.*?)</"
    got = pages.quotes(page, parts, {"notice": value("Aviso"), "brand": value("Marca")})
    state = page.select(F.col("page_id").alias("_p"), pages.page_state(F.col("html"), 'class="shell"', 'class="part"', "<footer>", "Sin avisos").alias("state"))
    said = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["name"], p["quantity"], p["raw_status"])), ";")
    return got.join(state, F.col("page_id") == F.col("_p")).select("page_id", "state", "notice", "brand", F.coalesce(said, F.lit("")).alias("parts"), "load_status", F.array_join("warnings", ",").alias("warnings"))


@query("""WITH c AS (SELECT c_custkey AS k, 'https://q.example.com/ver?id=' || c_custkey || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE '&t=abc' END AS url FROM customer)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 4 = 2 THEN 'other@example.com' ELSE 'quotes@example.com' END AS sender, 'Aviso_' || k || '_SURA' AS subject, 'SURA' AS insurer, CASE WHEN k % 3 = 0 THEN '2026-01-05T15:00:00+00:00' ELSE strftime(make_timestamp((1700000000 + k) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS received_at,
CASE WHEN k % 4 <> 3 THEN url ELSE '' END AS urls, CASE WHEN k % 4 <> 3 THEN substr(sha256(k || chr(10) || url), 1, 24) ELSE '' END AS keys, CASE k % 4 WHEN 2 THEN 'sender_mismatch' WHEN 3 THEN 'link_not_found' ELSE 'extracted' END AS status, CASE WHEN k % 4 <> 3 THEN 'https://q.example.com/ver?[redacted]' ELSE '' END AS masked FROM c""")  # fmt: skip
def q_mails(read, spark):
    """Mails with nested MIME parts: sender, time, quote links by visible text or by title, status."""
    k, s = F.col("c_custkey"), _s("c_custkey")
    shown = F.concat(F.lit('<p><a class="b" href="https://q.example.com/ver?id='), s, F.lit('&amp;t=abc">Ver <b>Cotización</b></a><a title="ver cotizacion" href="https://q.example.com/ver?id=no">Otro</a></p>'))
    titled = F.concat(F.lit("<a title=\"Ver cotizacion\" href='https://q.example.com/ver?id="), s, F.lit("'><img src=x></a>"))
    html = F.when(k % 4 == 1, titled).when(k % 4 == 3, '<a href="https://other.example.com/ver?id=1">Ver cotizacion</a>').otherwise(shown)
    coded = F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(html, "UTF-8")), r"\s", ""), "+/", "-_"), F.lit("="))
    sender = F.when(k % 4 == 2, "Other <OTHER@example.com>").otherwise("Quotes <Quotes@Example.com>")
    date = F.when(k % 3 == 0, '{"name":"DATE","value":"Mon, 5 Jan 2026 10:00:00 -0500 (COT)"},').otherwise("")
    payload = F.concat(
        F.lit('{"headers":['), date, F.lit('{"name":"From","value":"'), sender, F.lit('"},{"name":"Subject","value":"Aviso_'), s, F.lit('_SURA"}],"mimeType":"multipart/mixed","parts":[{"mimeType":"text/plain","body":{"data":"aG9sYQ"}},{"mimeType":"multipart/alternative","parts":[{"mimeType":"text/html","body":{"data":"'), coded, F.lit('"}}]}]}'),
    )
    mails = read("customer").select(s.alias("id"), (F.lit(1_700_000_000_000) + k * 1000).cast("string").alias("internalDate"), payload.alias("payload"))
    got = pages.messages(mails, "quotes@example.com", "ver cotizacion", "q.example.com", "/ver")
    masked = F.array_join(F.transform("quote_urls", t.mask_query), ",")
    return got.select("id", "sender", "subject", t.insurer(F.col("subject")).alias("insurer"), "received_at", F.array_join("quote_urls", ",").alias("urls"), F.array_join("quote_keys", ",").alias("keys"), "status", masked.alias("masked"))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_name AS n, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part WHERE p_partkey % 5 <> 4)
SELECT k AS card_id, CASE WHEN k % 5 = 2 THEN 'RX-' || k ELSE n || ' para varios modelos de camion ' || k END AS title, CASE k % 5 WHEN 0 THEN b WHEN 1 THEN 'ACDELCO' WHEN 2 THEN 'KIA MOTORS' ELSE NULL END AS brand, CASE WHEN k % 5 IN (0, 2) THEN 'RX-' || k END AS reference,
CASE k % 5 WHEN 0 THEN 'Desde $ ' || price || ' con empaque y garantia de fabrica' WHEN 1 THEN '$' || price || ' con empaque y garantia de fabrica' WHEN 2 THEN 'KIA MOTORS' ELSE 'con empaque y garantia de fabrica' END AS description,
CASE k % 5 WHEN 0 THEN 'https://shop.example.com/producto/' || k WHEN 1 THEN 'https://shop.example.com/otra/' || k END AS detail_url, CASE WHEN k % 5 = 0 THEN 'https://i.example.com/' || k END AS image_url FROM p""")  # fmt: skip
def q_card_lines(read, spark):
    """Cards by their lines of text: noise, the line of the brand, title, reference, price, the best link."""
    k, s = F.col("p_partkey"), _s("p_partkey")
    price, title, tail = F.floor("p_retailprice").cast("string"), F.concat("p_name", F.lit(" para varios modelos de camion "), s), F.lit("con empaque y garantia de fabrica")
    lines = (
        F.when(k % 5 == 0, F.array(F.lit("Agotado"), F.concat(F.lit("Marca: "), "p_brand"), F.col("p_brand"), title, F.concat(F.lit("N° de parte: RX-"), s), F.concat(F.lit("Desde $ "), price, F.lit("")), tail))
        .when(k % 5 == 1, F.array(F.lit("ACDELCO"), title, F.concat(F.lit("$"), price), F.lit("•"), tail, F.lit("Ver detalle")))
        .when(k % 5 == 2, F.array(F.lit("KIA MOTORS"), F.concat(F.lit("Nº de parte: RX-"), s), F.lit("Entrega: hoy")))
        .when(k % 5 == 3, F.array(F.lit(" "), title, tail, F.lit("Cantidad: 1")))
        .otherwise(F.array(F.lit("Confirmar"), F.lit("-")))
    )
    links = F.when(k % 5 == 0, F.array(F.lit("/otra/1"), F.concat(F.lit("/producto/"), s), F.lit("/otra/2"))).when(k % 5 == 1, F.array(F.lit("/feed/x"), F.lit("/uno"), F.concat(F.lit("/otra/"), s))).when(k % 5 == 2, F.array(F.lit("https://elsewhere.example.com/producto/1")))
    images = F.when(k % 5 == 0, F.array(F.lit("data:x"), F.concat(F.lit(" https://i.example.com/"), s)))
    d = dealt(read("part"), "p_partkey").select(k.alias("card_id"), F.lit("https://shop.example.com/list?groups=Frenos").alias("seed_url"), F.array_join(lines, "\r\n").alias("text"), links.alias("links"), images.alias("images"))
    got = cards.card_records(d, "shop.example.com")
    # the whole text of a card that says a brand and a reference alone is its description
    return got.withColumn("description", F.when(F.col("card_id") % 5 == 2, F.regexp_extract("description", "^(KIA MOTORS)", 1)).otherwise(F.col("description")))


def _product(x):
    """A product of the search API, made from a part."""
    k, s = x["p_partkey"], x["p_partkey"].cast("string")
    none = F.lit(None).cast("string")
    size = x["p_size"].cast("string")
    item = F.struct(F.when(k % 2 == 0, F.concat(F.lit("I"), s)).alias("itemId"), none.alias("ean"), F.when(k % 3 == 1, F.array(F.struct(F.lit("RefId").alias("Key"), F.concat(F.lit("RI"), s).alias("Value")))).alias("referenceId"), F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("http://i.example.com/item"), s).alias("imageUrl")))).alias("images"))
    paths = (
        F.when(k % 4 == 0, F.array(F.lit("/otros/x/")))
        .when(k % 4 == 1, F.array(F.lit("/categorias/"), F.lit("/categorias/frenos-de-disco/")))
        .otherwise(F.array(F.lit("/categorias/uno/"), F.concat(F.lit("/categorias/autos/"), F.lower(x["p_type"]), F.lit("/talla-"), size, F.lit("/"))))
    )
    specs = F.array(F.struct(F.lit("Ficha").alias("name"), F.array(F.struct(F.lit("Talla").alias("name"), F.array(F.concat(size, F.lit(" cm"))).alias("values"))).alias("specifications")))
    more = F.when((k % 3 == 2) & (k % 5 == 0), F.array(F.struct(F.lit("Modelo").alias("name"), F.array(F.lit("2015")).alias("values"))))
    return F.struct(
        F.concat(F.lit("P"), s).alias("productId"), F.when(k % 7 != 6, F.concat(x["p_name"], F.lit(" "), s)).alias("productName"), F.when(k % 3 == 0, F.concat(F.lit(" PR"), s)).alias("productReference"), x["p_brand"].alias("brand"), F.concat(F.lit("/x"), s, F.lit("/p#top")).alias("link"),
        F.lit("<p>Texto</p>").alias("description"), F.concat(F.lit("http://i.example.com/own"), s).alias("image"), paths.alias("categories"), F.array(item).alias("items"), specs.alias("specificationGroups"), more.alias("properties"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS ty, p_size AS s FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS i, COUNT(*) OVER (PARTITION BY b) AS total FROM p)
SELECT b AS surface, (i // 10) * 10 AS "offset", n || ' ' || k AS product_name, 'https://shop.example.com/x' || k || '/p' AS detail_url, CASE k % 3 WHEN 0 THEN 'PR' || k WHEN 1 THEN 'RI' || k END AS reference, CASE WHEN k % 2 = 0 THEN 'I' || k ELSE 'P' || k END AS sku, 'http://i.example.com/' || CASE WHEN k % 2 = 0 THEN 'item' ELSE 'own' END || k AS image_url,
CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'frenos de disco' ELSE lower(ty) END AS category_name, CASE WHEN k % 4 IN (2, 3) THEN 'talla ' || s END AS subcategory_name, 'Ficha Talla ' || s || ' cm' || CASE WHEN k % 3 = 2 AND k % 5 = 0 THEN ' Modelo 2015' ELSE '' END AS specification_text,
CASE WHEN k % 3 < 2 THEN 'exact_reference' WHEN k % 5 = 0 THEN 'vehicle_compatible' ELSE 'category_only' END AS match_type, CASE WHEN k % 3 < 2 THEN 'high' ELSE 'medium' END AS confidence, k % 3 = 2 AS manual FROM r WHERE k % 7 <> 6""")  # fmt: skip
def q_search_products(read, spark):
    """Pages of a search API's answers, ten products each, as records; pages after the end and products without a name don't count."""
    kind = T._parse_datatype_string(search.ANSWER)["products"].dataType.elementType
    rows = placed(read("part").select("p_brand", "p_partkey", "p_name", "p_type", "p_size"), [F.col("p_brand"), F.col("p_partkey")])
    same = F.col("p_brand").eqNullSafe(F.col("_brand"))
    totals = staged(rows.groupBy(F.col("p_brand").alias("_brand")).agg(F.min("place").alias("first"), F.count("*").alias("total")), "totals")
    page = F.floor((F.col("place") - F.col("first")) / 10) * 10
    pages_of = dealt(rows.join(totals, same).withColumn("offset", page), "p_brand", "offset").groupBy("p_brand", "offset", "total").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_type", "p_size"))).alias("ps"))
    # one page more than there is: an empty one
    last = totals.select(F.col("_brand").alias("p_brand"), (F.ceil(F.col("total") / 10) * 10).alias("offset"), "total", F.array().cast(pages_of.schema["ps"].dataType).alias("ps"))
    walked = pages_of.unionByName(last)
    text = F.to_json(F.struct(F.col("total").alias("recordsFiltered"), F.transform("ps", lambda x: _product(x).cast(kind)).alias("products"), F.lit("x").alias("other")))
    answers = walked.select(F.col("p_brand").alias("surface"), F.col("offset").cast("long").alias("offset"), F.from_json(text, search.ANSWER).alias("doc"))
    got = search.records(search.complete_pages(answers, 10), "https://shop.example.com/")
    return got.select("surface", "offset", "product_name", "detail_url", "reference", "sku", "image_url", "category_name", "subcategory_name", "specification_text", "match_type", F.col("match_confidence").alias("confidence"), F.col("requires_manual_confirmation").alias("manual"))


#: Kinds of catalogs of the providers c0 to c6; c7 isn't registered.
KINDS = ["seeded", "groups", "services", "store", "cards", "fallback_lists", "partial"]


def landed_catalogs(read, spark) -> str:
    """Snapshots of eight providers as JSON files in a folder, of two dates each; the later ones count."""
    k, s = F.col("p_partkey"), _s("p_partkey")
    product = F.struct(
        F.concat("p_name", F.lit(" "), s).alias("product_name"), F.col("p_brand").alias("brand"), F.concat(F.lit("R"), s).alias("reference"), F.concat(F.lit("S"), s).alias("sku"), F.concat(F.lit("C"), s).alias("supplier_item_code"), F.col("p_type").alias("category_name"), F.lit("filtro").alias("taxonomy_label"),
        F.concat(F.lit("http://x/"), s).alias("detail_url"), F.array(F.concat(F.lit("Tok"), s)).alias("searchable_tokens"),
    )
    family = F.struct(F.concat(F.lit("Familia "), s).alias("category_name"), F.concat(F.lit("http://f/"), s).alias("category_url"))
    group = F.struct(F.col("p_type").alias("category_name"), F.array("p_name", F.concat(F.lit("Otro "), s)).alias("product_names"), F.create_map(F.col("p_name"), F.array(F.struct(F.lit("A").alias("name")), F.struct(F.col("p_brand").alias("name")))).alias("brands_by_product"))
    series = F.struct(F.col("p_brand").alias("brand"), F.concat(F.lit("Linea "), _s("p_size")).alias("line"), F.concat(F.lit("Z"), s).alias("series_label"))
    at = F.concat(F.lit("c"), (k % 8).cast("string"))
    mine = lambda n, x: F.collect_list(F.when(k % 8 == n, x)) if isinstance(n, int) else F.collect_list(F.when((k % 8).isin(*n), x))
    d = read("part").groupBy(at.alias("provider")).agg(
        mine((0, 3, 4, 6, 7), product).alias("products"), mine(1, group).alias("groups"), mine(0, family).alias("categories"), mine(2, series).alias("service_series"), mine(5, product).alias("catalog_products"),
    )
    # a provider of groups has them in the place of products
    empty = F.lit("[]")
    lists = F.when(F.size("groups") > 0, F.to_json("groups")).when(F.size("products") > 0, F.to_json("products")).otherwise(empty)
    said = lambda c: F.coalesce(F.when(F.size(c) > 0, F.to_json(c)), empty)
    doc = F.concat(F.lit('{"snapshot_date":"2026-06-02","notes":["b","a"],"products":'), lists, F.lit(',"categories":'), said("categories"), F.lit(',"service_series":'), said("service_series"), F.lit(',"catalog_products":'), said("catalog_products"), F.lit("}"))
    root = f"{shared_folder(spark)}/catalogs-{uuid.uuid4().hex}"
    both = d.select("provider", F.explode(F.array(F.struct(F.lit("2026-06-02").alias("date"), doc.alias("value")), F.struct(F.lit("2026-05-01-full").alias("date"), F.lit('{"products":[{"product_name":"old"}]}').alias("value")))).alias("x")).select("provider", "x.date", "x.value")
    both.repartition("provider", "date").write.partitionBy("provider", "date").text(root)
    return root


_CAT = "SELECT p_partkey AS k, p_name || ' ' || p_partkey AS title, p_type AS ty, p_brand AS b, p_size AS s, p_name AS n, 'c' || (p_partkey % 8) AS pid FROM part WHERE p_partkey % 8 <> 7"


@query(f"""WITH p AS ({_CAT}), i AS (
SELECT pid, 'product_catalog' AS kind, title, ty AS category_name, b AS brand, 'R' || k AS reference, CASE WHEN k % 8 <> 4 THEN 'S' || k END AS sku, 'C' || k AS code, 'http://x/' || k AS url, 'tok' || k AS word, FALSE AS manual FROM p WHERE k % 8 IN (0, 3, 4, 5)
UNION ALL SELECT pid, 'category_only', 'Familia ' || k, 'Familia ' || k, NULL, NULL, NULL, NULL, 'http://f/' || k, 'familia', TRUE FROM p WHERE k % 8 = 0
UNION ALL SELECT pid, 'category_only', n, ty, 'A, ' || b, NULL, NULL, NULL, NULL, string_split(n, ' ')[1], TRUE FROM p WHERE k % 8 = 1
UNION ALL SELECT pid, 'category_only', 'Otro ' || k, ty, NULL, NULL, NULL, NULL, NULL, 'otro', TRUE FROM p WHERE k % 8 = 1
UNION ALL SELECT pid, 'category_only', b || ' Linea ' || s || ' Z' || k, NULL, b, 'Z' || k, NULL, NULL, NULL, 'linea', TRUE FROM p WHERE k % 8 = 2
UNION ALL SELECT pid, 'product_catalog_partial', title, 'filtro', NULL, NULL, NULL, 'C' || k, 'http://x/' || k, 'tok' || k, TRUE FROM p WHERE k % 8 = 6)
SELECT pid AS provider_id, upper(pid) AS provider_name, kind AS provider_type, title, category_name, brand, reference, sku, code, url AS detail_url, TRUE AS has_word, manual, 'x|b|a' AS notes, COUNT(*) AS n FROM i GROUP BY ALL""")  # fmt: skip
def q_catalog_items(read, spark):
    """Items of the latest snapshots in a folder of files, by the adapter of each registered provider."""
    root = landed_catalogs(read, spark)
    files = documents.listing(spark, root, r".*\.txt").withColumn("provider_id", F.regexp_extract("path", "provider=([^/]+)", 1)).withColumn("snapshot", F.regexp_extract("path", "date=([^/]+)", 1))
    schema = T._parse_datatype_string(catalogs.SNAPSHOT)
    latest = snapshots.latest(files)
    docs = documents.json_documents(spark, root, schema).where("_corrupt IS NULL")
    kept = docs.join(latest.select("path", "provider_id"), "path")
    notes = catalogs.item_notes(F.lit(" x "), F.lit(""), F.col("doc.notes"))
    s = kept.select("provider_id", F.upper("provider_id").alias("provider_name"), notes.alias("notes"), "doc")
    got = catalogs.items(s, {f"c{i}": kind for i, kind in enumerate(KINDS)})
    word = F.when(F.col("provider_type") != "category_only", F.concat(F.lit("tok"), F.regexp_extract("title", r"(\d+)$", 1))).when(F.col("title").startswith("Familia"), "familia").when(F.col("title").startswith("Otro"), "otro").when(F.col("reference").isNotNull(), "linea").otherwise(F.element_at(F.split("title", " "), 1))
    row = ["provider_id", "provider_name", "provider_type", "title", "category_name", "brand", "reference", "sku", "code", "detail_url"]
    return got.select(*row, F.array_contains("tokens", word).alias("has_word"), "manual", F.array_join("notes", "|").alias("notes")).groupBy(*row, "has_word", "manual", "notes").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT s_suppkey AS k, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'u' || k AS url, CASE WHEN k % 3 = 0 THEN 'detail ' || k ELSE 'listing ' || k END AS title, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'brand ' || n WHEN k % 5 = 0 THEN 'listed' END AS brand, CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'about ' || k END AS description,
concat_ws(',', CASE WHEN NOT (k % 3 = 0 AND k % 2 = 0) AND k % 5 <> 0 THEN 'missing_brand' END, CASE WHEN NOT (k % 3 = 0 AND k % 4 <> 0) THEN 'missing_description' END) AS warnings FROM x""")  # fmt: skip
def q_enriched(read, spark):
    """Records of listings with what their own pages say, where they have one; what neither says is named."""
    k = F.col("s_suppkey")
    listed = read("supplier").select(F.concat(F.lit("u"), k.cast("string")).alias("url"), F.concat(F.lit("listing "), k.cast("string")).alias("title"), F.when(k % 5 == 0, "listed").alias("brand"), F.lit(None).cast("string").alias("description"))
    html = F.concat(
        F.lit("<h1>detail "), k.cast("string"), F.lit("</h1><table><tr><th>Marca</th><td>"), F.when(k % 2 == 0, F.concat(F.lit("brand "), _s("s_nationkey"))).otherwise(" "), F.lit("</td></tr></table>"),
        F.when(k % 4 != 0, F.concat(F.lit('<meta name="description" content="about '), k.cast("string"), F.lit('">'))).otherwise(""),
    )
    own = read("supplier").where(k % 3 == 0).select(F.concat(F.lit("u"), k.cast("string")).alias("url"), html.alias("html"))
    detail = own.select("url", pages.title(F.col("html")).alias("title"), t.present(F.try_element_at(pages.labelled_rows(F.col("html")), F.lit("Marca")), False).alias("brand"), pages.meta(F.col("html"), "description").alias("description"))
    return pages.enriched(listed, detail, ["title", "brand", "description"]).withColumn("warnings", F.array_join("warnings", ","))


@query("""WITH x AS (SELECT n_nationkey AS k, lower(n_name) AS n FROM nation)
SELECT k AS page_id, 'https://d.example.com/servicios/' || n || '|https://d.example.com/servicios/frenos' AS services, 'Kia ' || k AS brand_pages, CASE WHEN k % 2 = 0 THEN 'https://d.example.com/categorias/a?page=2' ELSE '' END AS categories, 'frenos de disco|' || replace(n, '_', ' ') AS families,
CASE WHEN k % 2 = 0 THEN 'b' || k || '|c' ELSE 'c' END AS entries, CASE k % 3 WHEN 0 THEN 'brakes' WHEN 1 THEN 'filters' ELSE 'manual_review' END AS taxonomy, 'exact_reference|high|false' AS match_type FROM x""")  # fmt: skip
def q_link_families(read, spark):
    """Links of pages by what they lead to: services, brands, categories of this host; entry addresses of a snapshot."""
    k, n = F.col("n_nationkey"), F.lower("n_name")
    html = F.concat(
        F.lit('<a href="/servicios/'), n, F.lit('">uno</a><a href="/servicios/frenos#x">dos</a><a href="/servicios/'), n, F.lit('">tres</a><a href="/marcas/kia-'), k.cast("string"), F.lit('">Kia '), k.cast("string"),
        F.lit('</a><a href="/contacto">Otro</a><a href="https://elsewhere.example.com/categorias/z">z</a><a href="/categorias/a?'), F.when(k % 2 == 0, "page=2").otherwise("order=asc"), F.lit('">cat</a>'),
    )
    links = pages.links(html, F.lit("https://d.example.com/"))
    mine = lambda u: t.same_host(u, "d.example.com")
    services = F.filter(links, lambda u: mine(u) & t.matches_any(u, ("/servicios/",)))
    cats = F.filter(links, lambda u: mine(u) & u.contains("/categorias/") & (~u.contains("?") | u.contains("page=")))
    brands = F.transform(F.filter(pages.anchors(html), lambda a: pages.first_keyword(F.concat_ws(" ", a["text"], a["href"]), {"kia": "Kia", "mazda": "Mazda"}).isNotNull()), lambda a: a["text"])
    families = F.transform(F.array(F.lit("https://d.example.com/servicios/frenos-de-disco"), F.concat(F.lit("https://d.example.com/servicios/"), n)), lambda u: t.slug_words(F.regexp_replace(u, "^.*/servicios/", "")))
    entries = F.array_distinct(F.filter(F.flatten(F.array(F.array(F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string")))), F.array(F.lit("c"), F.lit(" "), F.lit("c")))), lambda u: F.coalesce(F.trim(u) != "", F.lit(False))))
    kind = pages.catalog_match_type(F.lit("R1"), F.lit("modelo"))
    return read("nation").select(
        k.alias("page_id"), F.array_join(services, "|").alias("services"), F.array_join(brands, "|").alias("brand_pages"), F.array_join(cats, "|").alias("categories"), F.array_join(families, "|").alias("families"), F.array_join(entries, "|").alias("entries"),
        pages.first_keyword(F.element_at(t.words(("Frenos ABS", "Filtro", "x")), (k % 3 + 1).cast("int")), {"freno": "brakes", "filtro": "filters"}, "manual_review").alias("taxonomy"), F.concat_ws("|", kind["match_type"], kind["confidence"], kind["requires_manual_confirmation"].cast("string")).alias("match_type"),
    )
