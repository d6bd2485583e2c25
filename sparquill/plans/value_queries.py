"""Values, slugs, addresses and markup: texts that are made from the tables' columns and read back by the library's functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import store
from ..shared import dealt
from ..sources import documents, pages, search
from .registry import query

_YES = ["Sí", "no", "ON", "0", "quizas", None]


def _pick(values, at):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (at + 1).cast("int"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderdate AS d, o_orderpriority AS pr FROM orders)
SELECT k, CASE WHEN k % 3 <> 0 THEN CAST(c AS BIGINT) END AS as_int, CASE WHEN k % 4 <> 0 THEN CAST(c AS BIGINT) END AS strict_int, CAST(round(p, 2) AS DOUBLE) AS as_decimal, CAST(floor(p) AS BIGINT) AS price,
CASE k % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END AS flag, CASE WHEN k % 7 <> 0 THEN strftime(d, '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN k % 5 = 0 THEN CAST(k AS VARCHAR) ELSE 'Seguros ' || c END AS insurer,
CASE WHEN k % 4 = 0 THEN 'n/a' WHEN k % 3 = 0 OR k % 2 = 0 THEN CAST(k % 50 AS VARCHAR) ELSE (k % 50) || '-' || (k % 50 + 1) END AS span, '[' || printf('%.8f', c / 4.0) || ',-1.50000000]' AS vector, pr AS first_text,
rtrim(rtrim(CAST(CAST(p AS DECIMAL(18,4)) AS VARCHAR), '0'), '.') AS numbered, 'from:q@example.com' || CASE WHEN k % 2 = 0 THEN strftime(d, ' after:%Y/%m/%d') || strftime(d + INTERVAL 1 DAY, ' before:%Y/%m/%d') ELSE '' END AS sender_query FROM o""")  # fmt: skip
def q_values(read, spark):
    """Numbers, prices, flags, times, page spans and vectors from their texts."""
    k, c, p, d = (F.col(x) for x in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    money = F.concat(F.lit("$"), F.format_number(p, 2))
    return read("orders").select(
        k.alias("k"), t.as_int(F.concat(F.lit(" "), c.cast("string"), F.when(k % 3 == 0, "x").otherwise(" "))).cast("long").alias("as_int"), t.strict_int(F.concat(F.when(k % 4 == 0, "-").otherwise(""), c.cast("string"))).alias("strict_int"),
        t.as_decimal(money).cast("double").alias("as_decimal"), t.price_int(F.concat(F.lit("Desde $ "), F.replace(F.format_number(F.floor(p), 0), F.lit(","), F.lit(".")), F.lit(" COP"))).alias("price"), t.as_bool(_pick(_YES, k % 6)).alias("flag"),
        F.date_format(t.as_timestamp(F.when(k % 7 == 0, "no date").otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))), "yyyy-MM-dd HH:mm:ss").alias("at"), t.insurer(F.concat(F.lit("Cotizacion_"), k.cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_Seguros "), c.cast("string"))))).alias("insurer"),
        t.page_span(F.when(k % 4 != 0, k % 50), F.when(k % 3 != 0, k % 50 + k % 2)).alias("span"), t.vector_literal(F.array(c / 4.0, F.lit(-1.5))).alias("vector"), t.first_text(F.lit("  "), F.lit("No disponible"), F.when(k % 2 == 0, " None "), F.col("o_orderpriority")).alias("first_text"),
        store.numbered(p.cast("decimal(18,4)")).alias("numbered"), t.sender_query("q@example.com", F.when(k % 2 == 0, d.cast("date"))).alias("sender_query"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS ty, p_size AS s FROM part)
SELECT k, n || ' ' || lower(ty) || ' ' || s AS slug_words, array_to_string(list_transform(string_split(n || ' ' || lower(ty), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS slug_name,
array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(n || ' ' || ty || ' ' || b), '[^a-z0-9]+'), lambda w: length(w) >= 2))), ' ') AS search_tokens, CASE WHEN k % 3 <> 0 THEN 'RX-' || k END AS code, b || '|Linea ' || s || '|Serie ' || k AS heading,
'X' || k || '|' || ty AS attributes, b || '|' || s AS labelled, 'Frenos|' || array_to_string(list_transform(string_split(lower(ty), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS categories, CASE WHEN k >= 100 THEN CAST(k AS VARCHAR) END AS numeric_code,
CASE WHEN k % 2 = 0 THEN 'exact_reference|high|false' WHEN k % 3 = 0 THEN 'vehicle_compatible|medium|true' ELSE 'category_only|low|true' END AS match_type,
CASE WHEN contains(n, 'cold') THEN 'cooling' WHEN contains(n, 'widget') THEN 'widgets' ELSE 'manual_review' END AS keyword, 'servicio de ' || lower(ty) AS service FROM p""")  # fmt: skip
def q_slugs(read, spark):
    """Slugs, codes, headings, attributes and categories of parts, written as pages write them."""
    k, n, b, ty, s = (F.col(f"p_{x}") for x in ("partkey", "name", "brand", "type", "size"))
    slug = F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit("_"), F.lower(ty))
    heading = pages.heading_parts(F.concat(F.lit("<b>"), b, F.lit("</b> Linea "), s.cast("string"), F.lit(" – Serie "), k.cast("string")))
    attributes = pages.attributes(F.concat(F.lit("MARCA: "), b, F.lit(" TIPO REPUESTO: "), ty, F.lit(" MARCA: X"), k.cast("string")))
    rows = pages.labelled_rows(F.concat(F.lit("<table><tr><th>Marca</th><td>otra</td></tr><tr class='x'><th> Marca </th> <td><b>"), b, F.lit("</b></td></tr><tr><th>Talla</th><td>"), s.cast("string"), F.lit("</td></tr></table>")))
    slugs = pages.category_slugs(F.concat(F.lit("product product_cat-"), F.replace(F.lower(ty), F.lit(" "), F.lit("-")), F.lit(" product_cat-frenos x product_cat-frenos")))
    main, sub = pages.category_names(slugs, F.array(F.lit("frenos")), F.create_map(F.lit("frenos"), F.lit("Frenos")))
    kind = pages.catalog_match_type(F.when(k % 2 == 0, F.concat(F.lit("R"), k.cast("string"))), F.when(k % 3 == 0, "Compatible con varios").otherwise("otro"))
    return dealt(read("part"), "p_partkey").select(
        k.alias("k"), t.slug_words(F.concat(slug, F.lit("/"), s.cast("string"))).alias("slug_words"), t.slug_name(slug).alias("slug_name"), F.array_join(F.array_sort(t.search_tokens(n, ty, F.lit(" "), b)), " ").alias("search_tokens"),
        pages.code_in_name(F.concat(n, F.when(k % 3 != 0, F.concat(F.lit(" (RX-"), k.cast("string"), F.lit(")"))).otherwise(" (?)"))).alias("code"), F.concat_ws("|", heading["brand"], heading["line"], heading["series"]).alias("heading"),
        F.concat_ws("|", attributes["MARCA"], attributes["TIPO REPUESTO"]).alias("attributes"), F.concat_ws("|", rows["Marca"], rows["Talla"]).alias("labelled"), F.concat_ws("|", main, sub).alias("categories"), pages.numeric_code(F.concat(F.lit(" "), k.cast("string"))).alias("numeric_code"),
        F.concat_ws("|", kind["match_type"], kind["confidence"], kind["requires_manual_confirmation"].cast("string")).alias("match_type"), pages.first_keyword(n, {"cold": "cooling", "widget": "widgets"}, "manual_review").alias("keyword"),
        t.slug_words(F.regexp_replace(F.concat(F.lit("https://d.example.com/servicios/servicio-de-"), F.lower(ty), F.lit("-colombia/")), r"^.*/servicios/|-colombia/?$", "")).alias("service"),
    )


@query("""WITH u AS (SELECT s_suppkey AS k, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT k, CASE k % 4 WHEN 0 THEN 'product' WHEN 1 THEN 'category' WHEN 2 THEN 'ignored' ELSE 'other' END AS kind, 'make ' || lower(n) AS make, CASE WHEN k % 3 = 0 THEN NULL ELSE 'línea ' || k END AS model, CASE WHEN k % 4 = 1 THEN 'categorias/x' || k END AS category_path,
'https://shop.example.com/list?groups=filtros%20y%20m%C3%A1s&page=' || (k % 9 + 1) AS query_url, k % 9 + 1 AS page, 'https://shop.example.com/list?groups=[redacted]&page=[redacted]' AS masked_values,
'<a href="https://q.example.com/ver?[redacted]">A &amp; &lt;b&gt; &#x27;' || k || '&#x27;</a>' AS excerpt, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS quote_links FROM u""")  # fmt: skip
def q_addresses(read, spark):
    """Addresses by kind, their parameters read and written, anchors for logs, links of quotes."""
    k = F.col("s_suppkey")
    said = F.concat(F.lit("https://shop.example.com/list?makes=make+"), F.lower("n_name"), F.when(k % 3 == 0, "&models=%20").otherwise(F.concat(F.lit("&models=l%C3%ADnea%20"), k.cast("string"))))
    path = F.when(k % 4 == 0, "/p/item.php").when(k % 4 == 1, F.concat(F.lit("/categorias/x"), k.cast("string"), F.lit("/"))).when(k % 4 == 2, "/product/feed/").otherwise("/about")
    url = F.concat(F.lit("https://shop.example.com"), path)
    kind = F.when(t.ignored(url), "ignored").when(t.product_like(url), "product").when(t.category_like(url), "category").otherwise("other")
    made = t.query_url(F.lit("https://shop.example.com/list#top"), {"groups": F.lit("filtros y más"), "makes": F.lit(" "), "page": (k % 9 + 1).cast("string")})
    anchor = F.struct(F.lit("https://q.example.com/ver?id=secret&t=1").alias("href"), F.concat(F.lit("A & <b> '"), k.cast("string"), F.lit("'")).alias("text"))
    is_quote = lambda x: pages.is_quote_url(x, "q.example.com", "/ver").cast("int")
    links = is_quote(F.when(k % 4 == 0, "HTTPS://Q.example.com/ver?id=1").otherwise("https://q.example.com/ver")) + is_quote(F.when(k % 5 == 0, "http://q.example.com/ver?x=2").otherwise("ftp://q.example.com/ver?x=2")) * 2
    return read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("k"), kind.alias("kind"), t.query_parameter(said, "makes").alias("make"), t.query_parameter(said, "models").alias("model"), search.category_path(url).alias("category_path"), made.alias("query_url"), t.page_number(made).cast("long").alias("page"), t.mask_values(made).alias("masked_values"),
        pages.anchor_excerpt(anchor).alias("excerpt"), links.cast("long").alias("quote_links"),
    )


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer)
SELECT k, 'Año ' || k || ' ' || m AS decoded, n || ' & "' || m || '" <' || k || '>' AS collapsed, 'Niño ' || n || ' fin' AS stripped, 'About ' || n AS description, 'img ' || k AS image, CASE WHEN k % 3 = 1 THEN FALSE ELSE TRUE END AS visible, n || '|' || m || '|' || k AS attribute, 'mid ' || k AS section, 'V' || k AS label FROM c""")  # fmt: skip
def q_markup(read, spark):
    """Bytes by their charset, entities, tags, meta elements, attributes, visibility and sections."""
    k, n, m = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    s = k.cast("string")
    latin = k % 2 == 0
    said = F.concat(F.lit("Año "), s, F.lit(" "), m)
    content = F.when(latin, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8"))
    # every sixth page says Latin-1 and is UTF-8, which shows
    content = F.when(k % 6 == 0, F.encode(said, "UTF-8")).otherwise(content)
    html = F.concat(F.lit("<meta content='About "), n, F.lit("' property=\"og:description\"><META name=\"og:image\" content=\"img "), s, F.lit("\"><body>Ni&ntilde;o&nbsp;<b>"), n, F.lit("</b>\n fin</body>"))
    tag = F.concat(F.lit('<div data-a="'), n, F.lit("\" data-b = '"), m, F.lit("' data-c="), s, F.when(k % 3 == 1, ' style="display: none">').otherwise(">"))
    whole = F.concat(F.lit("<h2>Uno</h2>a<h2>Dos</h2> mid "), s, F.lit("<h2>Tres</h2>b <p>Clave:</p><p><i>V"), s, F.lit("</i></p>"))
    return read("customer").select(
        k.alias("k"), documents.decoded(content, F.when(latin, 'text/html; charset="ISO-8859-1"').otherwise("text/html")).alias("decoded"), t.collapse(F.concat(n, F.lit(" &amp;\n&quot;"), m, F.lit("&quot; &lt;"), s, F.lit("&gt; "))).alias("collapsed"),
        t.strip_html(F.regexp_extract(html, "(?s)<body>(.*)</body>", 1)).alias("stripped"), pages.meta(html, "og:description").alias("description"), pages.meta(html, "og:image").alias("image"), pages.visible(tag).alias("visible"),
        F.concat_ws("|", pages.attribute(tag, "data-a"), pages.attribute(tag, "data-b"), pages.attribute(tag, "data-c")).alias("attribute"), t.strip_html(pages.section(whole, "<h2>Dos</h2>", ["<h2>Tres</h2>", "<h2>Dos</h2>"])).alias("section"), t.strip_html(pages.label_value(whole, "Clave")).alias("label"),
    )
