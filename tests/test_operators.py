"""Rules of matching, review, preferences, retrieval, store, snapshots, sources and text on small fixtures."""

import base64
import json
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparquill.functions import lexicon as lx
from sparquill.functions import text as t
from sparquill.operators import matching, preferences, retention, retrieval, review, snapshots, store
from sparquill.operators.vector_index import VectorIndex
from sparquill.sources import catalogs, pages
from sparquill.streaming import incremental

ITEM = "item_id string, provider_id string, provider_name string, provider_type string, title string, category_name string, subcategory_name string, brand string, reference string, sku string, code string, detail_url string, taxonomies array<string>, tokens array<string>, manual boolean"
ASK = "quote_id string, part_id string, part_name string, reference string, brand string, line string, version string, year string"


def items(spark, *rows):
    d = spark.createDataFrame([(r.get("id", str(i)), r.get("provider", "p1"), r.get("provider", "p1").title(), r.get("kind", "product_catalog"), r["title"], r.get("category"), None, r.get("brand"), r.get("reference"), r.get("sku"), None, None, None, None, False) for i, r in enumerate(rows)], ITEM)
    return d.withColumn("taxonomies", matching.taxonomies(F.col("title"), F.col("category_name"))).withColumn("tokens", t.tokens(F.col("title"), F.col("brand"), F.col("category_name")))


def best(spark, ask, item, prefs=None, policy=lx.DEFAULT_POLICY):
    r = spark.createDataFrame([("q", "x", ask["name"], ask.get("reference"), ask.get("brand", "Mazda"), ask.get("line", "CX5"), ask.get("version"), ask.get("year"))], ASK)
    if prefs:
        b = {"preferred_providers": [], "avoided_providers": [], "preferred_brands": [], "avoided_brands": [], "prefer_exact_reference": False, "year_tolerance": 0, "max_options": None} | prefs
        r = r.crossJoin(spark.createDataFrame([(tuple(b.values()),)], f"prefs {matching.PREFS}"))
    got = matching.match(r, items(spark, item), policy=policy).collect()
    return got[0] if got else None


CASES = [
    ("exact reference", {"name": "Farola derecha", "reference": "AB-123"}, {"title": "Farola Mazda CX5 derecha", "reference": "ab123"}, None, 100, 100),
    ("wrong side", {"name": "Farola derecha", "reference": "AB-123"}, {"title": "Farola izquierda Mazda CX5", "reference": "AB123"}, None, 0, 0),
    ("wrong position", {"name": "Amortiguador delantero"}, {"title": "Amortiguador trasero Mazda CX5"}, None, 0, 0),
    ("kit against unit", {"name": "Pastilla unidad"}, {"title": "Juego pastilla Mazda CX5"}, None, 0, 0),
    ("other year", {"name": "Farola", "year": "2019"}, {"title": "Farola Mazda CX5 2012-2014"}, None, 20, 45),
    ("year within tolerance", {"name": "Farola", "year": "2015"}, {"title": "Farola Mazda CX5 2012-2014"}, {"year_tolerance": 1}, 60, 100),
    ("other color", {"name": "Bomper negro"}, {"title": "Bomper blanco Mazda CX5"}, None, 20, 60),
    ("other finish", {"name": "Bomper cromado"}, {"title": "Bomper mate Mazda CX5"}, None, 20, 58),
    ("preferred provider", {"name": "Farola"}, {"title": "Farola Mazda CX5"}, {"preferred_providers": ["p1"]}, 70, 100),
    ("avoided provider", {"name": "Farola completa cromo"}, {"title": "Farola Mazda CX5"}, {"avoided_providers": ["p1"]}, 20, 80),
    ("exact wanted", {"name": "Farola", "reference": "ZZ-9"}, {"title": "Farola Mazda CX5", "reference": "AB1"}, {"prefer_exact_reference": True}, 20, 72),
    ("foreign brand", {"name": "Farola"}, {"title": "Farola Renault CX5"}, None, 0, 0),
    ("line missing", {"name": "Farola"}, {"title": "Farola Mazda BT50"}, None, 0, 18),
    ("version missing", {"name": "Farola", "version": "Touring"}, {"title": "Farola Mazda CX5"}, None, 20, 68),
    ("no reference asked", {"name": "Farola Mazda CX5"}, {"title": "Farola Mazda CX5"}, None, 88, 88),
]


def test_scores(spark):
    """All cases as pairs of one table; a case whose pair is rejected has score 0."""
    empty = {"preferred_providers": [], "avoided_providers": [], "preferred_brands": [], "avoided_brands": [], "prefer_exact_reference": False, "year_tolerance": 0, "max_options": None}
    asks = [("q", name, a["name"], a.get("reference"), a.get("brand", "Mazda"), a.get("line", "CX5"), a.get("version"), a.get("year"), tuple((empty | (p or {})).values())) for name, a, _, p, _, _ in CASES]
    asked = matching.prepare_requests(spark.createDataFrame(asks, f"{ASK}, prefs {matching.PREFS}"))
    held = matching.prepare_items(items(spark, *(i | {"id": name} for name, _, i, _, _, _ in CASES)))
    asked = asked.withColumnsRenamed({c: f"asked_{c}" for c in held.columns if c in asked.columns})
    pairs = asked.join(held, F.col("part_id") == F.col("item_id"))
    got = {r.part_id: r.score for r in matching.score(pairs).select("part_id", "score").collect()}
    wrong = [(name, got.get(name, 0)) for name, _, _, _, low, high in CASES if not low <= got.get(name, 0) <= high]
    assert not wrong


def test_policy_of_providers(spark):
    policy = lx.ProviderPolicy(category_only=("fam",), partial=("half",))
    got = best(spark, {"name": "Farola"}, {"title": "Farola", "provider": "fam", "kind": "category_only"}, policy=policy)
    assert got.score <= 55 and got.match_type == matching.MANUAL and got.compatibility_state == "insufficient_information"
    assert best(spark, {"name": "Farola"}, {"title": "Farola Mazda CX5", "provider": "half"}, policy=policy).score <= 78


def test_equal_entries_count_once_and_ranks_are_in_order(spark):
    r = spark.createDataFrame([("q", "x", "Farola", None, "Mazda", "CX5", None, None)], ASK)
    rows = [{"title": "Farola Mazda CX5", "provider": "a"}, {"title": "FAROLA mazda cx5", "provider": "a"}, {"title": "Farola Mazda CX5", "provider": "b"}, {"title": "Exploradora Mazda CX5", "provider": "c"}]
    m = matching.match(r, items(spark, *rows)).cache()
    got = m.orderBy("rank").collect()
    assert [x["provider_id"] for x in got][:2] == ["b", "a"] and [x["rank"] for x in got] == list(range(1, len(got) + 1)) and len(got) <= 3
    rep = matching.report(r, m).first()
    assert (rep.parts_total, rep.parts_with_matches, rep.provider_hits) == (1, 1, {"b": 1})
    options = review.review(m).collect()
    assert len({o.provider_id for o in options}) == len(options) <= 3 and options[0].comment


def test_reviewer_by_indexes(spark):
    r = spark.createDataFrame([("q", "x", "Farola", None, "Mazda", "CX5", None, None)], ASK)
    c = matching.match(r, items(spark, {"title": "Farola Mazda CX5", "provider": "a"}, {"title": "Farola Mazda CX5", "provider": "b"}), title_similarity=False).cache()
    answers = spark.createDataFrame([("x", [1, 7, 0])], "part_id string, indexes array<int>")
    got = review.review(c, lambda d: review.chosen_indexes(d, answers)).orderBy("option").collect()
    assert [o.provider_id for o in got] == ["a", "b"]


def test_signals(spark):
    d = spark.createDataFrame([("filtro de combustible",), ("bomba combustible",), ("kit plumillas",), ("plumilla",), ("bujías",), ("filtro aire",), ("puerta",)], "x string")
    assert [r[0] for r in d.select(matching.part_signal(F.col("x"))).collect()] == ["fuel_filter", "fuel_pump", "wiper_kit", "wiper", "spark_plug", "filter", None]


def test_fold_equals_unicode(spark):
    chars = [chr(c) for c in (*range(0xC0, 0x250), *range(0x300, 0x340)) if unicodedata.category(chr(c))[0] in "LM"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in chars], "c string").select(t.fold(F.col("c"))).collect()]
    want = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in chars]
    assert [(c, g, w) for c, g, w in zip(chars, got, want, strict=True) if g != w and len(w) == 1] == []
    exact = [r[0] for r in spark.createDataFrame([("ﬁÅé",), (None,)], "c string").select(t.exact_fold()("c")).collect()]
    assert exact == ["fiAe", None]


def test_values(spark):
    d = spark.createDataFrame([("$ 110.392", "  12 ", "1,234.50", "Sí", "a_b_Insurer", "2014-2012 y 2019")], "p string, i string, d string, b string, s string, y string")
    r = d.select(t.price_int(F.col("p")), t.as_int(F.col("i")), t.as_decimal(F.col("d")).cast("double"), t.as_bool(F.col("b")), t.insurer(F.col("s")), t.years(F.col("y")), t.years(F.col("y"), False, None), t.vector_literal(F.array(F.lit(0.5), F.lit(-1.0))), t.first_text(F.lit(" none "), F.lit(""), F.lit(" x "))).first()
    assert tuple(r) == (110392, 12, 1234.5, True, "Insurer", [2012, 2013, 2014, 2019], [2012, 2014, 2019], "[0.50000000,-1.00000000]", "x")


def test_preferences_of_scopes(spark):
    rec = [("global", None, "preferred_provider", '{"providers": ["B", "a"]}', "note"), ("insurer", "acme", "year_tolerance", "-3", None), ("workshop", "taller uno", "max_options_per_part", '{"count": 9}', None), ("global", None, "prefer_exact_reference", '"si"', "note"), ("global", None, "year_tolerance", '"x"', None), ("other", "z", "avoided_brand", '"q"', None)]
    p = spark.createDataFrame([(i, *r, True, i) for i, r in enumerate(rec)], "pref_id int, scope string, scope_key string, preference_type string, value string, notes string, active boolean, created_at int")
    q = spark.createDataFrame([("q1", "x_ACME", "Taller  Uno", "taller uno", "Mazda")], "quote_id string, s string, c string, w string, b string")
    q = q.withColumn("scopes", preferences.scopes(F.col("s"), F.col("c"), F.col("w"), F.col("b")))
    assert [tuple(s) for s in q.first().scopes] == [("global", None), ("insurer", "acme"), ("workshop", "taller uno"), ("vehicle_brand", "mazda")]
    b = preferences.fold(preferences.records_of(q, p)).first()
    assert (b.preferred_providers, b.avoided_brands, b.prefer_exact_reference, b.year_tolerance, b.max_options, b.notes) == (["b", "a"], [], True, 0, 5, ["note"])


def test_chunks_and_searches(spark):
    d = spark.createDataFrame([("a", 1, "one two three " * 20), ("a", 2, "   "), ("b", 1, "x" * 50)], "document_id string, page int, text string")
    c = retrieval.chunk(d, 60, 10).orderBy("document_id", "chunk_index").collect()
    assert all(len(r.content) <= 60 for r in c) and [r.chunk_index for r in c if r.document_id == "a"] == list(range(sum(r.document_id == "a" for r in c)))
    with pytest.raises(ValueError):
        retrieval.chunk(d, 100, 70)
    chunks = spark.createDataFrame([("d1", 0, 1, "filtro de aire mazda"), ("d2", 0, 1, "filtro uno dos tres aire"), ("d3", 0, 1, "filtro")], "document_id string, chunk_index int, page int, content string")
    q = spark.createDataFrame([(1, "aire filtro"), (2, "nada")], "query_id int, query string")
    hits = retrieval.text_search(chunks, q, 5).collect()
    assert [(r.document_id, r.place, round(r.score, 4)) for r in sorted(hits, key=lambda r: r.place)] == [("d1", 1, 0.05), ("d2", 2, 0.025)]
    v = spark.createDataFrame([(1, "d1", 0, 0.9, 1), (1, "d3", 0, 0.8, 2)], "query_id int, document_id string, chunk_index int, score double, place int")
    both = retrieval.search(chunks, q, 5, "hybrid", v).orderBy("place").collect()
    assert [(r.document_id, r.retrieval_mode) for r in both] == [("d1", "hybrid"), ("d3", "vector"), ("d2", "text")] and both[0].score == 1.05
    assert {r.query_id for r in retrieval.search(chunks, q, 5).collect()} == {1}


def test_vectors_and_cells(spark, tmp_path):
    import random

    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(999, None), (998, [0.0] * 8)], "vec_id int, embedding array<double>")
    q = v.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = retrieval.vector_search(v, q, 5)
    assert all(r.vec_id == r.query_id and abs(r.score - 1) < 1e-9 for r in exact.where("place = 1").collect())
    near = VectorIndex.create(spark, f"{tmp_path}/i", v, cells=8).search(q, 5, probes=6)
    a, b = ({(r.query_id, r[1]) for r in d.collect()} for d in (exact, near))
    assert len(a & b) / len(a) >= 0.9


def test_evidence_in_order(spark):
    asked = spark.createDataFrame([(1, "ref9", None, None, "filtro aire", "mazda", "cx5", "2015"), (2, None, None, None, "x", "y", "z", None)], "query_id int, asked_reference string, candidate_reference string, candidate_brand string, part_name string, vehicle_brand string, vehicle_line string, year string")
    hits = spark.createDataFrame([(1, 1, "filtro aire generico"), (1, 2, "ref9 mazda"), (1, 3, "filtro de aire")], "query_id int, place int, content string").withColumns({"title": F.lit("t"), "page": F.lit(3), "score": F.lit(0.5), "retrieval_mode": F.lit("text")})
    got = {r.query_id: r for r in retrieval.evidence(asked, hits).collect()}
    assert got[1].verdict == "reference_supported" and len(got[1].citations) == 3 and got[1].citations[0].page_span == "3"
    assert got[2].verdict == "no_evidence" and got[2].summary is None


def test_snapshots(spark):
    a = spark.createDataFrame([("k1", "x", 1), ("k2", None, 2), ("k3", "z", 3)], "key string, name string, price int")
    b = spark.createDataFrame([("k1", "x", 5), ("k2", "y", 2), ("k4", "w", 4)], "key string, name string, price int")
    got = {r.key: (r.change, r.fields) for r in snapshots.diff(a, b, "key", ["name", "price"]).collect()}
    assert got == {"k1": ("changed", ["price"]), "k2": ("changed", ["name"]), "k3": ("added", []), "k4": ("removed", [])}
    s = spark.createDataFrame([("p", "2026-06-09", "a"), ("p", "2026-06-09-full", "b"), ("p", "2026-05-01", "c")], "provider_id string, snapshot string, path string")
    assert snapshots.latest(s).first().path == "b" and snapshots.previous(s, F.lit("2026-06-09")).first().path == "c"
    pages_ = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u2"), (3, "u3")], "page int, url string")
    assert sorted(r.url for r in snapshots.first_new_pages(pages_, "page", "url").collect()) == ["u1", "u2"]


def test_store(spark):
    d = spark.createDataFrame([(("a ", None, [" ", "x"], [], 0, False),)], "doc struct<s:string,n:string,l:array<string>,e:array<string>,z:int,f:boolean>")
    assert d.select(store.compact_json(d, "doc")).first()[0] == '{"s":"a","l":["x"],"z":0,"f":false}'
    old = spark.createDataFrame([(1, "old", 5), (2, "keep", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "new", 1), (1, "newer", 2), (3, "add", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"], ["t"]).collect()) == [(1, "newer", 2), (2, "keep", 1), (3, "add", 1)]
    with pytest.raises(KeyError):
        store.require_keys(old, spark.createDataFrame([(1,), (9,)], "k int"), "k")
    parts = spark.createDataFrame([("p", [{"rank": "0", "score_percent": "140", "product_name": " "}, {"rank": "7", "score_percent": "x", "product_name": "n"}])], "part_key string, matches array<map<string,string>>")
    parts = parts.select("part_key", F.transform("matches", lambda m: F.struct(m["rank"].alias("rank"), m["score_percent"].alias("score_percent"), m["product_name"].alias("product_name"))).alias("matches"))
    assert [(r["rank"], r.score_percent, r.product_name, r.provider_id) for r in store.match_rows(parts).collect()] == [(1, 100, "Unknown product", "unknown"), (7, 0, "n", "unknown")]


def test_retention_keeps_active_rows(spark):
    now = F.lit("2026-06-01").cast("timestamp")
    q = spark.createDataFrame([(1, "completed", "2026-01-01", 1), (2, "open", "2026-01-01", 2), (3, "failed", "2026-05-30", 3)], "quote_id int, status string, created_at string, email_id int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    e = spark.createDataFrame([(1, None, "2026-05-31"), (2, None, "2026-05-31"), (2, 9, "2026-05-31"), (None, None, "2026-04-01")], "quote_id int, task_id int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    tasks = spark.createDataFrame([(9, "completed", "2026-04-01")], "task_id int, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    s = retention.Store(q, tasks, e, spark.createDataFrame([(1,), (2,), (4,)], "email_id int"), {"parts": spark.createDataFrame([(1,), (3,)], "quote_id int")})
    k = retention.delete_expired(s, now)
    assert sorted(r.quote_id for r in k.quotes.collect()) == [2, 3] and k.tasks.count() == 0 and [r.quote_id for r in k.events.collect()] == [2]
    assert [r.email_id for r in k.emails.collect()] == [2] and [r.quote_id for r in k.children["parts"].collect()] == [3]
    c = retention.counts(s, now).first()
    assert (c.expired_quotes, c.protected_quotes, c.expired_tasks, c.old_events, c.orphan_emails) == (1, 1, 1, 1, 1)


def test_cursor_and_changes(spark):
    s = spark.createDataFrame([("a", "completed", "5"), ("b", "failed", "9"), ("c", "completed", "5")], "message_id string, status string, internal_date_ms string")
    assert tuple(incremental.cursor(s).first()) == (5, "c")
    found = spark.createDataFrame([("d", "1"), ("a", "5"), ("e", None)], "message_id string, internal_date_ms string")
    assert [r.message_id for r in incremental.to_process(found, s).collect()] == ["e", "d", "b"]
    f = spark.createDataFrame([("x", 1), ("y", 2)], "path string, modified int")
    g = spark.createDataFrame([("y", 1), ("z", 1)], "path string, modified int")
    assert sorted((r.path, r.change) for r in incremental.changed(f, g).collect()) == [("x", "new"), ("y", "changed"), ("z", "gone")]


HTML = """<html><head><title>Shop - Part</title><meta property="og:image" content="http://h/i.png"><meta content="About it" name="description">
<script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"Farola","brand":{"name":"Acme"},"mpn":"M1","sku":"S1","offers":[{"price":"$ 35.000"}]},{"@type":"BreadcrumbList","itemListElement":[{"name":"Inicio"},{"name":"Luces"},{"item":{"name":"Farolas"}}]}]}</script>
<script type="application/ld+json">not json</script></head><body><h1>Farola &amp; <b>base</b></h1>
<a href="/p/1?page=3#x">a</a><a href="doc.pdf">b</a><a href="//o.com/c">c</a><a href="mailto:x@y">d</a><a href="/feed/">e</a>
<div class="card"><span class="n">Uno</span><i>123</i></div><div class="card"><span class="n">Dos</span><i>9x</i></div><div class="card"><i>1</i></div></body></html>"""


def test_pages(spark):
    d = spark.createDataFrame([(1, "https://h.com/a/b.html", HTML), (2, "https://h.com/categoria/x", "<title>Frenos | Shop</title>"), (3, "https://h.com/product/y", "<h1>Solo</h1> SKU: Z-9"), (4, "u", None)], "page_id long, url string, html string")
    r = d.where("page_id = 1").select(pages.title(F.col("html")), pages.meta(F.col("html"), "description"), pages.links(F.col("html"), F.col("url")), pages.pdf_links(F.col("html"), F.col("url"))).first()
    assert r[0] == "Farola & base" and r[1] == "About it" and r[2] == ["https://h.com/p/1?page=3", "https://h.com/a/doc.pdf", "https://o.com/c"] and r[3] == ["https://h.com/a/doc.pdf"]
    p = {r.page_id: r for r in pages.product_records(d).collect()}
    assert (p[1].product_name, p[1].brand, p[1].reference, p[1].category_name, p[1].subcategory_name, p[1].price, p[1].image_url) == ("Farola", "Acme", "M1", "Luces", "Farolas", 35000, "http://h/i.png")
    assert (p[3].product_name, p[3].sku, p[3].found_by) == ("Solo", "Z-9", "page") and set(p) == {1, 3}
    assert [r.category_name for r in pages.category_records(d).collect()] == ["Frenos"]
    c = pages.cards(d, '<div class="card">', {"name": r'(?is)class="n">(.*?)<', "code": r"(?is)<i>(.*?)</i>"}, "name").withColumn("code", pages.numeric_code(F.col("code"))).orderBy("pos").collect()
    assert [(r.name, r.code) for r in c] == [("Uno", "123"), ("Dos", None)]
    q = pages.quote_parts(d.where("page_id = 1"), '<div class="card">', {"name": r'(?is)class="n">(.*?)<', "code": r"(?is)<i>(.*?)</i>"}, ("name", "code")).orderBy("pos")
    assert [r.raw_status for r in q.collect()] == ["loaded", "loaded", "partial_missing_name"]
    h = pages.quotes(d.where("page_id = 1"), q, {"owner": "(?is)<em>(.*?)</em>"}).first()
    assert h.load_status == "partial" and h.warnings == ["missing_owner"] and len(h.parts) == 3


def test_mails(spark):
    body = '<a href="https://q.com/ver?id=1">Ver cotizacion</a><a href="https://q.com/ver">Ver cotizacion</a><a href="https://x.com/ver?id=2">Ver cotizacion</a>'
    part = {"mimeType": "text/html", "body": {"data": base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")}}
    payload = {"headers": [{"name": "From", "value": "A <Me@Q.com>"}, {"name": "SUBJECT", "value": "s_Ins"}, {"name": "Date", "value": "Mon, 1 Jun 2026 10:00:00 -0500"}], "mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/alternative", "parts": [part]}]}
    m = spark.createDataFrame([("m1", "5", json.dumps(payload)), ("m2", "1000", "{}")], "id string, internalDate string, payload string")
    got = {r.id: r for r in pages.messages(m, "me@q.com", "ver cotizacion", "q.com", "/ver").collect()}
    assert (got["m1"].status, got["m1"].quote_urls, got["m1"].received_at) == ("extracted", ["https://q.com/ver?id=1"], "2026-06-01T15:00:00+00:00")
    assert got["m2"].status == "sender_mismatch" and got["m2"].received_at.startswith("1970-01-01T00:00:01")


def test_catalogs(spark):
    docs = [
        ("p1", '{"products":[{"product_name":"Farola","brand":"Acme","sku":"S","detail_url":"u","searchable_tokens":["LED"]},{"product_name":" "}],"categories":[{"category_name":"Frenos"}]}'),
        ("p2", '{"products":[{"category_name":"Luces","product_names":["Faro","Stop"],"brands_by_product":{"Faro":[{"name":"A"},{"name":"B"}]}}]}'),
        ("p3", '{"service_families":[{"name":"Amortiguadores"}],"service_series":[{"brand":"X","line":"Y","series_label":"Z1"}]}'),
        ("p9", '{"products":[{"product_name":"skipped"}]}'),
    ]
    s = spark.createDataFrame(docs, "provider_id string, raw string").select("provider_id", F.upper("provider_id").alias("provider_name"), F.array(F.lit("n")).alias("notes"), F.from_json("raw", catalogs.SNAPSHOT).alias("doc"))
    got = catalogs.items(s, {"p1": "seeded", "p2": "groups", "p3": "services"}).collect()
    assert sorted((r.provider_id, r.title, r.provider_type) for r in got) == [("p1", "Farola", "product_catalog"), ("p1", "Frenos", "category_only"), ("p2", "Faro", "category_only"), ("p2", "Stop", "category_only"), ("p3", "Amortiguadores", "category_only"), ("p3", "X Y Z1", "category_only")]
    by = {r.title: r for r in got}
    assert by["Faro"].brand == "A, B" and by["X Y Z1"].reference == "Z1" and "led" in by["Farola"].tokens and by["Frenos"].taxonomies == ["brake_system"]
    assert len({r.item_id for r in got}) == len(got)


def test_sink_keeps_all_rows_whatever_is_replayed(spark, tmp_path):
    target = f"{tmp_path}/out"
    sink = incremental.idempotent_append(spark, target, ["a", "b"], buckets=4)
    table = lambda rows: spark.createDataFrame(rows, "a int, b string, v int")
    first = table([(1, "x", 0), (2, "x", 0), (2, "x", 0), (None, "x", 0), (None, None, 0)])
    second = table([(2, "x", 1), (3, "x", 1), (None, None, 1), (4, None, 1)])
    stored = lambda: sorted(map(repr, incremental.appended(spark, target).collect()))
    sink(first, 0)
    assert len(stored()) == 4
    sink(second, 1)
    want = stored()
    assert len(want) == 6
    # the last batch again, then an earlier one, then nothing new
    for batch, number in ((second, 1), (first, 0), (table([]), 2), (first.unionByName(second), 3)):
        sink(batch, number)
        assert stored() == want
    # the checkpoint of another stream counts its batches from 0, too
    incremental.idempotent_append(spark, target, ["a", "b"], stream="other", buckets=4)(table([(1, "x", 2), (9, "y", 2)]), 0)
    assert stored() == sorted([*want, repr(table([(9, "y", 2)]).first())])


def test_vector_search_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 if i % 5 else 4).tolist()) for i in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, 2.0, 3.0]), (64, [2.0, 4.0, 6.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = {}
    for i, x in rows:
        if i % 3 == 0 and x and any(x):
            cos = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 12), j) for j, y in rows if y and any(y) and len(y) == len(x)]
            want[i] = [j for _, j in sorted(cos)[:4]]
    for block in (4096, 3):
        got = {}
        for r in retrieval.vector_search(v, q, 4, block=block).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want
    assert retrieval.vector_search(v, q.limit(0), 4).collect() == [] and retrieval.vector_search(v.limit(0), q, 4).collect() == []


def test_cover_density_counts_shortest_spans(spark):
    d = spark.createDataFrame([(["a", "x", "b", "a", "y", "z", "b"], ["a", "b"]), (["a"], ["a"]), (["a", "a"], ["a", "b"]), ([], ["a"])], "w array<string>, q array<string>")
    got = [r[0] for r in d.select(retrieval.cover_density()("w", "q")).collect()]
    # covers a x b, b a and a y z b
    assert got == pytest.approx([0.1 / 2 + 0.1 + 0.1 / 3, 0.1, 0, 0])


def test_embeddings_are_all_or_nothing_for_a_document(spark):
    from sparquill.operators import embedding

    chunks = spark.createDataFrame([("d1", 0, "one two"), ("d1", 1, None), ("d2", 0, "fine"), ("d2", 1, "bad"), (None, 0, "x")], "document_id string, chunk_index int, content string").coalesce(1)

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return embedding.hashed_words(4)(texts)

    got = {(r.document_id, r.chunk_index): r for r in embedding.embed_chunks(chunks, model, "m", 4, batch=1).collect()}
    assert sum(x * x for x in got["d1", 0].embedding) == pytest.approx(1) and got["d1", 1].embedding == [0.0] * 4 and got[None, 0].embedding_model == "m"
    assert got["d2", 0].embedding is None and got["d2", 0].warning == got["d2", 1].warning == "no embeddings: no"
    wrong = embedding.embed_chunks(chunks, embedding.hashed_words(3), "m", 4).collect()
    assert all(r.embedding is None and "not 4" in r.warning for r in wrong)
    assert embedding.embed(["x"], lambda t: [[3.0, 4.0]] if t == ["query: x"] else [], 2, "query", True).tolist() == [[0.6, 0.8]]


def test_state_survives_and_passes_are_repeatable(spark, tmp_path):
    from sparquill.streaming import state

    store_ = state.StateStore(spark, f"{tmp_path}/state")
    assert store_.load().version == 0 and store_.claim("a") and not store_.claim("a")
    store_.release("a")
    assert store_.claim("a")
    found = spark.createDataFrame([("m1", "5", "extracted", ["https://q/1", "https://q/1", "x"]), ("m2", None, "link_not_found", [])], "message_id string, internal_date_ms string, extraction_status string, quote_urls array<string>")
    valid = lambda u: F.col("url").startswith("https://q/")
    done = lambda q: q.select("quote_key", F.lit("processed").alias("status"), F.lit(None).cast("string").alias("error"))

    def broken(q):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        state.process_once(found, store_, broken, valid)
    half = store_.load()
    assert half.stage == "processing" and half.messages.where("status = 'in_progress'").count() == 2
    assert state.process_once(found, store_, done, valid) == {"messages_seen": 2, "messages_with_quotes": 1, "quotes_processed": 1, "quotes_failed": 0, "quotes_skipped": 1}
    now = store_.load()
    assert now.stage == state.IDLE and {r.status for r in now.quotes.collect()} == {"processed", "invalid_quote_url"} and state.cursor(now).first().message_id == "m1"
    assert state.process_once(found, store_, done, valid)["messages_seen"] == 0
    assert state.process_once(found.limit(0), store_, done, valid, reprocess=True)["quotes_processed"] == 0


def test_cards_without_content_are_none(spark):
    from sparquill.sources import cards

    rows = [(1, "Agotado\n$1.000"), (2, None), (3, "Solo una linea bastante larga para ser titulo"), (4, "Marca: ACME\nACME\nACME"), (5, "BOSCH\nKIT\nFreno de disco delantero con todo")]
    d = spark.createDataFrame([(i, "https://h.com/l", x, None, None) for i, x in rows], "card_id int, seed_url string, text string, links array<string>, images array<string>")
    got = {r.card_id: r for r in cards.card_records(d, "h.com").collect()}
    assert set(got) == {3, 4, 5}
    assert (got[3].title, got[3].brand) == ("Solo una linea bastante larga para ser titulo", None)
    assert (got[4].title, got[4].brand) == ("ACME", "ACME")
    # the second line looks like a brand, too, so the title is the third
    assert (got[5].title, got[5].brand) == ("Freno de disco delantero con todo", "BOSCH")


def test_settings_and_outputs():
    from sparquill.operators import embedding, jobs

    assert embedding.config({}) == embedding.Config("local", embedding.MODEL, 384, 24)
    assert embedding.config({"provider": " Local ", "model": "m", "dimensions": "8", "batch": "0"}) == embedding.Config("local", "m", 8, 1)
    assert embedding.config({"provider": "remote"}) is None and embedding.config({"provider": "remote", "api_key": "k"}).provider == "remote"
    assert embedding.config({"provider": "odd"}) is None and embedding.config({"vector_search_enabled": "no"}) is None
    assert jobs.outputs("minimal", "q", "r") == {"quotes": "q", "reports": "r", "traces": None, "snapshots": None}
    assert jobs.outputs("standard", "q", "r", root="o")["traces"] == "o/traces" and jobs.outputs("debug", "q", "r", "t")["snapshots"] == "output/snapshots"
    with pytest.raises(ValueError):
        jobs.outputs("odd", "q", "r")


def test_hits_are_shown(spark):
    from sparquill.operators import jobs

    d = spark.createDataFrame([("t", 3, 0.123456, None, "1.5", "x" * 400, "vector"), ("u", None, None, 0.0, None, None, None)], "title string, page int, score double, text_score double, vector_score string, content string, retrieval_mode string")
    got = [json.loads(r[0]) for r in d.select(jobs.shown_hits(d)).collect()]
    assert got[0] == {"title": "t", "page_span": "3", "score": 0.1235, "text_score": 0.0, "vector_score": 1.5, "retrieval_mode": "vector", "excerpt": "x" * 320}
    assert got[1]["page_span"] == "n/a" and got[1]["retrieval_mode"] == "text" and got[1]["excerpt"] == ""


def test_entry_takes_what_is_there(monkeypatch):
    import __spark_entry__

    there = __spark_entry__._there
    assert there("sparquill.plans.catalogue") and not there("sparquill.nothing") and not there("nothing.at.all")
    monkeypatch.setattr(__spark_entry__, "_there", lambda module: module != "corpus_pipeline" and there(module))
    assert "pipeline" not in __spark_entry__.queries()
    monkeypatch.setattr(__spark_entry__, "_there", lambda module: False)
    assert not [q for q in __spark_entry__.queries() if q.startswith("op")]


def test_sink_after_empty_batches(spark, tmp_path):
    target = f"{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame(r, "a long, b string")
    sink = incremental.idempotent_append(spark, target, ["a"], buckets=4)
    sink(rows(), 0)
    assert incremental.appended(spark, target).collect() == [] and incremental.appended(spark, target).columns == ["a", "b"]
    sink(rows((1, "x"), (None, "n")), 1)
    sink(rows(), 2)
    sink(rows((1, "y"), (2, "z"), (None, "m")), 3)
    assert sorted(map(repr, incremental.appended(spark, target).collect())) == ["Row(a=1, b='x')", "Row(a=2, b='z')", "Row(a=None, b='n')"]


def test_second_writer_of_a_state_is_told(spark, tmp_path):
    from sparquill.streaming import state

    store_ = state.StateStore(spark, f"{tmp_path}/state")
    message = lambda i: spark.createDataFrame([(i, "completed", "1", None)], state.MESSAGES)
    first, second = store_.load(), store_.load()
    saved = store_.save(state.State(first.messages.unionByName(message("a")), first.quotes))
    with pytest.raises(state.Conflict):
        store_.save(state.State(second.messages.unionByName(message("b")), second.quotes, version=second.version))
    assert [r.message_id for r in store_.load().messages.collect()] == ["a"] and saved.version == 1
    again = store_.save(state.State(saved.messages.unionByName(message("b")), saved.quotes, version=saved.version))
    assert sorted(r.message_id for r in again.messages.collect()) == ["a", "b"]
    # a writer that claimed a number and died blocks it for a while only
    assert store_.claim("v000000000003")
    with pytest.raises(state.Conflict):
        store_.save(again)
    store_._fs.setTimes(store_._path(f"{store_.root}/_lock-v000000000003"), 1000, 1000)
    assert store_.save(again).version == 3
    assert store_.claim("pass")
    with pytest.raises(state.Conflict):
        state.process_once(spark.createDataFrame([], "message_id string, internal_date_ms string, extraction_status string, quote_urls array<string>"), store_, lambda d: d, lambda u: u.isNotNull())


def test_passes_write_only_tables_that_change(spark, tmp_path):
    from sparquill.streaming import state

    root = f"{tmp_path}/state"
    store_ = state.StateStore(spark, root)
    schema = "message_id string, internal_date_ms string, extraction_status string, quote_urls array<string>"
    # m1 comes twice; m2 has an address that fails at first, m3 one that is refused; a message without an id is none
    found = spark.createDataFrame([("m1", "1", "extracted", ["https://q/1?t=s", None]), ("m1", "2", "extracted", ["https://q/1?t=s"]), ("m2", "3", "extracted", ["https://q/2", "https://q/3"]), ("m3", "4", "extracted", ["ftp://x"]), (None, "5", "extracted", ["https://q/5"])], schema)
    valid = lambda u: F.col("url").startswith("https://q/")
    asked = []

    def process(fails):
        def run(q):
            asked.append(sorted(r.url for r in q.collect()))
            bad = F.col("url") == fails
            return q.select("quote_key", F.when(bad, "failed").otherwise("processed").alias("status"), F.when(bad, "no").alias("error"))

        return run

    counters = state.process_once(found, store_, process("https://q/3"), valid)
    assert counters == {"messages_seen": 4, "messages_with_quotes": 4, "quotes_processed": 2, "quotes_failed": 1, "quotes_skipped": 2}
    now = store_.load()
    assert now.messages.columns == ["message_id", "status", "internal_date_ms", "extraction_status"] and now.quotes.columns == ["quote_key", "message_id", "url", "status", "error"]
    assert sorted(tuple(r) for r in now.messages.collect()) == [("m1", "completed", "2", "extracted"), ("m2", "in_progress", "3", "extracted"), ("m3", "completed", "4", "extracted")]
    want = [("m1", "https://q/1?[redacted]", "processed", None), ("m2", "https://q/2", "processed", None), ("m2", "https://q/3", "failed", "no"), ("m3", "ftp://x", "invalid_quote_url", "no address of a quote")]
    assert sorted(tuple(r)[1:] for r in now.quotes.collect()) == want
    counters = state.process_once(found, store_, process(None), valid)
    assert counters == {"messages_seen": 1, "messages_with_quotes": 1, "quotes_processed": 1, "quotes_failed": 0, "quotes_skipped": 1}
    assert asked == [["https://q/1?t=s", "https://q/1?t=s", "https://q/2", "https://q/3"], ["https://q/3"]]
    before = store_.load()
    files = lambda s: sorted(s.messages.inputFiles() + s.quotes.inputFiles())
    assert state.process_once(found, store_, process(None), valid)["messages_seen"] == 0
    after = store_.load()
    # nothing came: new versions, no new tables; old tables went, nothing of a pass stays
    assert after.version == before.version + 4 and files(after) == files(before) and len(asked) == 2
    assert sorted(x.split("-")[0] for x in os.listdir(root) if not x.startswith((".", "_", "v"))) == ["messages", "quotes"] and not [x for x in os.listdir(root) if x.startswith("_pass")]
    assert {r.status for r in after.messages.collect()} == {"completed"}
    # tables are dealt by their keys before they are grouped, or each task would sort all that it reads
    plan = state._newest(after.quotes, after.quotes, "quote_key", "message_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [quote_key" in plan


def test_state_of_versions_with_their_own_tables_is_read(spark, tmp_path):
    from sparquill.streaming import state

    root = f"{tmp_path}/state"
    spark.createDataFrame([("a", "completed", "1", None)], state.MESSAGES).write.parquet(f"{root}/v000000000001/messages")
    spark.createDataFrame([], state.QUOTES).write.parquet(f"{root}/v000000000001/quotes")
    spark.createDataFrame([(json.dumps({"stage": "idle", "last_run": {}}),)], "value string").write.text(f"{root}/v000000000001/about")
    store_ = state.StateStore(spark, root)
    now = store_.load()
    for _ in range(4):
        now = store_.save(now, ())
    assert now.version == 5 and [r.message_id for r in now.messages.collect()] == ["a"]
    for _ in range(3):
        now = store_.save(state.State(now.messages, now.quotes, version=now.version))
    assert [r.message_id for r in now.messages.collect()] == ["a"] and not os.path.exists(f"{root}/v000000000001")


def test_places_over_ranges(spark):
    from sparquill.operators import ranks

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("w"))
    got = ranks.placed(rows, [F.desc("v")]).collect()
    assert len(got) == 5000 and all(r.place == 5000 - r.v for r in got)
    assert ranks.placed(rows.limit(0), [F.desc("v")]).collect() == []


def test_title_similarity_of_best_pairs(spark):
    asked = matching.staged(matching.prepare_requests(spark.createDataFrame([("q", str(i), n, r, None, "CX5", None, None) for i, (n, r) in enumerate([("Farola derecha led", None), ("Farola derecha led", "AB 1"), ("Espejo retrovisor", None), ("Farola dere led", "77")])], ASK)), "a")
    held = matching.staged(matching.prepare_items(items(spark, *({"title": f"{n} CX5 {i % 3}", "reference": f"R{i}" if i % 2 else None} for i, n in enumerate(["Farola derecha led", "Farola led", "Farolas", "Retrovisor", "Espejo"] * 3)))), "h")
    clash = [c for c in held.columns if c in asked.columns]
    pairs = matching.candidates(asked, held).join(asked.withColumnsRenamed({c: f"asked_{c}" for c in clash}), "part_id").join(held, "item_id")
    key = lambda d: sorted(tuple(r) for r in d.select("part_id", "rank", "item_id", "score").collect())
    want = key(matching.rank(matching.score(pairs, texts=False)))
    assert key(matching.best_pairs(asked, held, 5)) == want and want != key(matching.rank(matching.score(pairs, title_similarity=False, texts=False)))


@pytest.mark.parametrize("wide", [0, 2, 16])
def test_best_pairs_are_those_of_all_pairs(spark, monkeypatch, wide):
    """Profiles and kinds change no rank: own references, equal entries of several kinds, ties, preferences."""
    import random

    monkeypatch.setattr(matching, "WIDE", wide)
    pick = random.Random(8)
    words, sides, brands = ["farola", "bomper", "filtro aceite", "bujia", "pastilla freno", "espejo"], ["", "izquierda", "derecha", "negro", "kit"], ["Mazda", "Renault", "", None]
    ref = lambda: pick.choice([None, None, f"R-{pick.randrange(12)}", str(pick.randrange(100, 106)), f"{pick.choice(words)} {pick.randrange(9)}"])
    rows = [{"id": f"i{i:03d}", "title": f"{pick.choice(words)} {pick.choice(['Mazda CX5', 'Renault Logan', '100', '2012-2014'])} {pick.choice(sides)}", "provider": pick.choice(["p1", "p2"]), "brand": pick.choice(brands), "reference": ref(), "sku": ref(), "category": pick.choice(["Frenos", "Filtros", None])} for i in range(120)]
    rows += [r | {"id": f"j{i}", "category": "Otra 101"} for i, r in enumerate(rows[:30])]
    liked = {"preferred_providers": ["p2"], "avoided_providers": [], "preferred_brands": ["mazda"], "avoided_brands": [], "prefer_exact_reference": True, "year_tolerance": 0, "max_options": 2}
    asks = [("q", f"a{i}", f"{pick.choice(words)} {pick.choice(sides)}", ref(), pick.choice(["Mazda", "Renault", None]), pick.choice(["CX5", "Logan"]), None, pick.choice([None, "2013"]), tuple(liked.values()) if i % 4 == 0 else None) for i in range(70)]
    asked = matching.staged(matching.prepare_requests(spark.createDataFrame(asks, f"{ASK}, prefs {matching.PREFS}")), "a")
    held = matching.staged(matching.prepare_items(items(spark, *rows)), "h")
    clash = [c for c in held.columns if c in asked.columns]
    pairs = matching.candidates(asked, held).join(asked.withColumnsRenamed({c: f"asked_{c}" for c in clash}), "part_id").join(held, "item_id")
    key = lambda d: sorted(tuple(r) for r in d.select("part_id", "rank", "item_id", "score", "match_type").collect())
    want = key(matching.rank(matching.score(pairs, title_similarity=False, texts=False), 3))
    assert len(want) > 100 and {r[4] for r in want} >= {"exact_reference", matching.MANUAL}
    assert key(matching.best_pairs(asked, held, 3, title_similarity=False)) == want


def test_candidates_of_hot_keys_are_the_same(spark, monkeypatch):
    asks = [("q", str(i), f"Farola {'negra' if i % 2 else 'kit'} {i}", None, "Mazda", "CX5", None, "2015" if i % 3 else None) for i in range(12)]
    asked = matching.prepare_requests(spark.createDataFrame(asks, ASK))
    held = matching.prepare_items(items(spark, *({"title": f"Farola {'negra' if i % 4 else 'base'} {i}", "brand": "Mazda"} for i in range(30)), {"title": "Otra cosa"}))
    pairs = lambda: sorted(tuple(r) for r in matching.candidates(asked, held).collect())
    want = pairs()
    assert len(want) == 12 * 30
    for least in (1, 40, 250):
        monkeypatch.setattr(matching, "HOT_PAIRS", least)
        assert pairs() == want
