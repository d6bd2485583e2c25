"""Stored documents and rows, files, embeddings and incremental passes, over the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import embedding, preferences, retention, review, snapshots, store, views
from ..operators.vector_index import VectorIndex
from ..shared import passing_folder, shared_folder
from ..sources import documents
from ..streaming import incremental, state
from . import vehicle_queries
from .registry import query

_s = lambda c: F.col(c).cast("string")


@query("""SELECT c_custkey AS k, '{"generated_at":"g","quote_key":"q' || c_custkey || '","source":{"gmail_id":"m' || c_custkey || '"},"quote_url_masked":"u","orbika":{"load_status":"loaded","marca":"' || c_mktsegment || '","parts":[{"name":"p","reference":"r' || c_custkey || '"}]},'
|| '"supplier_matching":{"generated_at":"g","summary":{"parts_total":1,"provider_hits":{"a":' || c_custkey % 3 || '}},"provider_specs":[{"provider_id":"a","display_name":"A"}],"parts":[{"part_name":"p","best_score_percent":' || c_custkey % 100 || ',"matches":[' || array_to_string(list_transform([1, 2, 3], lambda i: '{"provider_id":"a' || i || '","score_percent":' || (i * 7) || ',"detail_url":"d' || i || '"}'), ',') || ']}]}'
|| CASE WHEN c_custkey % 2 = 0 THEN ',"agentic_supplier_matching":{"review_mode":"rules","summary":{"parts_reviewed":1},"parts":[{"part_name":"p","selected_matches":[{"rank":1,"provider_id":"a1","agentic_comment":"c' || c_custkey || '"}]}]}' ELSE '' END || '}' AS stored FROM customer""")  # fmt: skip
def q_stored_projection(read, spark):
    """Whole quote documents cut to the fields that are stored, at every depth, then compacted."""
    k, s = F.col("c_custkey"), _s("c_custkey")
    text = lambda v, name: F.lit(v).alias(name)
    entry = lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("provider_id"), text(" ", "provider_name"), (i * 7).alias("score_percent"), F.concat(F.lit("d"), i.cast("string")).alias("detail_url"), text("not stored", "reasons"), F.array(F.lit("")).alias("risk_flags"))
    part = F.struct(text("p", "part_name"), (k % 100).alias("best_score_percent"), text("x", "trace"), F.transform(F.sequence(F.lit(1), F.lit(5)), entry).alias("matches"))
    option = F.struct(F.lit(1).alias("rank"), text("a1", "provider_id"), text("not stored", "rag_summary"), F.concat(F.lit("c"), s).alias("agentic_comment"))
    doc = F.struct(
        text("g", "generated_at"), F.concat(F.lit("q"), s).alias("quote_key"), F.struct(F.concat(F.lit("m"), s).alias("gmail_id"), text("  ", "subject"), text("x", "headers")).alias("source"), text("u", "quote_url_masked"), text("secret", "quote_url"),
        F.struct(text("loaded", "load_status"), F.col("c_mktsegment").alias("marca"), text("", "vin"), text("x", "html"), F.array(F.struct(text("p", "name"), F.concat(F.lit("r"), s).alias("reference"), text("x", "markup"), text(None, "raw_status"))).alias("parts"), F.array().cast("array<string>").alias("warnings")).alias("orbika"),
        F.struct(text("g", "generated_at"), F.struct(F.lit(1).alias("parts_total"), F.lit(9).alias("other"), F.create_map(F.lit("a"), (k % 3)).alias("provider_hits")).alias("summary"), F.array(F.struct(text("a", "provider_id"), text("A", "display_name"), text("n", "note"))).alias("provider_specs"), F.array(part).alias("parts")).alias("supplier_matching"),
        F.when(k % 2 == 0, F.struct(text("rules", "review_mode"), F.struct(F.lit(1).alias("parts_reviewed"), F.lit(2).alias("other")).alias("summary"), F.array(F.struct(text("p", "part_name"), F.array(option).alias("selected_matches"))).alias("parts"))).alias("agentic_supplier_matching"),
    )
    d = read("customer").select(k.alias("k"), doc.alias("doc"))
    return d.select("k", store.stored(d, "doc").alias("stored"))


@query(f"""{vehicle_queries._reviewed_sql()} SELECT CAST(part_id AS BIGINT) AS part_id, CAST(option AS BIGINT) AS rank, provider_id || '|' || provider_name || '|' || adjusted || '|' || match_type || '|' || title || '|' || COALESCE(reference, '') || '|' || COALESCE(brand, '') || '|' || category_name || '|' || (match_type <> 'exact_reference') || '|' || array_to_string(risk, ',') AS fields, 'agentic' AS source FROM r""")
def q_option_fields(read, spark):
    """Reviewed options as they are put out."""
    got = review.option_fields(review.review(vehicle_queries.matched(read), policy=vehicle_queries.POLICY))
    m = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    fields = F.concat_ws("|", *(m(f) for f in ("provider_id", "provider_name", "score_percent", "match_type", "product_name", "reference", "brand", "category_name", "requires_manual_confirmation")), F.array_join("risk_flags", ","))
    return got.select("part_id", F.col("rank").cast("long").alias("rank"), fields.alias("fields"), F.col("explanation_source").alias("source"))


def _matches(read):
    """A part for each order; its lines are matches whose fields are partly missing."""
    n = F.col("l_linenumber")
    m = F.struct(
        n.alias("_n"), F.when(n % 3 != 0, n).otherwise(0).cast("string").alias("rank"), F.when(F.col("l_suppkey") % 4 == 0, " none ").otherwise(F.concat(F.lit("prov"), _s("l_suppkey"))).alias("provider_id"), F.when(n % 2 == 0, F.concat(F.lit("Part "), _s("l_partkey"))).alias("product_name"),
        (F.col("l_quantity") * 3).cast("int").cast("string").alias("score_percent"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"), F.when(n % 5 == 0, "USD").alias("currency"), F.col("l_returnflag").alias("match_type"), F.lit("x").alias("other"),
    )
    return read("lineitem").groupBy(_s("l_orderkey").alias("part_key")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"), m.alias("m")))).alias("ms")).select("part_key", F.transform("ms", lambda x: x["m"]).alias("matches"))


_MATCHES_SQL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
m AS (SELECT CAST(l_orderkey AS VARCHAR) AS part_key, CAST(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber ELSE pos END AS BIGINT) AS rank, CASE WHEN l_suppkey % 4 = 0 THEN 'unknown' ELSE 'prov' || l_suppkey END AS provider_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Part ' || l_partkey ELSE 'Unknown product' END AS product_name,
  CAST(LEAST(100, CAST(l_quantity AS INT) * 3) AS BIGINT) AS score_percent, CAST(round(l_extendedprice, 2) AS DOUBLE) AS price, CASE WHEN l_linenumber % 5 = 0 THEN 'USD' ELSE 'COP' END AS currency, l_returnflag AS match_type, pos FROM l)"""


@query(f"{_MATCHES_SQL} SELECT * EXCLUDE (pos) FROM m")
def q_match_rows(read, spark):
    """Stored match rows with ranks, defaults and bounds."""
    m = store.match_rows(_matches(read))
    return m.select("part_key", F.col("rank").cast("long").alias("rank"), "provider_id", "product_name", F.col("score_percent").cast("long").alias("score_percent"), F.col("price").cast("double").alias("price"), "currency", "match_type")


@query(f"""{_MATCHES_SQL}, k AS (SELECT part_key, provider_id, product_name, arg_min(part_key || ':' || rank || ':' || pos, (rank, part_key || ':' || rank || ':' || pos)) AS first_key FROM m GROUP BY ALL)
SELECT m.part_key, 'r' || m.pos AS review, CASE WHEN m.pos % 2 = 0 THEN m.part_key || ':' || m.rank || ':' || m.pos WHEN m.pos % 5 = 0 THEN NULL ELSE k.first_key END AS match_key FROM m JOIN k USING (part_key, provider_id, product_name)
WHERE (SELECT COUNT(*) FROM m x WHERE x.part_key = m.part_key AND x.rank = m.rank AND x.provider_id = m.provider_id AND x.product_name = m.product_name) = 1""")  # fmt: skip
def q_review_matches(read, spark):
    """Reviews find their match by all keys (every second), else by provider and product; every fifth names another product."""
    from pyspark.sql import Window

    li = read("lineitem").select(_s("l_orderkey").alias("part_key"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"), "l_linenumber", "l_suppkey", "l_partkey")
    rows = li.select(
        "part_key", "pos", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).otherwise(F.col("pos")).cast("int").alias("rank"), F.when(F.col("l_suppkey") % 4 == 0, "unknown").otherwise(F.concat(F.lit("prov"), _s("l_suppkey"))).alias("provider_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Part "), _s("l_partkey"))).otherwise("Unknown product").alias("product_name"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("detail_url"),
    )
    matches = rows.withColumn("match_key", F.concat_ws(":", "part_key", _s("rank"), _s("pos")))
    once = Window.partitionBy("part_key", "rank", "provider_id", "product_name")
    asked = rows.withColumn("same", F.count("*").over(once)).where("same = 1")
    reviews = asked.select("part_key", F.concat(F.lit("r"), _s("pos")).alias("review"), "provider_id", F.when((F.col("pos") % 2 != 0) & (F.col("pos") % 5 == 0), "another").otherwise(F.col("product_name")).alias("product_name"), F.when(F.col("pos") % 2 == 0, F.col("rank")).otherwise(-1).alias("rank"), "reference", "detail_url")
    return store.review_matches(reviews, matches.drop("pos")).select("part_key", "review", "match_key")


@query("""WITH s AS (SELECT l_orderkey AS q, l_linenumber AS n, l_quantity AS v, 'old' AS src FROM lineitem WHERE l_linenumber <= 4), x AS (SELECT DISTINCT l_orderkey AS q FROM lineitem WHERE l_orderkey % 3 = 0),
r AS (SELECT * FROM s WHERE q NOT IN (SELECT q FROM x) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, 'new' FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber > 2)
SELECT q AS quote_id, COUNT(*) AS parts, CAST(SUM(v + CASE WHEN q % 9 = 1 THEN 100 ELSE 0 END) AS DOUBLE) AS quantity, MIN(src) AS source, MIN(CASE WHEN n % 2 = 0 THEN 'name ' || n ELSE 'Repuesto ' || (n + 1) END) AS first_name FROM r GROUP BY q""")  # fmt: skip
def q_replace_children(read, spark):
    """Parts of every third quote replaced, then those of every ninth processed again; parts without a name get one."""
    li = read("lineitem").select(F.col("l_orderkey").alias("quote_id"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_quantity").cast("double").alias("v"))
    old, new = li.where("pos <= 4").withColumn("source", F.lit("old")), li.where("quote_id % 3 = 0 AND pos > 2").withColumn("source", F.lit("new"))
    now = store.replace_children(old, new, li.where("quote_id % 3 = 0"), "quote_id")
    keys = now.where("quote_id % 9 = 1").select("quote_id").distinct()
    now = store.rerun(now, keys, "quote_id", lambda d: d.withColumn("v", F.col("v") + 100))
    named = store.generated_names(now.withColumn("name", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("name "), _s("pos"))).otherwise(" ")))
    return named.groupBy("quote_id").agg(F.count("*").alias("parts"), F.sum("v").alias("quantity"), F.min("source").alias("source"), F.min("name").alias("first_name"))


@query("""WITH a AS (SELECT * FROM part WHERE p_size <= 40), b AS (SELECT p_partkey, p_name, CASE WHEN p_size % 7 = 0 THEN 'OTHER' ELSE p_brand END AS p_brand FROM part WHERE p_size >= 10),
d AS (SELECT COUNT(*) FILTER (WHERE b.p_partkey IS NULL) AS added, COUNT(*) FILTER (WHERE a.p_partkey IS NULL) AS removed, COUNT(*) FILTER (WHERE a.p_brand <> b.p_brand) AS changed FROM a FULL JOIN b ON a.p_partkey = b.p_partkey), n AS (SELECT COUNT(*) AS n FROM a)
SELECT 'products' AS file, n FROM n UNION ALL SELECT 'csv', n FROM n UNION ALL SELECT 'diff', added + removed + changed FROM d UNION ALL SELECT 'summary added', added FROM d UNION ALL SELECT 'summary removed', removed FROM d UNION ALL SELECT 'summary changed', changed FROM d
UNION ALL SELECT 'summary products', n FROM n UNION ALL SELECT 'envelope products', n FROM n UNION ALL SELECT 'notes', 2 UNION ALL SELECT 'brands gone', COUNT(*) FROM (SELECT p_brand FROM b EXCEPT SELECT p_brand FROM a) UNION ALL SELECT 'brands come', COUNT(*) FROM (SELECT p_brand FROM a EXCEPT SELECT p_brand FROM b)
UNION ALL SELECT 'csv tags', COUNT(*) FILTER (WHERE p_size % 2 = 0) FROM a""")  # fmt: skip
def q_snapshot_bundle(read, spark):
    """A snapshot's folder written and read back: products as lines and CSV, differences, envelope, summary."""
    p = read("part")
    tags = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    a = p.where("p_size <= 40").select("p_partkey", "p_name", "p_brand", tags.alias("tags"), F.create_map(F.lit("size"), "p_size").alias("extra"))
    b = p.where("p_size >= 10").select("p_partkey", "p_name", F.when(F.col("p_size") % 7 == 0, "OTHER").otherwise(F.col("p_brand")).alias("p_brand"))
    keyed = lambda d: d.withColumn("record_key", snapshots.record_key(F.lit("prov"), _s("p_partkey"), F.lit(None), F.lit(None), F.lit(None), F.col("p_name")))
    diff = snapshots.diff(keyed(a), keyed(b), "record_key", ["p_name", "p_brand"])
    about = documents.envelope("prov", "Provider", "2026-06-09", a, F.array(F.lit(" one"), F.lit("two"), F.lit("one"), F.lit("")))
    at = documents.write_bundle(a, diff, about, f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}", "Provider")
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n")
    csv = spark.read.option("header", True).csv(f"{at}/products.csv")
    back = spark.read.json(f"{at}/envelope.json")
    lines = spark.read.text(f"{at}/summary.md").where("value LIKE '- %'").select(F.concat(F.lit("summary "), F.regexp_extract("value", "^- (.*): ", 1)).alias("file"), F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("n"))
    sets = snapshots.set_differences(a.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("key")), b.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("key")), "kind", "key")
    found = snapshots.summary(sets)
    out = count(spark.read.json(f"{at}/extracted.json"), "products").unionByName(count(csv, "csv")).unionByName(count(spark.read.json(f"{at}/diff.json"), "diff")).unionByName(lines)
    out = out.unionByName(back.select(F.lit("envelope products").alias("file"), F.col("products_count").alias("n"))).unionByName(back.select(F.lit("notes").alias("file"), F.size("notes").cast("long").alias("n")))
    out = out.unionByName(found.select(F.lit("brands gone").alias("file"), F.col("removed").alias("n"))).unionByName(found.select(F.lit("brands come").alias("file"), F.col("added").alias("n")))
    return out.unionByName(count(csv.where("tags = 'a | b' AND extra LIKE '{\"size\":%'"), "csv tags"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM e)
SELECT event_type AS channel, COUNT(*) AS kept, COUNT(*) FILTER (WHERE age <= 5) AS replayed, arg_max(event_id, (ts, event_id)) AS newest, string_agg('event: ' || event_type || chr(10) || 'data: ' || event_id || chr(10) || chr(10), '' ORDER BY age) FILTER (WHERE age <= 2) AS wire,
(SELECT COUNT(*) FILTER (WHERE event_type = 'error') || '/' || COUNT(*) FROM e) AS tasks, (SELECT 'u' || arg_min(user_id, (ts, event_id)) || ':s' || arg_min(event_type, (ts, event_id)) || ':' || (SELECT COUNT(*) FROM e WHERE event_type = 'error') || ':true' FROM e WHERE event_type = 'click') AS supervision,
'cursor=' || arg_max(event_id, (ts, event_id)) || ' processed=' || COUNT(*) || ' failed=' || COUNT(*) FILTER (WHERE k % 7 = 0) || ' next=300s' AS line FROM r WHERE age <= 20 GROUP BY event_type""")  # fmt: skip
def q_console(read, spark):
    """What a console shows of events: the newest of each channel, what a new listener gets, tasks, the active runner, a status line."""
    e = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("created_at", F.col("ts").cast("timestamp"))
    kept = views.last_events(e, "event_type", 20, 5)
    wire = views.sse(F.col("event_type"), _s("event_id"))
    lines = F.array_sort(F.collect_list(F.when(F.col("age") <= 2, F.struct("age", wire.alias("w")))))
    g = kept.groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("kept"), F.count(F.when(F.col("replayed"), 1)).alias("replayed"), F.max_by("event_id", F.struct("created_at", "event_id")).alias("newest"), F.array_join(F.transform(lines, lambda x: x["w"]), "").alias("wire"), F.count(F.when(F.col("k") % 7 == 0, 1)).alias("bad"))
    tasks = views.status_counts(e, "event_type", {"failed": ("error",)}).select(F.concat_ws("/", "failed", "total").alias("tasks"))
    status = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "error", "failed").otherwise("idle")
    runners = e.select(F.concat(F.lit("u"), _s("user_id")).alias("runner"), F.struct(F.concat(F.lit("s"), "event_type").alias("stage")).alias("current"), status.alias("status"), F.struct("created_at", "event_id").alias("started_at"), F.col("created_at").alias("updated_at"))
    seen = views.supervision(runners, F.lit("2025-01-01").cast("timestamp")).select(F.concat_ws(":", "active.runner", "active.stage", _s("failed"), _s("stale")).alias("supervision"))
    line = incremental.poll_line(F.col("newest"), F.col("kept"), F.col("bad"), 300)
    one = lambda d: F.broadcast(d)  # one row each
    return g.join(one(tasks)).join(one(seen)).select("channel", "kept", "replayed", "newest", "wire", "tasks", "supervision", line.alias("line"))


@query("""SELECT o_orderkey AS quote_key, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey ELSE '' END AS path, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%dT%H:%M:%S') AS generated_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey ELSE 0 END AS parts_total,
row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END DESC, o_orderkey) AS place, '{"brand":null,"extra":"x","price":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '"}' AS payload FROM orders""")  # fmt: skip
def q_quote_summaries(read, spark):
    """Summaries of quotes with their fallbacks, newest first, and raw documents under the columns of their rows."""
    from ..operators import ranks

    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    none = F.lit(None)
    rows = read("orders").select(
        k.alias("quote_key"), k.alias("quote_id"), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("path"), F.when(k % 3 == 0, d + F.expr("INTERVAL 1 DAY")).alias("processed_at"), d.alias("updated_at"), none.cast("timestamp").alias("received_at"), none.cast("string").alias("subject"),
        none.cast("string").alias("load_status"), F.when(k % 4 != 0, F.col("o_custkey")).alias("parts_total"), none.alias("parts_with_matches"), none.alias("exact_reference_matches"), none.alias("parts_with_options"),
        none.cast("string").alias("brand"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.lit('{"brand":"raw","extra":"x","price":"0"}').alias("raw"),
    )
    ordered = ranks.placed(rows.select("quote_key", F.coalesce("processed_at", "updated_at").alias("at")), [F.desc("at"), F.col("quote_key")])
    payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(store.match_payload(rows, ["brand", "price"])))), {"ignoreNullFields": "false"})
    one = rows.select(F.col("quote_key").alias("_k"), payload.alias("payload"))
    s = store.summaries(rows).select("quote_key", "path", "generated_at", F.col("parts_total").cast("long").alias("parts_total"))
    return s.join(ordered.select(F.col("quote_key").alias("_q"), F.col("place").cast("long").alias("place")), F.col("quote_key") == F.col("_q")).join(one, F.col("quote_key") == F.col("_k")).drop("_q", "_k")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM part), u AS (SELECT s AS page, b || '/' || (k % 40) AS url, k FROM p), f AS (SELECT url, MIN(page) AS first_page FROM u GROUP BY url),
e AS (SELECT MIN(page) AS stop FROM (SELECT DISTINCT page FROM u) x WHERE page NOT IN (SELECT first_page FROM f))
SELECT 'walked' AS what, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT DISTINCT f.url FROM f, e WHERE e.stop IS NULL OR f.first_page < e.stop) UNION ALL SELECT 'first of url', CAST(SUM(k) AS BIGINT) FROM (SELECT MIN(k) AS k FROM u GROUP BY url)
UNION ALL SELECT 'unique urls', COUNT(DISTINCT b) FROM p UNION ALL SELECT 'hits', CAST(SUM(s % 3 + 1) AS BIGINT) FROM p UNION ALL SELECT 'top', MAX(n) FROM (SELECT COUNT(*) AS n FROM p GROUP BY b) UNION ALL SELECT 'clash', COUNT(*) FROM p WHERE s % 2 = 0""")  # fmt: skip
def q_first_of(read, spark):
    """Walks of crawled pages, first records, unique addresses, summed hits, merged lookups."""
    p = read("part")
    u = p.select(F.col("p_size").alias("page"), F.concat_ws("/", "p_brand", (F.col("p_partkey") % 40).cast("string")).alias("url"), F.col("p_partkey").alias("k"))
    out = snapshots.first_new_pages(u, "page", "url").select("url").distinct().agg(F.count("*").alias("n")).select(F.lit("walked").alias("what"), "n")
    first = snapshots.first_of(u, ["url"], "k").agg(F.sum("k").alias("n")).select(F.lit("first of url").alias("what"), "n")
    unique = p.agg(F.countDistinct("p_brand").alias("n")).select(F.lit("unique urls").alias("what"), "n")
    maps = p.select(F.create_map("p_brand", (F.col("p_size") % 3 + 1).cast("long")).alias("provider_hits"))
    hits = views.summed_hits(maps).agg(F.sum("hits").alias("n")).select(F.lit("hits").alias("what"), "n")
    top = views.provider_hits(p.withColumnRenamed("p_brand", "provider_id"), 1).select(F.lit("top").alias("what"), F.col("hits").alias("n"))
    merged = snapshots.merged_lookup(F.create_map(F.lit("a"), F.col("p_size") % 2), F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(6)))
    clash = p.where((merged["a"] == 0) & (merged["b"] == 6)).agg(F.count("*").alias("n")).select(F.lit("clash").alias("what"), "n")
    for d in (first, unique, hits, top, clash):
        out = out.unionByName(d)
    return out


@query("""SELECT 'json' AS what, CAST(COUNT(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'bad', 1 UNION ALL SELECT 'regions', COUNT(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'digests', COUNT(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'listed', 2 UNION ALL SELECT 'old', 0 UNION ALL SELECT 'all old', COUNT(DISTINCT n_regionkey) + 1 FROM nation
UNION ALL SELECT 'reasons', COUNT(DISTINCT n_regionkey) + 1 FROM nation UNION ALL SELECT 'new', COUNT(DISTINCT n_regionkey) + 1 FROM nation UNION ALL SELECT 'gone', 1""")  # fmt: skip
def q_files(read, spark):
    """Documents written in folders and read back; broken files, listings, digests, old files, changes of a folder."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    d = read("nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_nationkey"))).alias("keys"))
    one = d.select(F.format_string('{"region":%d,"keys":%s,"note":null}', "n_regionkey", "keys").alias("value"), F.concat(F.lit("r"), _s("n_regionkey")).alias("name"))
    one.unionByName(spark.createDataFrame([('{"region":', "broken")], "value string, name string")).repartition("name").write.partitionBy("name").text(f"{root}/docs")
    from pyspark.sql import types as T

    docs = documents.json_documents(spark, f"{root}/docs", T._parse_datatype_string("region int, keys array<int>"))
    files = documents.listing(spark, f"{root}/docs", r".*\.txt")
    count = lambda x, name: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = docs.select(F.explode("doc.keys").alias("k")).agg(F.count("*").alias("n")).select(F.lit("json").alias("what"), "n")
    digests = documents.file_digest(spark, f"{root}/docs/name=r*/*.txt").agg(F.countDistinct("sha256").alias("n")).select(F.lit("digests").alias("what"), "n")
    future = F.lit("2100-01-01").cast("timestamp")
    old, every = retention.old_files(spark, f"{root}/docs", F.current_timestamp(), 7, r".*\.txt"), retention.old_files(spark, f"{root}/docs", future, 7, r".*\.txt")
    reasons = retention.candidates(every.withColumn("reason", F.lit("debug")), every.withColumn("reason", F.lit("experiment"))).where("reason = 'debug'")
    before = spark.createDataFrame([("gone.txt", None)], "path string, modified timestamp")
    moved = incremental.changed(files, before)
    more = [
        count(docs.where("_corrupt IS NOT NULL"), "bad"), count(docs.where("doc.region IS NOT NULL"), "regions"), digests, count(documents.listing(spark, f"{root}/docs", r".*\.txt", limit=2, newest_first=True), "listed"), count(old, "old"), count(every, "all old"), count(reasons, "reasons"),
        count(moved.where("change = 'new'"), "new"), count(moved.where("change = 'gone'"), "gone"),
    ]
    for x in more:
        out = out.unionByName(x)
    return out


_SLOTS = 8


@query(f"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark), c AS (SELECT item_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {_SLOTS} AS slot, COUNT(*) AS n FROM w GROUP BY 1, 2),
v AS (SELECT item_id, slot, n / sqrt(SUM(n * n) OVER (PARTITION BY item_id)) AS x FROM c)
SELECT b.item_id, CASE WHEN b.item_id % 7 = 0 THEN NULL ELSE 'hashed' END AS model, CASE WHEN b.item_id % 7 = 0 THEN '' ELSE (SELECT string_agg(slot || '=' || printf('%.5f', x), ' ' ORDER BY slot) FROM v WHERE v.item_id = b.item_id) END AS vector, CASE WHEN b.item_id % 7 = 0 THEN 'no embeddings: refused' END AS warning FROM benchmark b""")  # fmt: skip
def q_embed_chunks(read, spark):
    """Chunks embedded in batches by a model that refuses some texts: documents with a refused chunk have no vectors."""
    words = embedding.hashed_words(_SLOTS)

    def model(texts):
        if any(x.startswith("refuse") for x in texts):
            raise ValueError("refused")
        return words(texts)

    b = read("benchmark")
    # two chunks a document: its text, and a second one that some models refuse
    chunks = b.select(F.col("item_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content")).unionByName(b.select(F.col("item_id").alias("document_id"), F.lit(1).alias("chunk_index"), F.when(F.col("item_id") % 7 == 0, "refuse").otherwise("more").alias("content")))
    got = embedding.embed_chunks(chunks, model, "hashed", _SLOTS, batch=1).where("chunk_index = 0")
    pairs = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, F.concat(i.cast("string"), F.lit("="), F.format_string("%.5f", x)))), lambda x: x.isNotNull())
    return got.select(F.col("document_id").alias("item_id"), F.col("embedding_model").alias("model"), F.coalesce(F.array_join(pairs, " "), F.lit("")).alias("vector"), "warning")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id) AS place FROM v, q) SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM r WHERE place <= 3""")  # fmt: skip
def q_ivf_all_cells(read, spark):
    """The stored index of cells, all of them probed: equals the exact search."""
    v = read("embeddings")
    asked = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = VectorIndex.create(spark, passing_folder(spark, "vector-index"), v, cells=4).search(asked, 3, probes=4)
    return got.select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


_PASS_SQL = """WITH e AS (SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS d, event_type AS ty, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), m AS (SELECT *, CASE WHEN ty = 'view' THEN 0 WHEN ty = 'click' THEN 2 ELSE 1 END AS urls, ty = 'error' AS invalid, k % 10 = 0 AND ty NOT IN ('view', 'error') AS fails FROM e)"""


@query(f"""{_PASS_SQL}, h AS (SELECT * FROM m WHERE event_id % 2 = 0), first AS (SELECT COUNT(*) AS seen, COUNT(*) FILTER (WHERE ty <> 'view') AS quoted, SUM(CASE WHEN NOT invalid AND NOT fails THEN urls ELSE 0 END) AS processed, SUM(CASE WHEN fails THEN urls ELSE 0 END) AS failed, SUM(CASE WHEN invalid THEN urls ELSE 0 END) AS skipped FROM h),
todo AS (SELECT * FROM m WHERE event_id % 2 = 1 OR fails), second AS (SELECT COUNT(*) AS seen, COUNT(*) FILTER (WHERE ty <> 'view') AS quoted, SUM(CASE WHEN NOT invalid THEN urls ELSE 0 END) AS processed, 0 AS failed, SUM(CASE WHEN invalid THEN urls ELSE 0 END) AS skipped FROM todo),
one AS (SELECT 1 AS pass, * FROM first UNION ALL SELECT 2, * FROM second UNION ALL SELECT 3, 0, 0, 0, 0, 0)
SELECT CAST(pass AS BIGINT) AS pass, CAST(seen AS BIGINT) AS messages_seen, CAST(quoted AS BIGINT) AS messages_with_quotes, CAST(COALESCE(processed, 0) AS BIGINT) AS quotes_processed, CAST(COALESCE(failed, 0) AS BIGINT) AS quotes_failed, CAST(COALESCE(skipped, 0) AS BIGINT) AS quotes_skipped,
CASE pass WHEN 1 THEN (SELECT arg_max(event_id, (d, CAST(event_id AS VARCHAR))) FROM h WHERE NOT fails) ELSE (SELECT arg_max(event_id, (d, CAST(event_id AS VARCHAR))) FROM m) END AS last_completed, (SELECT COUNT(*) FROM h WHERE fails) * CASE WHEN pass = 1 THEN 1 ELSE 0 END AS in_progress FROM one""")  # fmt: skip
def q_incremental_pass(read, spark):
    """Three passes over messages: half of them with quotes that fail, then all with quotes that don't, then again; the state between them is stored."""
    k = F.get_json_object("props", "$.k").cast("int")
    ty, m = F.col("event_type"), _s("event_id")
    url = lambda n: F.concat(F.lit(f"https://q.example.com/ver?n={n}&id="), m)
    urls = F.when(ty == "click", F.array(url(1), url(2), url(2))).when(ty == "error", F.array(F.lit("https://elsewhere.example.com/"))).when(ty != "view", F.array(url(1)))
    found = read("events").select("event_id", m.alias("message_id"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("internal_date_ms"), F.when(ty == "view", "link_not_found").otherwise("extracted").alias("extraction_status"), F.coalesce(urls, F.array().cast("array<string>")).alias("quote_urls"), ((k % 10 == 0) & ~ty.isin("view", "error")).alias("fails"))
    states = state.StateStore(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}")
    valid = lambda u: F.col("url").startswith("https://q.example.com/")
    bad = found.where("fails").select(F.col("message_id").alias("_m"))

    def shaky(quotes):
        d = quotes.join(bad, F.col("message_id") == F.col("_m"), "left")
        return d.select("quote_key", F.when(F.col("_m").isNull(), "processed").otherwise("failed").alias("status"), F.when(F.col("_m").isNotNull(), "no answer").alias("error"))

    def steady(quotes):
        return quotes.select("quote_key", F.lit("processed").alias("status"), F.lit(None).cast("string").alias("error"))

    rows = []
    assert states.claim("caller") and not states.claim("caller")
    for number, (some, process) in enumerate(((found.where("event_id % 2 = 0"), shaky), (found, steady), (found, steady)), 1):
        counters = state.process_once(some, states, process, valid)
        now = states.load()
        assert now.stage == state.IDLE and now.last_run == counters
        at = state.cursor(now).first()
        rows.append((number, *(counters[c] for c in ("messages_seen", "messages_with_quotes", "quotes_processed", "quotes_failed", "quotes_skipped")), int(at.message_id), now.messages.where("status = 'in_progress'").count()))
    states.release("caller")
    return spark.createDataFrame(rows, "pass long, messages_seen long, messages_with_quotes long, quotes_processed long, quotes_failed long, quotes_skipped long, last_completed long, in_progress long")


@query("""SELECT n_nationkey AS quote_id, array_to_string(list_filter(['global', 'insurer:sura', CASE WHEN n_nationkey % 2 = 0 THEN 'workshop:taller ' || n_nationkey END, CASE WHEN n_nationkey % 3 = 0 THEN 'workshop:otro' END, 'vehicle_brand:' || lower(n_name)], lambda x: x IS NOT NULL), ',') AS scopes,
CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE 'solo' END AS listed, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS scalar FROM nation""")  # fmt: skip
def q_scopes(read, spark):
    """Scopes of quotes in their order, and values of preferences from JSON scalars, lists and objects."""
    k = F.col("n_nationkey")
    scopes = preferences.scopes(F.lit("x_y_SURA"), F.when(k % 2 == 0, F.concat(F.lit("Tállér "), k.cast("string"))), F.when(k % 3 == 0, "Otro").when(k % 4 == 0, F.concat(F.lit(" TALLER  "), k.cast("string"))), F.col("n_name"))
    said = F.transform(scopes, lambda x: F.concat_ws(":", x["scope"], x["scope_key"]))
    raw = F.when(k % 4 == 0, '{"providers":["A"," b "]}').when(k % 2 == 0, '["a","B",""]').otherwise('"Solo"')
    one = F.when(k % 4 == 0, '{"enabled":true}').when(k % 2 == 0, "true").otherwise('"false"')
    return read("nation").select(k.alias("quote_id"), F.array_join(said, ",").alias("scopes"), F.array_join(preferences.values(raw, ("provider_id", "provider_ids", "providers")), ",").alias("listed"), preferences.scalar(one, "enabled").alias("scalar"))


@query(f"""{vehicle_queries._reviewed_sql()}, m AS (SELECT DISTINCT quote_id, part_id FROM ranked), o AS (SELECT DISTINCT quote_id, part_id FROM r)
SELECT 'matching' AS what, 'completed' AS status, COUNT(*) AS n FROM ranked UNION ALL SELECT 'review', 'completed', COUNT(*) FROM r UNION ALL SELECT 'report', 'completed', (SELECT COUNT(DISTINCT quote_id) FROM req) UNION ALL SELECT 'sync', 'skipped', NULL
UNION ALL SELECT 'quotes seen', 'summary', (SELECT COUNT(DISTINCT quote_id) FROM req) UNION ALL SELECT 'quotes with provider', 'summary', (SELECT COUNT(DISTINCT quote_id) FROM m) UNION ALL SELECT 'quotes with agentic', 'summary', (SELECT COUNT(DISTINCT quote_id) FROM o)
UNION ALL SELECT 'broken', 'failed', NULL UNION ALL SELECT 'after', 'not_run', NULL""")  # fmt: skip
def q_refresh(read, spark):
    """A refresh of matches, reviews and reports as a job of steps, its summary, and a job with a step that fails."""
    from ..operators import jobs, matching

    asked = vehicle_queries.requests(read)
    steps = [
        jobs.Step("matching", lambda d: vehicle_queries.matched(read)),
        jobs.Step("review", lambda d: review.review(d["matching"], policy=vehicle_queries.POLICY)),
        jobs.Step("report", lambda d: matching.report(asked, d["matching"]).join(asked.join(d["review"].select("part_id").distinct(), "part_id").groupBy("quote_id").agg(F.count("*").alias("parts_with_options")), "quote_id", "left")),
        jobs.Step("sync", lambda d: d["report"], enabled=False),
    ]
    root = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    run = jobs.refresh(spark, steps, root)
    assert run.status == "completed"
    s = jobs.read_summary(run.tables["report"])
    summary = s.select(F.expr("stack(3, 'quotes seen', quotes_seen, 'quotes with provider', quotes_with_provider, 'quotes with agentic', quotes_with_agentic) AS (what, n)")).select("what", F.lit("summary").alias("status"), "n")
    broken = jobs.refresh(spark, [jobs.Step("broken", lambda d: d["nothing"]), jobs.Step("after", lambda d: d["broken"])], root)
    rows = run.table(spark).unionByName(broken.table(spark)).select(F.col("step").alias("what"), "status", F.col("rows").alias("n"))
    return rows.unionByName(summary)


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), u AS (SELECT 'https://q.example.com/' || (k % 13) AS url, MIN(CASE WHEN event_type = 'click' THEN event_id ELSE 1000000000 + event_id END) AS place FROM e WHERE event_type IN ('click', 'signup') GROUP BY 1)
SELECT 'imported' AS what, COUNT(*) FILTER (WHERE k % 4 = 0) AS n, '' AS said FROM e UNION ALL SELECT 'updated', COUNT(*) FILTER (WHERE k % 4 = 1), '' FROM e UNION ALL SELECT 'skipped', COUNT(*) FILTER (WHERE k % 4 = 2), '' FROM e UNION ALL SELECT 'failed', COUNT(*) FILTER (WHERE k % 4 = 3), '' FROM e
UNION ALL SELECT 'warnings', COUNT(*) FILTER (WHERE k % 4 = 3), (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT 'e' || event_id || ': bad' AS w FROM e WHERE k % 4 = 3 ORDER BY w LIMIT 50)) FROM e
UNION ALL SELECT 'urls', COUNT(*), string_agg(url, ',' ORDER BY place) FROM u UNION ALL SELECT 'trace', COUNT(*), '{"k":' || MAX(k) || '}' FROM e WHERE event_type = 'error'""")  # fmt: skip
def q_load_counters(read, spark):
    """What a load did, its first warnings; addresses given by hand and by records, in order; details of a trace."""
    from ..operators import jobs

    k = F.get_json_object("props", "$.k").cast("int")
    e = read("events").select("event_id", "event_type", k.alias("k"))
    outcome = F.element_at(t.words(("imported", "updated", "skipped", "failed")), F.col("k") % 4 + 1)
    c = jobs.load_counters(e.select(F.concat(F.lit("e"), _s("event_id")).alias("source"), outcome.alias("outcome"), F.when(F.col("k") % 4 == 3, "bad").alias("warning")))
    none = F.lit("")
    names = ("imported", "updated", "skipped", "failed", "warnings")
    rows = c.select(F.inline(F.array(*(F.struct(F.lit(n).alias("what"), F.col(n).alias("n"), (F.array_join("warning_messages", ",") if n == "warnings" else none).alias("said")) for n in names))))
    url = F.concat(F.lit(" https://q.example.com/"), (F.col("k") % 13).cast("string"), F.lit(" "))
    given = e.where("event_type = 'click'").select(F.col("event_id").alias("pos"), url.alias("url"))
    records = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "signup", "extracted").otherwise("sender_mismatch").alias("extraction_status"), url.alias("quote_url"))
    asked = jobs.asked_urls(given, records).agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("u"))
    asked = asked.select(F.lit("urls").alias("what"), F.size("u").cast("long").alias("n"), F.array_join(F.transform("u", lambda x: x["url"]), ",").alias("said"))
    traced = e.where("event_type = 'error'").select(F.col("k"), jobs.trace("error", F.lit("m"), F.lit("2024-01-01").cast("timestamp"), k=F.col("k")).alias("x")).agg(F.count("x").alias("n"), F.max_by("x.details", "k").alias("said"))
    return rows.unionByName(asked).unionByName(traced.select(F.lit("trace").alias("what"), "n", "said"))


@query("""WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 7 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'imported' WHEN c_custkey % 3 = 1 THEN 'skipped' ELSE 'updated' END AS o FROM customer),
c AS (SELECT k, o, CASE WHEN o IN ('imported', 'updated') THEN 2 ELSE CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END END AS chunks FROM f)
SELECT 'imported' AS what, COUNT(*) FILTER (WHERE o = 'imported') AS n FROM f UNION ALL SELECT 'updated', COUNT(*) FILTER (WHERE o = 'updated') FROM f UNION ALL SELECT 'skipped', COUNT(*) FILTER (WHERE o = 'skipped') FROM f UNION ALL SELECT 'failed', COUNT(*) FILTER (WHERE o = 'failed') FROM f
UNION ALL SELECT 'documents', COUNT(*) FILTER (WHERE o <> 'failed' OR k % 3 <> 0) FROM f UNION ALL SELECT 'chunks', CAST(SUM(chunks) AS BIGINT) FROM c UNION ALL SELECT 'new chunks', CAST(SUM(CASE WHEN o IN ('imported', 'updated') THEN 2 ELSE 0 END) AS BIGINT) FROM c UNION ALL SELECT 'dry run documents', COUNT(*) FILTER (WHERE k % 3 <> 0) FROM f
UNION ALL SELECT 'again skipped', COUNT(*) FILTER (WHERE o <> 'failed') FROM f""")  # fmt: skip
def q_ingest(read, spark):
    """Documents of two pages ingested over a store: new, changed, unchanged and broken ones; a dry run; a second run."""
    from ..operators import ingest
    from ..shared import staged

    k, s = F.col("c_custkey"), _s("c_custkey")
    page = lambda n: F.struct(F.lit(n).alias("page"), F.concat(F.lit(f"page {n} of "), F.col("c_name")).alias("text"))
    files = staged(read("customer").select(s.alias("path"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha256"), F.col("c_name").alias("title"), F.array(page(1), page(2), F.struct(F.lit(3).alias("page"), F.lit(" ").alias("text"))).alias("pages"), F.when(k % 10 == 7, "damaged").alias("error")), "files")
    old = read("customer").where(k % 3 != 0)
    docs = old.select(s.alias("path"), F.when(k % 3 == 1, F.sha2(F.col("c_name").cast("binary"), 256)).otherwise("old").alias("sha256"), F.col("c_name").alias("title"))
    chunks = old.select(s.alias("path"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page"), F.lit("stored").alias("content"))
    dry, got = ingest.ingest(files, docs, chunks, dry_run=True), ingest.ingest(files, docs, chunks)
    stored_docs, stored_chunks = staged(got.documents, "documents"), staged(got.chunks, "chunks")
    again = ingest.ingest(files, stored_docs, stored_chunks)
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    rows = got.counters.select(F.expr("stack(4, 'imported', imported, 'updated', updated, 'skipped', skipped, 'failed', failed) AS (what, n)"))
    for d in (count(stored_docs, "documents"), count(stored_chunks, "chunks"), count(stored_chunks.where("content LIKE 'page _ of %'"), "new chunks"), count(dry.documents, "dry run documents"), again.counters.select(F.lit("again skipped").alias("what"), F.col("skipped").alias("n"))):
        rows = rows.unionByName(d)
    return rows


@query(f"""{vehicle_queries.scored_sql()}, ans AS (SELECT part_id, unnest([2, 0, 99, 2]) AS ix, unnest([0, 1, 2, 3]) AS choice FROM (SELECT DISTINCT part_id FROM ranked) WHERE part_id % 2 = 0),
chosen AS (SELECT r.part_id, r.item_id, r.provider_id, r.provider_name, r.score, ans.choice, row_number() OVER (PARTITION BY r.part_id, r.provider_id ORDER BY ans.choice, r.item_id) AS pn FROM ranked r JOIN ans ON r.part_id = ans.part_id AND r.rank = ans.ix + 1 WHERE ans.choice < 3 AND r.score >= CASE WHEN r.provider_id = 'prov4' THEN {review.ACCEPT_CATEGORY_ONLY} ELSE {review.ACCEPT} END)
SELECT CAST(part_id AS BIGINT) AS part_id, CAST(item_id AS BIGINT) AS item_id, CAST(score AS BIGINT) AS adjusted_score, CAST(row_number() OVER (PARTITION BY part_id ORDER BY choice, item_id) AS BIGINT) AS option FROM chosen WHERE pn = 1""")  # fmt: skip
def q_model_review(read, spark):
    """A model's answers choose and order the options: positions out of range don't count, nor do those beyond three."""
    m = vehicle_queries.matched(read)
    answers = read("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("part_id"), F.array(F.lit(2), F.lit(0), F.lit(99), F.lit(2)).alias("indexes"))
    got = review.review(m, lambda c: review.chosen_indexes(c, answers), policy=vehicle_queries.POLICY)
    return got.select("part_id", "item_id", F.col("adjusted_score").cast("long").alias("adjusted_score"), F.col("option").cast("long").alias("option"))
