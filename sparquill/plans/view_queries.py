"""Views, diffs, upserts, retention and incremental queries over orders, lineitem, customer, part and events.

Orders stand for quotes (customers for their vehicles), lines for parts, lines with a
supplier of another parity for matches, and events for everything that happens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retention, snapshots, store, views
from ..shared import shared_folder
from ..streaming import incremental
from .registry import query

#: Status of a quote by that of an order.
STATUS = {"F": "failed", "O": "ready_for_review", "P": "needs_manual_review"}
_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ready_for_review' ELSE 'needs_manual_review' END"


def _quotes(read):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ready_for_review").otherwise("needs_manual_review")
    return read("orders").select(F.col("o_orderkey").alias("quote_id"), status.alias("status"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


def _parts(read):
    """Parts of a quote: its distinct part keys; ``pos`` is the part key."""
    return read("lineitem").groupBy(F.col("l_orderkey").alias("quote_id"), F.col("l_partkey").alias("pos")).agg(F.count("*").alias("lines")).withColumn("part_key", F.concat_ws("-", "quote_id", "pos"))


def _matches(read):
    """Matches of a part: its lines that weren't returned; those flagged N are exact."""
    li = read("lineitem").where("l_returnflag <> 'R'")
    kind = F.when(F.col("l_returnflag") == "N", "exact_reference").otherwise("category_only")
    return li.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("part_key"), kind.alias("match_type"), F.concat(F.lit("prov"), F.col("l_suppkey").cast("string")).alias("provider_id"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").cast("int").alias("score_percent"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").cast("decimal(20,2)").cast("string")).alias("match_key"))


def _reviews(read):
    """Reviews of a part: its lines of status F."""
    li = read("lineitem").where("l_linestatus = 'F'")
    return li.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("part_key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("review_key"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("comment"))


_LIST = f"""WITH p AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS k FROM lineitem),
m AS (SELECT l_orderkey AS q, l_partkey AS k, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_returnflag = 'N') AS x FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
r AS (SELECT l_orderkey AS q, l_partkey AS k, COUNT(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
g AS (SELECT p.q, COUNT(*) AS parts_total, COUNT(m.n) AS parts_with_matches, CAST(COALESCE(SUM(COALESCE(m.x, 0) * GREATEST(COALESCE(r.n, 0), 1)), 0) AS BIGINT) AS exact_match_rows, CAST(COALESCE(SUM(m.x), 0) AS BIGINT) AS exact_matches, COUNT(r.n) AS reviewed_parts
  FROM p LEFT JOIN m ON p.q = m.q AND p.k = m.k LEFT JOIN r ON p.q = r.q AND p.k = r.k GROUP BY p.q),
list AS (SELECT o_orderkey AS quote_id, {_STATUS_SQL} AS status, c_name, COALESCE(parts_total, 0) AS parts_total, COALESCE(parts_with_matches, 0) AS parts_with_matches, COALESCE(exact_match_rows, 0) AS exact_match_rows, COALESCE(exact_matches, 0) AS exact_matches, COALESCE(reviewed_parts, 0) AS reviewed_parts, o_orderpriority
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN g ON o_orderkey = g.q)"""


def _list(read):
    got = views.quote_list(_quotes(read), _parts(read), _matches(read), _reviews(read))
    return got.join(read("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")


@query(f"{_LIST} SELECT * EXCLUDE (o_orderpriority) FROM list")
def q_quote_list(read, spark):
    """Quotes with counts of parts, matches and reviews."""
    return _list(read).select("quote_id", "status", "c_name", "parts_total", "parts_with_matches", "exact_match_rows", "exact_matches", "reviewed_parts")


@query(f"""{_LIST} SELECT quote_id, status, c_name FROM list WHERE status IN ('needs_manual_review', 'failed') AND contains(lower(concat_ws(' ', CAST(quote_id AS VARCHAR), status, c_name, o_orderpriority)), 'urgent')""")
def q_queue_filter(read, spark):
    """Quotes that need attention and are urgent."""
    d = _quotes(read).join(read("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumns({"key": F.col("quote_id").cast("string")})
    return views.queue(d, "needs_attention", "URGENT", ("key", "status", "c_name", "o_orderpriority")).select("quote_id", "status", "c_name")


@query(f"""WITH m AS (SELECT l_orderkey || '-' || l_partkey AS part_key, 'prov' || l_suppkey AS provider_id, CAST(l_quantity AS INT) AS score, l_linenumber AS rank, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(20,2)) AS match_key, l_orderkey AS q, l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R'),
ml AS (SELECT q, k, string_agg(provider_id || ':' || score, ';' ORDER BY rank, score DESC, match_key) AS s FROM m GROUP BY 1, 2),
r AS (SELECT l_orderkey AS q, l_partkey AS k, arg_max(l_orderkey || '-' || l_linenumber || '-' || l_suppkey, (l_shipdate, l_orderkey || '-' || l_linenumber || '-' || l_suppkey)) AS rk FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
p AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS k FROM lineitem)
SELECT o_orderkey AS quote_id, {_STATUS_SQL} AS status, COALESCE((SELECT string_agg(p.k || '[' || COALESCE(ml.s, '') || '](' || COALESCE(r.rk, '') || ')', ' ' ORDER BY p.k) FROM p LEFT JOIN ml ON p.q = ml.q AND p.k = ml.k LEFT JOIN r ON p.q = r.q AND p.k = r.k WHERE p.q = o_orderkey), '') AS parts FROM orders""")  # fmt: skip
def q_quote_detail(read, spark):
    """Quotes with their parts, each with its matches in order and its newest review."""
    d = views.detail(_quotes(read), _parts(read).withColumn("name", F.lit(None).cast("string")), _matches(read), _reviews(read))
    said = lambda p: F.concat(p["pos"].cast("string"), F.lit("["), F.coalesce(F.array_join(F.transform(p["matches"], lambda m: F.concat(m["provider_id"], F.lit(":"), m["score_percent"].cast("string"))), ";"), F.lit("")), F.lit("]("), F.coalesce(p["review"]["review_key"], F.lit("")), F.lit(")"))
    return d.select("quote_id", "status", F.coalesce(F.array_join(F.transform("parts", said), " "), F.lit("")).alias("parts"))


@query("""SELECT * FROM (SELECT 'provider ' || l_suppkey AS name, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey ORDER BY n DESC, 'prov' || l_suppkey LIMIT 6)
UNION ALL SELECT 'failed', COUNT(*) FILTER (WHERE o_orderstatus = 'F') FROM orders UNION ALL SELECT 'needs_attention', COUNT(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) FROM orders UNION ALL SELECT 'total', COUNT(*) FROM orders""")  # fmt: skip
def q_dashboard(read, spark):
    """Counts of quotes by status, and the six providers with most matches."""
    top = views.provider_hits(_matches(read), 6).select(F.regexp_replace("provider_id", "^prov", "provider ").alias("name"), F.col("hits").alias("n"))
    c = views.status_counts(_quotes(read), "status", {"failed": ("failed",), "needs_attention": ("failed", "needs_manual_review")})
    return top.unionByName(c.select(F.expr("stack(3, 'failed', failed, 'needs_attention', needs_attention, 'total', total) AS (name, n)")))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, COUNT(*) AS quotes, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys, arg_max(o_orderpriority, o_orderkey) AS provider_spec FROM orders GROUP BY 1""")
def q_daily_report(read, spark):
    """Quotes of each day, with the last spec seen."""
    d = _quotes(read)
    day = t.quote_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(None).cast("string"))
    got = views.daily(d, day, ["status"], F.col("o_orderpriority"))
    return got.select("day", "quotes", F.array_join(F.transform("summaries", lambda s: s["quote_id"].cast("string")), ",").alias("keys"), "provider_spec")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def q_latest_review(read, spark):
    """The newest event of each user."""
    return views.latest_by(read("events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT user_id AS provider_id, strftime(ts, '%Y-%m-%d') || CASE WHEN event_type = 'view' THEN '-full' ELSE '' END AS snapshot, event_id AS path FROM events)
SELECT a.provider_id, a.snapshot, a.path, b.snapshot AS before, b.path AS before_path FROM (SELECT provider_id, MAX(snapshot) AS snapshot, arg_max(path, (snapshot, path)) AS path FROM s GROUP BY 1) a
LEFT JOIN (SELECT provider_id, MAX(snapshot) AS snapshot, arg_max(path, (snapshot, path)) AS path FROM s WHERE snapshot < '2024-01-20' GROUP BY 1) b USING (provider_id)""")  # fmt: skip
def q_latest_snapshot(read, spark):
    """The latest snapshot of each provider, and the last one before a date."""
    s = read("events").select(F.col("user_id").alias("provider_id"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_type") == "view", "-full").otherwise("")).alias("snapshot"), F.col("event_id").alias("path"))
    b = snapshots.previous(s, F.lit("2024-01-20")).select(F.col("provider_id").alias("p"), F.col("snapshot").alias("before"), F.col("path").alias("before_path"))
    return snapshots.latest(s).join(b, F.col("provider_id") == F.col("p"), "left").drop("p")


@query("""WITH a AS (SELECT * FROM part WHERE p_size <= 40), b AS (SELECT p_partkey, p_name, CASE WHEN p_size % 7 = 0 THEN 'OTHER' ELSE p_brand END AS p_brand, CASE WHEN p_size % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_size >= 10)
SELECT COALESCE(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_retailprice IS DISTINCT FROM b.p_retailprice THEN 'p_retailprice' END], lambda v: v IS NOT NULL), ',') END AS fields
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_brand IS DISTINCT FROM b.p_brand OR a.p_retailprice IS DISTINCT FROM b.p_retailprice""")  # fmt: skip
def q_snapshot_diff(read, spark):
    """Differences of two overlapping catalogs: by size, one with other brands and prices."""
    p = read("part")
    a = p.where("p_size <= 40")
    b = p.where("p_size >= 10").withColumn("p_brand", F.when(F.col("p_size") % 7 == 0, "OTHER").otherwise(F.col("p_brand"))).withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_size") % 5 == 0, 1).otherwise(0))
    d = snapshots.diff(a, b, "p_partkey", ["p_name", "p_brand", "p_retailprice"])
    return d.withColumn("fields", F.array_join("fields", ","))


@query("""WITH a AS (SELECT conv_id AS quote_id, turn AS pos, text AS name FROM conversations WHERE role = 'user'), b AS (SELECT conv_id AS quote_id, turn - 1 AS pos, text AS name FROM conversations WHERE role <> 'user'),
n AS (SELECT quote_id, nm, MIN(pos) AS f FROM (SELECT *, NULLIF(lower(trim(regexp_replace(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))), '') AS nm FROM b) WHERE nm IS NOT NULL GROUP BY 1, 2)
SELECT a.quote_id, a.pos, COALESCE(b.pos, n.f) AS other_pos FROM (SELECT *, NULLIF(lower(trim(regexp_replace(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))), '') AS nm FROM a) a LEFT JOIN b ON a.quote_id = b.quote_id AND a.pos = b.pos LEFT JOIN n ON a.quote_id = n.quote_id AND a.nm = n.nm""")  # fmt: skip
def q_positional_join(read, spark):
    """User turns with the turn in their place, else the first with their whole text."""
    c = read("conversations").withColumn("name", F.col("text"))
    a = c.where("role = 'user'").select(F.col("conv_id").alias("quote_id"), F.col("turn").alias("pos"), "name")
    b = c.where("role <> 'user'").select(F.col("conv_id").alias("quote_id"), (F.col("turn") - 1).alias("pos"), "name")
    return store.related_parts(a, b).select("quote_id", "pos", "other_pos")


@query("""WITH e AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS fresh FROM events) SELECT user_id, event_type, arg_max(event_id, (fresh, ts, event_id)) AS event_id, round(arg_max(value, (fresh, ts, event_id)), 4) AS value FROM e GROUP BY 1, 2""")
def q_upsert_latest(read, spark):
    """Stored rows of half a month, then the other half upserted by user and type."""
    e = read("events").select("user_id", "event_type", "event_id", "value", "ts")
    got = store.upsert(e.where("ts < TIMESTAMP '2024-01-15'"), e.where("ts >= TIMESTAMP '2024-01-15'"), ["user_id", "event_type"], ["ts", "event_id"])
    return got.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("""SELECT o_orderkey AS quote_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN COALESCE(m.manual, 0) > 0 THEN 'needs_manual_review' WHEN o_orderstatus <> 'F' AND COALESCE(m.n, 0) > 0 THEN 'ready_for_review' ELSE 'extracted' END AS status,
CASE WHEN COALESCE(m.reviewed, 0) > 0 THEN 'matched' WHEN m.n > 0 THEN 'needs_review' WHEN m.n = 0 THEN 'no_match' ELSE 'requested' END AS part_status
FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS n, COUNT(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 48) AS manual, COUNT(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 45) AS reviewed FROM lineitem GROUP BY 1) m ON o_orderkey = l_orderkey""")  # fmt: skip
def q_status(read, spark):
    """Derived states of quotes and their parts."""
    if_ = lambda c: F.count(F.when(F.expr(c), 1))
    m = read("lineitem").groupBy("l_orderkey").agg(if_("l_returnflag <> 'R'").alias("n"), if_("l_returnflag = 'A' AND l_quantity > 48").alias("manual"), if_("l_linestatus = 'F' AND l_quantity > 45").alias("reviewed"))
    d = read("orders").join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.select(F.col("o_orderkey").alias("quote_id"), store.quote_status(F.col("manual"), F.col("n"), F.col("o_orderstatus") != "F", F.col("o_orderpriority") == "1-URGENT").alias("status"), store.part_status(F.col("n"), F.col("reviewed"), F.lit(None)).alias("part_status"))


@query("""WITH x AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 900 DAY),
kq AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x)), t AS (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING MAX(ts) < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY)
SELECT 'quotes' AS tbl, COUNT(*) AS n FROM kq UNION ALL SELECT 'parts', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM x)
UNION ALL SELECT 'events', COUNT(*) FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM x) AND user_id NOT IN (SELECT user_id FROM t) AND NOT ts < TIMESTAMP '2024-01-30' - INTERVAL 20 DAY
UNION ALL SELECT 'emails', COUNT(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM kq) UNION ALL SELECT 'expired', COUNT(*) FROM x
UNION ALL SELECT 'orphans', COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")  # fmt: skip
def q_retention(read, spark):
    """Rows that remain after the deletes, in their order, and what a dry run counts."""
    policy = retention.Policy(quotes=900, tasks=1, logs=20)
    quote_now, now = F.lit("2001-08-02").cast("timestamp"), F.lit("2024-01-30").cast("timestamp")
    o = read("orders").select(F.col("o_orderkey").alias("quote_id"), F.col("o_custkey").alias("email_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("open").alias("status"), (F.col("o_orderdate") + (now - quote_now)).alias("created_at"))
    e = read("events").select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("task_id"), F.col("ts").alias("created_at"), "event_type")
    tasks = e.where("event_type = 'error'").groupBy("task_id").agg(F.max("created_at").alias("created_at")).withColumn("status", F.lit("completed"))
    s = retention.Store(o, tasks, e.drop("event_type"), read("customer").select(F.col("c_custkey").alias("email_id")), {"parts": read("lineitem").select(F.col("l_orderkey").alias("quote_id"))})
    kept, dry = retention.delete_expired(s, now, policy), retention.counts(s, now, policy)
    one = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    out = one(kept.quotes, "quotes").unionByName(one(kept.children["parts"], "parts")).unionByName(one(kept.events, "events")).unionByName(one(kept.emails, "emails"))
    return out.unionByName(dry.select(F.expr("stack(2, 'expired', expired_quotes, 'orphans', orphan_emails) AS (tbl, n)")))


_STATES = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'extracted' ELSE 'completed' END"


def _states(read):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "extracted").otherwise("completed")
    return read("events").select(F.col("event_id").alias("message_id"), status.alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("internal_date_ms"))


@query(f"""WITH s AS (SELECT event_id AS message_id, {_STATES} AS status, CAST(epoch_us(ts) // 1000 AS BIGINT) AS d FROM events) SELECT MAX(d) AS internal_date_ms, arg_max(message_id, (d, message_id)) AS message_id, (SELECT COUNT(*) FROM s WHERE status <> 'completed') AS unfinished FROM s WHERE status = 'completed'""")
def q_cursor(read, spark):
    """The cursor of completed messages, and how many are to be tried again."""
    s = _states(read)
    todo = incremental.to_process(s.select("message_id", "internal_date_ms"), s).agg(F.count("*").alias("unfinished"))
    return incremental.cursor(s).crossJoin(todo)


@query("""SELECT DISTINCT user_id, event_type, hour(ts) AS hour FROM events WHERE ts >= TIMESTAMP '2024-01-15' EXCEPT SELECT DISTINCT user_id, event_type, hour(ts) FROM events WHERE ts < TIMESTAMP '2024-01-15'""")
def q_new_keys(read, spark):
    """User, type and hour of day that only the second half of the month brought together."""
    hour = F.hour(F.col("ts").cast("timestamp")).cast("long")
    e = read("events").select("user_id", "event_type", hour.alias("hour"), "ts", F.concat_ws("-", "user_id", "event_type", hour).alias("key"))
    return incremental.new_keys(e.where("ts >= TIMESTAMP '2024-01-15'"), e.where("ts < TIMESTAMP '2024-01-15'"), "key").select("user_id", "event_type", "hour").distinct()


@query("""SELECT user_id, MIN(event_id) AS first_event, COUNT(*) AS events FROM events GROUP BY user_id""")
def q_stream_dedupe(read, spark):
    """Events as a stream of files: each id once by an idempotent sink, then counted; equals the batch."""
    import uuid

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = read("events").select("event_id", "user_id", "ts")
    sink = incremental.idempotent_append(spark, f"{root}/out", ["event_id"], buckets=8)
    # three arrivals, each of which comes in a batch of its own; the second repeats half of the first, the third all
    for name, part in (("a", e.where("event_id % 2 = 0")), ("b", e.where("event_id % 4 <> 2")), ("c", e)):
        part.write.parquet(f"{root}/in/{name}")
        incremental.run_stream(spark, f"{root}/in/*", e.schema, sink, f"{root}/checkpoint", ["event_id"]).awaitTermination()
    got = incremental.appended(spark, f"{root}/out")
    return got.groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))
