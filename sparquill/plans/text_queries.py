"""Text, page, URL and retrieval queries over documents, conversations, pages, embeddings and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieval, snapshots, store
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..shared import exists, passing_folder, shared_folder
from ..sources import pages
from .matching_queries import norm_sql, words_sql
from .registry import query

ASCII = "lower(trim(regexp_replace(regexp_replace(strip_accents(COALESCE({0}, '')), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')))"


@query(f"""SELECT 's' || s_suppkey AS id, NULLIF(regexp_replace(upper(s_name), '[^A-Z0-9]+', '', 'g'), '') AS reference, NULLIF({ASCII.format('s_name')}, '') AS name FROM supplier
UNION ALL SELECT 'p' || p_partkey, NULLIF(regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g'), ''), NULLIF({ASCII.format("p_name")}, '') FROM part""")  # fmt: skip
def q_normalize_reference(read, spark):
    """References and names as they are compared."""
    one = lambda d, p, k, r, n: d.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), t.normalize_reference(F.col(r)).alias("reference"), t.normalize_name(F.col(n)).alias("name"))
    return one(read("supplier"), "s", "s_suppkey", "s_name", "s_name").unionByName(one(read("part"), "p", "p_partkey", "p_brand", "p_name"))


@query(f"""SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({words_sql('text')}, ' ')) AS tokens_md5,
CAST(len(list_filter(regexp_extract_all({ASCII.format('text')}, '[a-z0-9]+'), lambda w: length(w) >= 3)) AS BIGINT) AS long_words, md5({norm_sql('text')}) AS norm_md5 FROM documents""")  # fmt: skip
def q_tokens(read, spark):
    """Token sets of each document, as counts and digests."""
    own = t.tokens(F.col("text"))
    words = F.filter(F.regexp_extract_all(t.normalize_ascii(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    d = read("documents").select("doc_id", own.alias("own"), F.size(words).cast("long").alias("long_words"), F.md5(t.normalize(F.col("text")).cast("binary")).alias("norm_md5"))
    return d.select("doc_id", F.size("own").cast("long").alias("n_tokens"), F.md5(F.array_join("own", " ").cast("binary")).alias("tokens_md5"), "long_words", "norm_md5")


@query("""WITH s AS (SELECT o_custkey, MIN(year(o_orderdate) + 10) AS a, MAX(year(o_orderdate) + 8) AS b FROM orders GROUP BY 1),
x AS (SELECT o_custkey, a, b, CASE WHEN b >= a THEN range(a, b + 1) ELSE range(b, a + 1) END AS swapped, CASE WHEN b >= a THEN range(a, b + 1) ELSE [] END AS plain FROM s)
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list_filter([a, b], lambda y: y BETWEEN 2000 AND 2099), CASE WHEN a BETWEEN 2000 AND 2099 AND b BETWEEN 2000 AND 2099 AND abs(b - a) <= 15 THEN swapped ELSE [] END))), ',') AS matcher,
array_to_string(list_sort(list_distinct(list_concat(list_filter([a, b], lambda y: y BETWEEN 2000 AND 2099), CASE WHEN a BETWEEN 2000 AND 2099 AND b BETWEEN 2000 AND 2099 THEN plain ELSE [] END))), ',') AS retrieval FROM x""")  # fmt: skip
def q_years(read, spark):
    """Years of texts made from two dates of each customer, by the two rules."""
    d = read("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate") + 10).alias("a"), F.max(F.year("o_orderdate") + 8).alias("b"))
    d = d.withColumn("x", F.concat(F.lit("modelo "), F.col("a").cast("string"), F.lit(" - "), F.col("b").cast("string")))
    show = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ",")
    return d.select("o_custkey", show(t.years(F.col("x"))).alias("matcher"), show(t.years(F.col("x"), False, None)).alias("retrieval"))


@query(f"""WITH k AS (SELECT *, md5({norm_sql('text')}) AS record_key, len({words_sql('text')}) AS n FROM documents)
SELECT record_key, MIN(doc_id) AS first_seen, arg_max(doc_id, (n, -doc_id)) AS doc_id FROM k GROUP BY record_key""")  # fmt: skip
def q_dedupe_best(read, spark):
    """Of documents with one normalised whole text, the one with most distinct tokens; digests stand for the texts."""
    d = read("documents").select("doc_id", F.md5(t.normalize(F.col("text")).cast("binary")).alias("key"), t.tokens(F.col("text")).alias("own"))
    return snapshots.dedupe_best(d, F.col("key"), F.col("own"), "doc_id").select("record_key", "first_seen", "doc_id")


@query("""WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(COALESCE(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS x FROM documents),
cut AS (SELECT doc_id, x, 0 AS s, -1 AS n, 0 AS e, FALSE AS done FROM d
 UNION ALL SELECT doc_id, x, ns, n + 1, ne, ne >= length(x) FROM (
  SELECT doc_id, x, ns, n, CASE WHEN ns + 1400 < length(x) AND sp > ns + 910 THEN sp ELSE LEAST(ns + 1400, length(x)) END AS ne FROM (
   SELECT doc_id, x, n, ns, ns + 1400 - strpos(reverse(substr(x, ns + 1, 1400)), ' ') AS sp FROM (
    SELECT doc_id, x, n, CASE WHEN n < 0 THEN 0 ELSE GREATEST(0, e - 180) END AS ns FROM cut WHERE NOT done AND length(x) > 0)))),
c AS (SELECT doc_id, n, trim(substr(x, s + 1, e - s)) AS content FROM cut WHERE n >= 0)
SELECT doc_id, CAST(n AS BIGINT) AS chunk_index, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM c""")  # fmt: skip
def q_chunk(read, spark):
    """Chunks of each document as of one page."""
    c = retrieval.chunk(read("documents").withColumn("page", F.lit(1)), document="doc_id")
    return c.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _chunks(read):
    d = read("documents")
    return d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page"), t.text("text").alias("content"))


def _index(read, spark):
    """The stored index of the documents: made once in a session for each state of their files."""
    file = "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    files = read("documents").select(F.xxhash64(*file).alias("h")).distinct().agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("h")).first().h
    root = f"{shared_folder(spark)}/text-index-{spark.sparkContext.applicationId}-{files & (2**64 - 1):016x}"
    if exists(spark, root) and (made := TextIndex(spark, root)).segments():
        return made
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    made = TextIndex(spark, root)
    made.ingest(_chunks(read))
    return made


def _searches(read):
    """A query for each benchmark item: its third, fifth and eighth word."""
    w = retrieval.terms(F.col("text"))
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", *(F.try_element_at(w, F.lit(i)) for i in (3, 5, 8))).alias("query"))


_TERMS = "list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: w <> '')"
_HITS = f"""WITH t AS (SELECT item_id, {_TERMS.format(ASCII.format('text'))} AS w FROM benchmark),
q AS (SELECT item_id, list_distinct(list_filter([w[3], w[5], w[8]], lambda v: v IS NOT NULL)) AS q FROM t),
d AS (SELECT doc_id, list_distinct({_TERMS.format(ASCII.format('text'))}) AS own FROM documents),
p AS (SELECT doc_id, unnest(own) AS term FROM d), o AS (SELECT item_id, len(q) AS need, unnest(q) AS term FROM q WHERE len(q) > 0),
hits AS (SELECT item_id AS query_id, doc_id FROM p JOIN o USING (term) GROUP BY item_id, doc_id, need HAVING COUNT(*) = need)"""


@query(f"{_HITS} SELECT query_id, doc_id FROM hits")
def q_text_search(read, spark):
    """Documents with all terms of each query."""
    return _index(read, spark).matches(_searches(read)).select("query_id", F.col("document_id").alias("doc_id"))


@query(f"""{_HITS.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN source || ' ' || COALESCE(text, '') || ' ' || lang ELSE text END AS text FROM documents WHERE COALESCE(lang, '') <> 'de'))")} SELECT query_id, doc_id FROM hits""")
def q_text_changes(read, spark):
    """Documents with all terms of each query after French ones were replaced and German ones removed; later segments are merged."""
    index, docs = TextIndex(spark, passing_folder(spark, "text-index")), read("documents")
    index.ingest(_chunks(read))
    new = docs.where("lang = 'fr'").withColumn("text", F.concat_ws(" ", "source", F.coalesce("text", F.lit("")), "lang"))
    index.ingest(_chunks(lambda name: new))
    index.remove(docs.where("lang = 'de'").select(F.col("doc_id").alias("document_id")))
    index.merge(1)
    return index.matches(_searches(read)).select("query_id", F.col("document_id").alias("doc_id"))


#: Cover density of the matches: the last place of each of the (at most three) terms at each occurrence gives the covers.
_RANK = f"""{_HITS}, dw AS (SELECT h.query_id, h.doc_id, q.q, {_TERMS.format(ASCII.format('text'))} AS w FROM hits h JOIN q ON h.query_id = q.item_id JOIN documents USING (doc_id)),
un AS (SELECT query_id, doc_id, q, unnest(w) AS term, unnest(range(len(w))) AS pos FROM dw), oc AS (SELECT query_id, doc_id, len(q) AS need, pos, list_position(q, term) AS ti FROM un WHERE list_contains(q, term)),
la AS (SELECT *, row_number() OVER o AS rn, MAX(CASE WHEN ti = 1 THEN pos END) OVER o AS l1, MAX(CASE WHEN ti = 2 THEN pos END) OVER o AS l2, MAX(CASE WHEN ti = 3 THEN pos END) OVER o AS l3 FROM oc WINDOW o AS (PARTITION BY query_id, doc_id ORDER BY pos)),
be AS (SELECT *, CASE WHEN l1 IS NULL OR (need > 1 AND l2 IS NULL) OR (need > 2 AND l3 IS NULL) THEN NULL ELSE LEAST(l1, CASE WHEN need > 1 THEN l2 ELSE l1 END, CASE WHEN need > 2 THEN l3 ELSE l1 END) END AS begin_ FROM la),
co AS (SELECT *, COALESCE(MAX(begin_) OVER (PARTITION BY query_id, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM be),
sc AS (SELECT c.query_id, c.doc_id, round(SUM(CAST(0.1 AS DOUBLE) / (1 + (c.pos - c.begin_) - (c.rn - f.rn))), 9) AS score FROM co c JOIN la f ON c.query_id = f.query_id AND c.doc_id = f.doc_id AND c.begin_ = f.pos WHERE c.begin_ > c.before GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sc)"""


@query(f"{_RANK} SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM ranked WHERE place <= 5")
def q_text_rank(read, spark):
    """The five best documents of each query by cover density."""
    got = _index(read, spark).search(_searches(read), 5)
    return got.select("query_id", F.col("document_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def _vector_queries(read):
    """Every vector whose id is divisible by 50, against all vectors."""
    return read("embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_COSINE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), vq AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS score FROM v, vq), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM vs)"""


@query(f"WITH {_COSINE} SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM vr WHERE place <= 5")
def q_vector_topk(read, spark):
    """The five nearest vectors of each query, by exact cosine."""
    got = retrieval.vector_search(read("embeddings"), _vector_queries(read), 5)
    return got.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN label = 3 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE label IS NULL OR label <> 5),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id) AS place FROM v, q)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM r WHERE place <= 5""")  # fmt: skip
def q_vector_cells(read, spark):
    """The five nearest of each query by the stored cells, proven exact, after the vectors of one label were replaced and those of another removed; later segments are merged."""
    v = read("embeddings")
    index = VectorIndex.create(spark, passing_folder(spark, "vector-index"), v)
    index.ingest(v.where("label = 3").withColumn("embedding", F.reverse("embedding")))
    index.remove(v.where("label = 5"))
    index.merge(1)
    got = index.search(_vector_queries(read), 5, exact=True)
    return got.select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""{_RANK.replace('WITH', 'WITH ' + _COSINE + ',', 1)},
tx AS (SELECT query_id * 50 AS query_id, doc_id AS id, score AS s FROM ranked WHERE place <= 10),
vx AS (SELECT query_id, vec_id AS id, GREATEST(round(score, 6), 0.0) AS s FROM vr WHERE place <= 10),
j AS (SELECT COALESCE(tx.query_id, vx.query_id) AS query_id, COALESCE(tx.id, vx.id) AS id, COALESCE(tx.s, 0.0) AS a, COALESCE(vx.s, 0.0) AS b, tx.id IS NOT NULL AS t, vx.id IS NOT NULL AS w FROM tx FULL JOIN vx ON tx.query_id = vx.query_id AND tx.id = vx.id),
n AS (SELECT *, CASE WHEN MAX(a) OVER q > 0 THEN CAST(a AS DOUBLE) / MAX(a) OVER q ELSE 0.0 END AS x, CASE WHEN MAX(b) OVER q > 0 THEN CAST(b AS DOUBLE) / MAX(b) OVER q ELSE 0.0 END AS y FROM j WINDOW q AS (PARTITION BY query_id)),
c AS (SELECT *, round_even(CAST(x AS DOUBLE) * CAST(0.45 AS DOUBLE) + CAST(y AS DOUBLE) * CAST(0.55 AS DOUBLE) + CASE WHEN x > 0 AND y > 0 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END, 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b DESC, a DESC, id DESC) AS place FROM c)
SELECT query_id, id, round(score, 4) AS score, CASE WHEN t AND w THEN 'hybrid' WHEN t THEN 'text' ELSE 'vector' END AS retrieval_mode, CAST(place AS BIGINT) AS place FROM r WHERE place <= 5""")  # fmt: skip
def q_hybrid(read, spark):
    """The ten best text hits of each query merged with vector hits of the vector that goes with it."""
    found = _index(read, spark).search(_searches(read), 10)
    a = found.select((F.col("query_id") * 50).alias("query_id"), F.col("document_id").alias("id"), "score")
    b = retrieval.vector_search(read("embeddings"), _vector_queries(read), 10).select("query_id", F.col("vec_id").alias("id"), F.round("score", 6).alias("score"))
    got = retrieval.merge_hits(a, b, 5, keys=("id",))
    return got.select("query_id", "id", F.round("score", 4).alias("score"), "retrieval_mode", F.col("place").cast("long").alias("place"))


@query(f"""{_RANK}, f AS (SELECT query_id, doc_id, place FROM ranked),
b AS (SELECT item_id AS query_id, w[3] AS ref, w[5] AS vb, w[8] AS vl, w[2] || ' ' || w[4] AS pn FROM t),
lt AS (SELECT f.query_id, place, ref, {ASCII.format('text')} AS content, b.* EXCLUDE (query_id, ref) FROM f JOIN b USING (query_id) JOIN documents USING (doc_id) WHERE place <= 3),
ow AS (SELECT *, list_filter(list_distinct(regexp_extract_all(content, '[a-z0-9]+')), lambda w: length(w) >= 3) AS own, list_filter(list_distinct([vb, vl]), lambda w: length(w) >= 3) AS veh, list_filter(list_distinct(string_split(pn, ' ')), lambda w: length(w) >= 3) AS prt FROM lt),
m AS (SELECT query_id, place, CASE WHEN contains(content, ref) AND len(list_intersect(veh, own)) >= 1 THEN 'reference_supported' WHEN len(list_intersect(veh, own)) >= 2 AND len(list_intersect(prt, own)) >= 1 THEN 'vehicle_supported' WHEN len(list_intersect(prt, own)) >= 2 THEN 'generic_support' END AS v FROM ow)
SELECT b.query_id, COALESCE(arg_max(v, place) FILTER (WHERE v IS NOT NULL AND v <> 'generic_support'), CASE WHEN bool_or(v = 'generic_support') THEN 'generic_support' ELSE 'no_evidence' END) AS verdict FROM b LEFT JOIN m USING (query_id) GROUP BY b.query_id""")  # fmt: skip
def q_evidence(read, spark):
    """Verdicts of the three best documents of each query, folded in order."""
    hits = _index(read, spark).search(_searches(read), 3).drop("page").join(_chunks(read), ["document_id", "chunk_index"])
    hits = hits.select("query_id", "place", "content", "page", F.col("document_id").cast("string").alias("title"), "score", F.lit("text").alias("retrieval_mode"))
    w = retrieval.terms(F.col("text"))
    at = lambda i: F.try_element_at(w, F.lit(i))
    none = F.lit(None).cast("string")
    asked = read("benchmark").select(F.col("item_id").alias("query_id"), at(3).alias("asked_reference"), none.alias("candidate_reference"), none.alias("candidate_brand"), F.concat_ws(" ", at(2), at(4)).alias("part_name"), at(5).alias("vehicle_brand"), at(8).alias("vehicle_line"), none.alias("year"))
    return retrieval.evidence(asked, hits).select("query_id", "verdict")


_CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g'))"


@query(f"""SELECT page_id, COALESCE(NULLIF({_CLEAN("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), NULLIF(trim(regexp_replace({_CLEAN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '(?s)\\s+[-|–]\\s.*$', '')), '')) AS title FROM pages""")
def q_page_title(read, spark):
    """Heading or title of each page."""
    return read("pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS h, unnest(range(len(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)))) AS pos FROM pages),
a AS (SELECT page_id, pos, CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h END AS u FROM (SELECT page_id, url, pos, trim(replace(h, '&amp;', '&')) AS h FROM l WHERE NOT starts_with(h, '#') AND NOT regexp_matches(lower(h), '/feed/|\\.rss|\\.xml'))),
c AS (SELECT page_id, u, MIN(pos) AS pos FROM (SELECT page_id, pos, regexp_replace(u, '#.*$', '') AS u FROM a) WHERE u IS NOT NULL GROUP BY 1, 2)
SELECT p.page_id, CAST(COUNT(u) AS BIGINT) AS n_links, COALESCE(string_agg(u, ' ' ORDER BY pos), '') AS links FROM pages p LEFT JOIN c USING (page_id) GROUP BY p.page_id""")  # fmt: skip
def q_page_links(read, spark):
    """Absolute links of each page, in order."""
    d = read("pages").select("page_id", pages.links(F.col("html"), F.col("url")).alias("l"))
    return d.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_replace(url, '#.*$', '') AS canonical, CAST(COALESCE(TRY_CAST(NULLIF(regexp_extract(url, '(?:[?&](?:page|paged|pg)=|/page/)([0-9]+)', 1), '') AS INT), 1) AS BIGINT) AS page_no,
regexp_replace(url, '\\?[^#]*', '?[redacted]') AS masked_query, regexp_replace(url, '=[^&#]*', '=[redacted]', 'g') AS masked_values,
regexp_matches(lower(url), '/producto/|/product/|/products/|/tienda/|/shop/|/p/') OR ends_with(lower(url), '.html') AS product_like, regexp_matches(lower(url), '/feed|rss|\\.xml') AS ignored,
regexp_extract(url, '^https?://([^/?#:]+)', 1) = 'example.com' OR ends_with(regexp_extract(url, '^https?://([^/?#:]+)', 1), '.example.com') AS same_host FROM pages""")  # fmt: skip
def q_url_filters(read, spark):
    """Predicates and forms of page addresses."""
    u = F.col("url")
    return read("pages").select("page_id", t.host(u).alias("host"), t.canonical_url(u).alias("canonical"), t.page_number(u).cast("long").alias("page_no"), t.mask_query(u).alias("masked_query"), t.mask_values(u).alias("masked_values"), t.product_like(u).alias("product_like"), t.ignored(u).alias("ignored"), t.same_host(u, "example.com").alias("same_host"))


@query("""SELECT event_id, substr(sha256(event_type || chr(10) || user_id), 1, 24) AS quote_key, sha256(trim(props)) AS props_sha, CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS even FROM events""")
def q_quote_key(read, spark):
    """Keys and digests of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read("events").select("event_id", t.quote_key(F.col("event_type"), F.col("user_id").cast("string")).alias("quote_key"), t.sha256(F.col("props")).alias("props_sha"), (k % 2 == 0).alias("even"))


@query("""SELECT event_id, '{' || array_to_string(list_filter(['"id":' || event_id, CASE WHEN event_type <> 'view' THEN '"type":"' || event_type || '"' END, '"flag":' || (CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END),
CASE WHEN event_type = 'click' THEN '"tags":["click"]' END, CASE WHEN event_type <> 'error' THEN '"inner":{"zero":0}' ELSE '"inner":{"zero":0,"note":"e"}' END], lambda v: v IS NOT NULL), ',') || '}' AS doc FROM events""")  # fmt: skip
def q_compact_json(read, spark):
    """Event documents without nulls, blanks and empty lists; zeros and false stay."""
    e = F.col("event_type")
    tags = F.array(F.when(e == "click", "click"), F.lit(" "), F.lit(None).cast("string"))
    doc = F.struct(F.col("event_id").alias("id"), F.when(e == "view", "  ").otherwise(e).alias("type"), (F.col("user_id") % 2 == 0).alias("flag"), tags.alias("tags"), F.struct(F.lit(0).alias("zero"), F.when(e == "error", "e").otherwise("").alias("note")).alias("inner"), F.array().cast("array<string>").alias("none"))
    d = read("events").select("event_id", doc.alias("doc"))
    return d.select("event_id", store.compact_json(d, "doc").alias("doc"))
