"""Linkage over the shared tables: parts that were sold are requests, part and supplier make the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as t
from ..operators import matching, preferences, review
from ..shared import dealt
from .registry import query


def words_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in lx.STOPWORDS)
    return f"list_sort(list_distinct(list_filter(string_split({norm_sql(x)}, ' '), lambda w: length(w) > 1 AND w NOT IN ({stop}))))"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(COALESCE({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def sold(read):
    """Distinct names and brands of parts that were sold."""
    p = read("part").select("p_partkey", "p_name", "p_brand")
    return p.join(read("lineitem").select("l_partkey").distinct(), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_name", "p_brand").distinct()


@query(f"""WITH sold AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
req AS (SELECT p_name, p_brand, {words_sql('p_name')} AS tok FROM sold),
item AS (SELECT p_partkey, p_name AS i_name, p_brand AS i_brand, {words_sql('p_name')} AS itok FROM part),
cand AS (SELECT DISTINCT r.p_name, r.p_brand, i.p_partkey FROM (SELECT *, unnest(tok) AS w FROM req) r JOIN (SELECT *, unnest(itok) AS w FROM item) i ON r.w = i.w),
scored AS (SELECT c.p_name, c.p_brand, c.p_partkey, i_name, CAST(round_even(len(list_intersect(tok, itok)) / len(tok) * 45.0, 0) AS BIGINT) + CASE WHEN c.p_brand = i_brand THEN 24 ELSE 0 END AS score
  FROM cand c JOIN req r ON c.p_name = r.p_name AND c.p_brand = r.p_brand JOIN item i ON c.p_partkey = i.p_partkey)
SELECT p_name, p_brand, p_partkey AS item_id, score, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY score DESC, i_name DESC, p_partkey) AS rn FROM scored) WHERE rn <= 3""")  # fmt: skip
def q_blocking_topk(read, spark):
    """Candidates of each sold part by shared tokens, scored by overlap and brand, the best three."""
    asked = sold(read).withColumn("tok", t.tokens(F.col("p_name")))
    # parts with one name and brand have one score: the best three of each are enough, and names are few
    pick = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    held = read("part").select("p_partkey", "p_name", "p_brand").withColumn("n", F.row_number().over(pick)).where("n <= 3")
    names = held.select("p_name").distinct().withColumn("itok", t.tokens(F.col("p_name"))).withColumnRenamed("p_name", "i_name")
    asked_names = asked.select("p_name", "tok").distinct()
    pairs = asked_names.select("p_name", F.explode("tok").alias("w")).join(names.select("i_name", F.explode("itok").alias("w")), "w").select("p_name", "i_name").distinct()
    pairs = pairs.join(asked_names, "p_name").join(names, "i_name").select("p_name", "i_name", (F.bround(matching_share() * 45.0, 0)).cast("long").alias("points"))
    items = held.select(F.col("p_name").alias("i_name"), F.col("p_brand").alias("i_brand"), "p_partkey")
    d = asked.select("p_name", "p_brand").join(pairs, "p_name").join(items, "i_name")
    d = d.withColumn("score", F.col("points") + F.when(F.col("p_brand") == F.col("i_brand"), 24).otherwise(0))
    best = Window.partitionBy("p_name", "p_brand").orderBy(F.desc("score"), F.desc("i_name"), "p_partkey")
    return d.withColumn("place", F.row_number().over(best)).where("place <= 3").select("p_name", "p_brand", F.col("p_partkey").alias("item_id"), "score", F.col("place").cast("long").alias("place"))


def matching_share():
    return (F.size(F.array_intersect("tok", "itok")) / F.size("tok")).cast("double")


def catalog(read):
    """Every part is an item, from a provider named by its size."""
    p = dealt(read("part"), "p_partkey").select("p_name", "p_brand", "p_type", F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    title = F.concat_ws(" ", "p_name", "p_type")
    return p.select(
        F.col("k").alias("item_id"), F.concat(F.lit("prov"), (F.col("size") % 5).cast("string")).alias("provider_id"), F.concat(F.lit("Provider "), (F.col("size") % 5).cast("string")).alias("provider_name"),
        F.lit("product_catalog").alias("provider_type"), title.alias("title"), F.col("p_type").alias("category_name"), F.lit(None).cast("string").alias("subcategory_name"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("REF-"), F.col("k").cast("string")).alias("reference"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("detail_url"),
        matching.taxonomies(title).alias("taxonomies"), t.tokens(title, F.col("p_brand")).alias("tokens"), F.lit(False).alias("manual"),
    )


def requests(read):
    """A request for each part sold, in a quote for each type; every third asks by reference."""
    p = read("part").join(read("lineitem").select("l_partkey").distinct(), F.col("p_partkey") == F.col("l_partkey"), "left_semi").withColumn("k", F.col("p_partkey"))
    none = F.lit(None).cast("string")
    return p.select(
        F.col("p_type").alias("quote_id"), F.col("k").alias("part_id"), F.col("p_name").alias("part_name"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("ref "), F.col("k").cast("string"))).alias("reference"),
        none.alias("brand"), F.col("p_type").alias("line"), none.alias("version"), none.alias("year"),
    )


_GROUP = lambda x, groups: "CASE " + " ".join(f"WHEN list_has_any({x}, {list(v)}) THEN '{k}'" for k, v in groups.items()) + " END"
_TAX = lambda x: "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({norm_sql(x)}, '{'|'.join(w)}') THEN '{k}' END" for k, w in lx.TAXONOMIES.items()) + "], lambda v: v IS NOT NULL))"


def scored_sql() -> str:
    """The score of requests without brand, version and year against the catalog, without title similarity."""
    ref = "regexp_replace(upper(COALESCE({0}, '')), '[^A-Z0-9]+', '', 'g')"
    generic = list(lx.GENERIC_PART)
    title = "p_name || ' ' || p_type"
    flags = ", ".join(f"CASE WHEN {_GROUP('q_words', g)} <> {_GROUP('i_words', g)} THEN '{f}' END" for f, g, _ in lx.CONFLICTS)
    return f"""WITH req AS (SELECT p_type AS quote_id, p_partkey AS part_id, p_name AS part_name, CASE WHEN p_partkey % 3 = 0 THEN 'ref ' || p_partkey END AS reference, p_type AS line
  FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
q AS (SELECT *, NULLIF({ref.format('reference')}, '') AS q_ref, list_filter({words_sql("COALESCE(part_name, '') || ' ' || COALESCE(reference, '')")}, lambda w: NOT list_contains({generic}, w)) AS q_tok,
  {words_sql('part_name')} AS q_words, list_filter({words_sql('line')}, lambda w: NOT list_contains({list(lx.GENERIC_VEHICLE)}, w)) AS q_line, {_TAX("COALESCE(part_name, '') || ' ' || COALESCE(reference, '')")} AS q_tax FROM req),
cat AS (SELECT p_partkey AS item_id, 'prov' || (p_size % 5) AS provider_id, 'Provider ' || (p_size % 5) AS provider_name, {title} AS title, p_type, p_brand AS brand, 'REF-' || p_partkey AS i_reference FROM part),
item AS (SELECT *, {words_sql("title || ' ' || brand")} AS tokens, {words_sql("title || ' ' || p_type || '   ' || i_reference")} AS i_words, {_TAX('title')} AS i_tax,
  list_filter({words_sql("title || ' ' || brand")}, lambda w: list_contains({list(lx.VEHICLE_BRANDS)}, w)) AS i_brands, {ref.format('i_reference')} AS i_ref FROM cat),
cand AS (SELECT DISTINCT part_id, item_id FROM (
  SELECT part_id, item_id FROM q JOIN item ON q_ref = i_ref UNION ALL
  SELECT part_id, item_id FROM (SELECT part_id, unnest(list_concat(q_tok, q_line)) AS w FROM q) a JOIN (SELECT item_id, unnest(tokens) AS w FROM item) b ON a.w = b.w UNION ALL
  SELECT part_id, item_id FROM (SELECT part_id, unnest(q_tax) AS x FROM q) a JOIN (SELECT item_id, unnest(i_tax) AS x FROM item) b ON a.x = b.x)),
p AS (SELECT q.*, item.* EXCLUDE (brand), list_filter([{flags}], lambda f: f IS NOT NULL) AS risk, COALESCE(q_ref = i_ref, FALSE) AS exact, COALESCE(list_contains(tokens, q_ref), FALSE) AS in_text,
  list_has_any(q_tax, i_tax) AS tax, len(list_intersect(q_tok, tokens)) AS n_tok, len(list_intersect(q_line, tokens)) AS n_line FROM cand JOIN q USING (part_id) JOIN item USING (item_id)),
s AS (SELECT *, CASE WHEN exact THEN 100 WHEN in_text THEN 95 ELSE (CASE WHEN tax THEN 30 ELSE 0 END + CAST(round_even(n_tok / len(q_tok) * 45.0, 0) AS INT) + LEAST(n_line * 10, 20) + LEAST(n_line * 3, 9)) END AS base FROM p
  WHERE NOT list_has_any(risk, {list(lx.HARD_FLAGS)}) AND (exact OR in_text OR (len(i_brands) = 0 AND NOT (len(q_tok) > 0 AND n_tok = 0)))),
c AS (SELECT *, CASE WHEN NOT exact AND q_ref IS NULL THEN LEAST(b2, 88) ELSE b2 END AS score FROM (SELECT *, CASE WHEN list_contains(risk, 'finish_mismatch') THEN LEAST(b1, 58) ELSE b1 END AS b2 FROM (SELECT *, CASE WHEN list_contains(risk, 'color_mismatch') THEN LEAST(base, 60) ELSE base END AS b1 FROM s))),
scored AS (SELECT *, CASE WHEN exact THEN 'exact_reference' WHEN tax AND score >= 70 AND n_line > 0 THEN 'vehicle_compatible' WHEN tax AND score >= 35 THEN 'category_only' ELSE '{matching.MANUAL}' END AS match_type FROM c WHERE score >= 20)"""  # fmt: skip


_RANKED = f"""{scored_sql()},
firsts AS (SELECT *, row_number() OVER (PARTITION BY part_id, provider_id, {norm_sql('title')}, i_ref ORDER BY score DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS n FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY score DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS rank FROM firsts WHERE n = 1)"""


@query(f"""{_RANKED} SELECT CAST(part_id AS BIGINT) AS part_id, CAST(item_id AS BIGINT) AS item_id, CAST(rank AS BIGINT) AS rank, CAST(score AS BIGINT) AS score, match_type, array_to_string(risk, ',') AS risk_flags,
CASE WHEN len(risk) > 0 THEN 'warning' WHEN match_type = 'exact_reference' THEN 'compatible' ELSE 'insufficient_information' END AS state FROM ranked WHERE rank <= 5""")  # fmt: skip
def q_rule_score(read, spark):
    """Rule scores, caps, match types and states of requests against the catalog (no title similarity)."""
    m = matching.match(requests(read), catalog(read), 5, title_similarity=False)
    return m.select("part_id", "item_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("long").alias("score"), "match_type", F.array_join("risk_flags", ",").alias("risk_flags"), F.col("compatibility_state").alias("state"))


@query(f"""{_RANKED}, best AS (SELECT part_id, match_type, provider_id FROM ranked WHERE rank = 1)
SELECT quote_id, COUNT(*) AS parts_total, COUNT(match_type) AS parts_with_matches, COUNT(*) FILTER (WHERE match_type = 'exact_reference') AS exact_reference_matches,
COUNT(*) FILTER (WHERE match_type IN ('category_only', 'vehicle_compatible')) AS partial_matches, COUNT(*) FILTER (WHERE match_type = '{matching.MANUAL}') AS manual_confirmation_only,
COALESCE((SELECT string_agg(h.provider_id || '=' || h.n, ',' ORDER BY h.provider_id) FROM (SELECT r2.quote_id, b2.provider_id, COUNT(*) AS n FROM req r2 JOIN best b2 USING (part_id) GROUP BY 1, 2) h WHERE h.quote_id = req.quote_id), '') AS hits
FROM req LEFT JOIN best USING (part_id) GROUP BY quote_id""")  # fmt: skip
def q_match_report(read, spark):
    """Counts of each quote by the best match of its parts."""
    r = requests(read)
    rep = matching.report(r, matching.match(r, catalog(read), 5, title_similarity=False))
    hits = F.array_join(F.transform(F.map_entries("provider_hits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rep.withColumn("hits", hits).drop("provider_hits")


@query()
def q_title_report(read, spark):
    """The report of quotes with the similarity of titles in the score; no SQL says it, tests hold it against all pairs."""
    r = requests(read)
    rep = matching.report(r, matching.match(r, catalog(read), 5))
    hits = F.array_join(F.transform(F.map_entries("provider_hits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rep.withColumn("hits", hits).drop("provider_hits")


@query()
def q_title_similarity(read, spark):
    """Similarity of each pair of part names with a word in common."""
    names = read("part").select("p_name").distinct().withColumn("w", F.explode(t.tokens(F.col("p_name"))))
    pairs = names.select(F.col("p_name").alias("a"), "w").join(names.select(F.col("p_name").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(matching.similarity()("a", "b"), 6).alias("ratio"))


@query(f"""{_RANKED}, reviewed AS (SELECT *, GREATEST(0, LEAST(100, score + LEAST(len(list_intersect(q_line, {words_sql("title || ' ' || p_type || ' ' || i_reference")})) * 7, 14)
   - CASE WHEN len(list_intersect({words_sql("COALESCE(part_name, '') || ' ' || COALESCE(reference, '')")}, {words_sql("title || ' ' || brand_ || ' ' || p_type || '  ' || i_reference")})) = 0 THEN 12 ELSE 0 END)) AS adjusted
   FROM (SELECT ranked.*, cat.brand AS brand_ FROM ranked JOIN cat USING (item_id)) WHERE rank <= 5),
byprov AS (SELECT *, row_number() OVER (PARTITION BY part_id, provider_id ORDER BY adjusted DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS pn FROM reviewed WHERE adjusted >= 35),
opt AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY adjusted DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS o FROM byprov WHERE pn = 1)
SELECT CAST(part_id AS BIGINT) AS part_id, CAST(item_id AS BIGINT) AS item_id, CAST(o AS BIGINT) AS option, CAST(adjusted AS BIGINT) AS adjusted_score, provider_name || ': revision agentica ' ||
  CASE WHEN match_type = 'exact_reference' THEN 'con referencia exacta.' WHEN len(risk) > 0 THEN 'heuristica; validar color o acabado.' WHEN o = 1 THEN 'heuristica; mejor opcion.' ELSE 'heuristica; alternativa util.' END AS comment FROM opt WHERE o <= 3""")  # fmt: skip
def q_review_rerank(read, spark):
    """Second review of the ranked matches: at most three options, one for each provider."""
    got = review.review(matching.match(requests(read), catalog(read), 5, title_similarity=False))
    return got.select("part_id", "item_id", F.col("option").cast("long").alias("option"), F.col("adjusted_score").cast("long").alias("adjusted_score"), "comment")


@query(f"""SELECT doc_id, array_to_string({_TAX('text')}, ',') AS taxonomies FROM documents""")
def q_taxonomy(read, spark):
    """Families that each document names."""
    return read("documents").select("doc_id", F.array_join(matching.taxonomies(F.col("text")), ",").alias("taxonomies"))


_PREFS = """prefs AS (SELECT event_id AS pref_id, CASE WHEN user_id % 3 = 0 THEN 'global' ELSE 'vehicle_brand' END AS scope, CASE WHEN user_id % 3 = 0 THEN NULL ELSE lower(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][CAST(user_id % 5 + 1 AS INT)]) END AS scope_key,
  ['preferred_provider','avoided_provider','year_tolerance','max_options_per_part','prefer_exact_reference'][CAST(event_id % 5 + 1 AS INT)] AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k, ts FROM events WHERE event_type = 'signup')"""


@query(f"""WITH {_PREFS}, seg AS (SELECT DISTINCT c_mktsegment FROM customer), asked AS (SELECT c_mktsegment AS quote_id, 0 AS pos, 'global' AS scope, NULL::VARCHAR AS key FROM seg UNION ALL SELECT c_mktsegment, 1, 'vehicle_brand', lower(c_mktsegment) FROM seg),
m AS (SELECT quote_id, pos, pref_id, ts, kind, k FROM asked JOIN prefs ON asked.scope = prefs.scope AND asked.key IS NOT DISTINCT FROM prefs.scope_key),
l AS (SELECT quote_id, kind, 'prov' || (k % 5) AS v, MIN((pos, ts, pref_id)) AS f FROM m WHERE kind IN ('preferred_provider', 'avoided_provider') GROUP BY 1, 2, 3)
SELECT quote_id, COALESCE((SELECT string_agg(v, ',' ORDER BY f) FROM l WHERE l.quote_id = m.quote_id AND kind = 'preferred_provider'), '') AS preferred, COALESCE((SELECT string_agg(v, ',' ORDER BY f) FROM l WHERE l.quote_id = m.quote_id AND kind = 'avoided_provider'), '') AS avoided,
  CAST(COALESCE(arg_max(k, (pos, ts, pref_id)) FILTER (WHERE kind = 'year_tolerance'), 0) AS BIGINT) AS year_tolerance, CAST(GREATEST(1, LEAST(5, arg_max(k, (pos, ts, pref_id)) FILTER (WHERE kind = 'max_options_per_part'))) AS BIGINT) AS max_options,
  COALESCE(arg_max(k % 2 = 0, (pos, ts, pref_id)) FILTER (WHERE kind = 'prefer_exact_reference'), FALSE) AS exact FROM m GROUP BY quote_id""")  # fmt: skip
def q_prefs_fold(read, spark):
    """Preference records of each customer segment by scope, folded to one bundle (customers of a segment share their scopes)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = ["preferred_provider", "avoided_provider", "year_tolerance", "max_options_per_part", "prefer_exact_reference"]
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    kind = F.element_at(t.words(kinds), (F.col("event_id") % 5 + 1).cast("int"))
    value = (
        F.when(kind.isin(*kinds[:2]), F.to_json(F.struct(F.array(F.concat(F.lit("Prov"), (k % 5).cast("string"))).alias("providers"))))
        .when(kind == "prefer_exact_reference", F.to_json(F.struct((k % 2 == 0).alias("enabled"))))
        .otherwise(k.cast("string"))
    )
    world = F.col("user_id") % 3 == 0
    scope_key = F.when(~world, F.lower(F.element_at(t.words(segments), (F.col("user_id") % 5 + 1).cast("int"))))
    records = read("events").where("event_type = 'signup'").select(F.col("event_id").alias("pref_id"), F.when(world, "global").otherwise("vehicle_brand").alias("scope"), scope_key.alias("scope_key"), kind.alias("preference_type"), value.alias("value"), F.lit(None).cast("string").alias("notes"), F.lit(True).alias("active"), F.col("ts").alias("created_at"))
    none = F.lit(None).cast("string")
    quotes = read("customer").select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("quote_id"), preferences.scopes(none, none, none, F.col("c_mktsegment")).alias("scopes"))
    b = preferences.fold(preferences.records_of(quotes, records))
    return b.select("quote_id", F.array_join("preferred_providers", ",").alias("preferred"), F.array_join("avoided_providers", ",").alias("avoided"), F.col("year_tolerance").cast("long").alias("year_tolerance"), F.col("max_options").cast("long").alias("max_options"), F.col("prefer_exact_reference").alias("exact"))
