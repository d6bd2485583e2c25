"""Linkage with all rules: every part is an item with brand, line, years and traits; every nation asks for a part of a vehicle.

Items and requests take their words from lists by their keys, so that each rule
(signals of kinds, sides, colours, finishes, kits, years, vehicles, preferences,
providers with a policy) is met by some pairs. Titles' similarity stays out, as
SQL can't say it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as t
from ..operators import matching, review
from ..shared import dealt
from .matching_queries import _GROUP, _TAX, norm_sql, words_sql
from .registry import query

KINDS = ["filtro de aceite", "bujia", "plumilla", "jgo plumillas", "bomba de combustible", "filtro combustible", "farola", "bomper"]
TRAITS = ["", "izquierda", "derecha", "delantera", "trasera", "negro", "blanco", "cromado", "kit", "unidad", "mate"]
BRANDS = ["Mazda", "Kia", "Renault", "Chevrolet"]
LINES = ["CX5", "Rio", "Logan", "Spark GT", "Modelo"]
VERSIONS = ["Sport Grand", "Life", None]
YEARS = ["2012", "2018", None, "2030"]
LIMIT = 40
POLICY = lx.ProviderPolicy(category_only=("prov4",), partial=("prov3",))
#: Preferences of quotes q1 to q3; q0 has none.
PREFERENCES = {
    "q1": {"preferred_providers": ["prov1"], "avoided_providers": ["prov2"], "preferred_brands": [], "avoided_brands": ["kia"], "prefer_exact_reference": False, "year_tolerance": 0, "max_options": None},
    "q2": {"preferred_providers": [], "avoided_providers": [], "preferred_brands": ["renault"], "avoided_brands": [], "prefer_exact_reference": False, "year_tolerance": 2, "max_options": None},
    "q3": {"preferred_providers": [], "avoided_providers": ["prov0"], "preferred_brands": [], "avoided_brands": [], "prefer_exact_reference": True, "year_tolerance": 0, "max_options": 2},
}


def _of(values, at):
    """The value in a place (counted from 0) of a list."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (at + 1).cast("int"))


def items(read):
    k, s = F.col("p_partkey"), F.col("p_size")
    brand = _of(BRANDS, F.floor(k / 8) % 4)
    line = F.when(k % 7 != 3, _of(LINES, F.floor(k / 8) % 5))
    years = F.when(k % 3 == 1, "2010-2015").when(k % 3 == 2, "2018")
    title = F.concat_ws(" ", _of(KINDS, k % 8), _of(TRAITS, s % 11), F.when(k % 5 != 2, brand), line, years)
    none = F.lit(None).cast("string")
    d = dealt(read("part"), "p_partkey").select(
        k.alias("item_id"), F.concat(F.lit("prov"), (s % 5).cast("string")).alias("provider_id"), F.concat(F.lit("Provider "), (s % 5).cast("string")).alias("provider_name"), F.when(s % 5 == 4, "category_only").otherwise("product_catalog").alias("provider_type"), title.alias("title"),
        _of(KINDS, (k + F.when(k % 11 == 0, 1).otherwise(0)) % 8).alias("category_name"), none.alias("subcategory_name"), F.when(k % 4 == 0, brand).alias("brand"), F.when(k % 2 == 0, F.concat(F.lit("ZQ-9"), k.cast("string"), F.lit("7"))).alias("reference"), none.alias("sku"), none.alias("code"), none.alias("detail_url"),
        F.lit(False).alias("manual"),
    )
    return d.withColumn("taxonomies", matching.taxonomies(F.col("title"), F.col("category_name"))).withColumn("tokens", t.tokens(F.col("title"), F.col("brand"), F.col("category_name")))


def requests(read):
    n = F.col("n_nationkey")
    prefs = F
    for q, bundle in PREFERENCES.items():
        words = lambda f: t.words(bundle[f])  # noqa: E731, B023
        fields = [words(f).alias(f) for f in ("preferred_providers", "avoided_providers", "preferred_brands", "avoided_brands")]
        fields += [F.lit(bundle["prefer_exact_reference"]).alias("prefer_exact_reference"), F.lit(bundle["year_tolerance"]).alias("year_tolerance"), F.lit(bundle["max_options"]).cast("int").alias("max_options")]
        prefs = prefs.when(F.concat(F.lit("q"), (n % 4).cast("string")) == q, F.struct(*fields))
    return read("nation").select(
        F.concat(F.lit("q"), (n % 4).cast("string")).alias("quote_id"), n.alias("part_id"), F.concat_ws(" ", _of(KINDS, n % 8), _of(TRAITS, n % 11)).alias("part_name"), F.when(n % 5 == 0, F.concat(F.lit("zq 9"), (n * 2).cast("string"), F.lit("7"))).alias("reference"),
        _of(BRANDS, n % 4).alias("brand"), _of(LINES, n % 5).alias("line"), _of(VERSIONS, n % 3).alias("version"), _of(YEARS, n % 4).alias("year"), prefs.alias("prefs"),
    )


def _signal_sql(own: str, whole: str) -> str:
    has = lambda *w: f"list_has_any({own}, {list(w)})"
    return f"""CASE WHEN {has('filtro', 'filtros')} AND {has('combustible')} THEN 'fuel_filter' WHEN contains(' ' || {whole} || ' ', ' bomba de combustible ') OR ({has('bomba')} AND {has('combustible')}) THEN 'fuel_pump'
  WHEN {has(*lx.WIPERS)} AND {has(*lx.KIT_HINTS)} THEN 'wiper_kit' WHEN {has(*lx.WIPERS)} THEN 'wiper' WHEN {has('bujia', 'bujias')} THEN 'spark_plug' WHEN {has('filtro', 'filtros', 'filtracion')} THEN 'filter' END"""


def _list_sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _prefs_sql(field: str, empty: str) -> str:
    def said(v):
        return "NULL" if v is None else _list_sql(v) if isinstance(v, list) else str(v)

    return "CASE quote_id " + " ".join(f"WHEN '{q}' THEN {said(b[field])}" for q, b in PREFERENCES.items() if b[field] not in ([], None)) + f" ELSE {empty} END"


def scored_sql() -> str:
    ref = "NULLIF(regexp_replace(upper(COALESCE({0}, '')), '[^A-Z0-9]+', '', 'g'), '')"
    brand, shown = f"{_list_sql(BRANDS)}[CAST((p_partkey // 8) % 4 AS INT) + 1]", "title || ' ' || category_name || '  ' || COALESCE(reference, '') || '  '"
    asked = "COALESCE(part_name, '') || ' ' || COALESCE(reference, '')"
    without = lambda x, *lists: f"list_filter({x}, lambda w: " + " AND ".join(f"NOT list_contains({y}, w)" for y in lists) + ")"
    flags = ", ".join(f"CASE WHEN {_GROUP('q_words', g)} <> {_GROUP('i_words', g)} THEN '{f}' END" for f, g, _ in lx.CONFLICTS)
    accepts = "CASE q_signal " + " ".join(f"WHEN '{q}' THEN i_signal IN ({', '.join(repr(x) for x in ok)})" for q, ok in lx.ACCEPTED_SIGNALS.items()) + " END"
    listed = lambda x, f: f"({x} <> '' AND list_contains({_prefs_sql(f, '[]::VARCHAR[]')}, {x}))"
    caps = "value"
    for flag, cap in lx.SOFT_CAPS.items():
        caps = f"LEAST({caps}, CASE WHEN list_contains(risk, '{flag}') THEN {cap} ELSE 1000 END)"
    return f"""WITH req AS (SELECT 'q' || (n_nationkey % 4) AS quote_id, n_nationkey AS part_id, concat_ws(' ', {_list_sql(KINDS)}[CAST(n_nationkey % 8 AS INT) + 1], {_list_sql(TRAITS)}[CAST(n_nationkey % 11 AS INT) + 1]) AS part_name,
    CASE WHEN n_nationkey % 5 = 0 THEN 'zq 9' || (n_nationkey * 2) || '7' END AS reference, {_list_sql(BRANDS)}[CAST(n_nationkey % 4 AS INT) + 1] AS brand, {_list_sql(LINES)}[CAST(n_nationkey % 5 AS INT) + 1] AS line,
    {_list_sql(VERSIONS)}[CAST(n_nationkey % 3 AS INT) + 1] AS version, {_list_sql(YEARS)}[CAST(n_nationkey % 4 AS INT) + 1] AS year FROM nation),
q1 AS (SELECT quote_id, part_id, part_name, reference AS q_reference, year, {ref.format('reference')} AS q_ref, {without(words_sql(asked), list(lx.GENERIC_PART))} AS q_tok, {words_sql('brand')} AS q_brand, {without(words_sql('line'), list(lx.GENERIC_VEHICLE))} AS line0, {without(words_sql('version'), list(lx.GENERIC_VEHICLE))} AS version0,
    {_TAX(asked)} AS q_tax, {_signal_sql(words_sql('part_name'), norm_sql('part_name'))} AS q_signal, CAST(year AS INT) AS q_year, {words_sql('part_name')} AS q_words FROM req),
q2 AS (SELECT *, {without('line0', 'q_brand')} AS q_line FROM q1),
q3 AS (SELECT *, {without('version0', 'q_brand', 'q_line')} AS q_version FROM q2),
q AS (SELECT *, list_distinct(list_concat(q_brand, q_line, q_version)) AS q_vehicle FROM q3),
cat AS (SELECT p_partkey AS item_id, 'prov' || (p_size % 5) AS provider_id, 'Provider ' || (p_size % 5) AS provider_name, CASE WHEN p_size % 5 = 4 THEN 'category_only' ELSE 'product_catalog' END AS provider_type,
    concat_ws(' ', {_list_sql(KINDS)}[CAST(p_partkey % 8 AS INT) + 1], {_list_sql(TRAITS)}[CAST(p_size % 11 AS INT) + 1], CASE WHEN p_partkey % 5 <> 2 THEN {brand} END, CASE WHEN p_partkey % 7 <> 3 THEN {_list_sql(LINES)}[CAST((p_partkey // 8) % 5 AS INT) + 1] END, CASE p_partkey % 3 WHEN 1 THEN '2010-2015' WHEN 2 THEN '2018' END) AS title,
    {_list_sql(KINDS)}[CAST((p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END) % 8 AS INT) + 1] AS category_name, CASE WHEN p_partkey % 4 = 0 THEN {brand} END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'ZQ-9' || p_partkey || '7' END AS reference,
    CASE p_partkey % 3 WHEN 1 THEN [2010, 2011, 2012, 2013, 2014, 2015] WHEN 2 THEN [2018] ELSE []::INT[] END AS i_years FROM part),
i1 AS (SELECT *, {_TAX("title || ' ' || category_name")} AS i_tax, {words_sql("title || ' ' || COALESCE(brand, '') || ' ' || category_name")} AS tokens, {words_sql(shown)} AS i_words, {ref.format('reference')} AS i_ref, list_filter({words_sql('brand')}, lambda w: list_contains({list(lx.VEHICLE_BRANDS)}, w)) AS i_own FROM cat),
i2 AS (SELECT *, {_signal_sql(words_sql("title || ' ' || category_name || '  ' || array_to_string(i_tax, ' ')"), norm_sql("title || ' ' || category_name || '  ' || array_to_string(i_tax, ' ')"))} AS i_signal, CASE WHEN len(i_own) > 0 THEN i_own ELSE list_filter(tokens, lambda w: list_contains({list(lx.VEHICLE_BRANDS)}, w)) END AS i_brands FROM i1),
item AS (SELECT *, len(i_brands) > 0 OR regexp_matches(' ' || {norm_sql('title')} || ' ', ' modelos? ') AS scoped FROM i2),
cand AS (SELECT DISTINCT part_id, item_id FROM (SELECT part_id, item_id FROM q JOIN item ON q_ref = i_ref
  UNION ALL SELECT part_id, item_id FROM (SELECT part_id, unnest(list_concat(q_tok, q_vehicle, CASE WHEN year IS NULL THEN []::VARCHAR[] ELSE [year] END)) AS w FROM q) a JOIN (SELECT item_id, unnest(tokens) AS w FROM item) b ON a.w = b.w
  UNION ALL SELECT part_id, item_id FROM (SELECT part_id, unnest(q_tax) AS x FROM q) a JOIN (SELECT item_id, unnest(i_tax) AS x FROM item) b ON a.x = b.x)),
p AS (SELECT q.*, item.*, list_filter([{flags}, CASE WHEN q_year IS NOT NULL AND len(i_years) > 0 AND len(list_filter(i_years, lambda y: abs(y - q_year) <= {_prefs_sql('year_tolerance', '0')})) = 0 THEN 'year_mismatch' END], lambda f: f IS NOT NULL) AS risk,
    COALESCE(q_ref = i_ref, FALSE) AS exact, list_has_any(q_tax, i_tax) AS tax, len(list_intersect(q_tok, tokens)) AS n_tok, len(list_intersect(q_brand, tokens)) AS n_brand, len(list_intersect(q_line, tokens)) AS n_line, len(list_intersect(q_version, tokens)) AS n_version, len(list_intersect(q_vehicle, tokens)) AS n_vehicle,
    CASE WHEN q_signal IS NULL OR i_signal IS NULL THEN 0 WHEN NOT {accepts} THEN 0 WHEN q_signal = i_signal THEN CASE WHEN q_signal IN {tuple(lx.SPECIFIC_SIGNALS)} THEN 28 ELSE 24 END ELSE 20 END AS signal, COALESCE(q_signal IS NOT NULL AND i_signal IS NOT NULL AND NOT {accepts}, FALSE) AS clash
  FROM cand JOIN q USING (part_id) JOIN item USING (item_id)),
kept AS (SELECT *, CASE WHEN exact THEN 100 ELSE LEAST(CASE WHEN tax THEN 30 ELSE 0 END + signal + CAST(round_even(CASE WHEN len(q_tok) > 0 THEN n_tok / len(q_tok) ELSE 0 END * 45.0, 0) AS INT) + LEAST(n_brand * 12, 24) + LEAST(n_line * 10, 20) + LEAST(n_version * 4, 12) + LEAST(n_vehicle * 3, 9),
    CASE WHEN scoped AND len(q_brand) > 0 AND n_brand = 0 THEN 10 ELSE 1000 END, CASE WHEN scoped AND len(q_line) > 0 AND n_brand > 0 AND n_line = 0 THEN 18 ELSE 1000 END, CASE WHEN scoped AND len(q_version) > 0 AND n_brand > 0 AND n_line > 0 AND n_version = 0 THEN 68 ELSE 1000 END) END AS value
  FROM p WHERE NOT list_has_any(risk, {list(lx.HARD_FLAGS)}) AND (exact OR NOT ((len(i_brands) > 0 AND NOT list_has_any(i_brands, q_brand)) OR clash OR (len(q_tok) > 0 AND n_tok = 0 AND provider_type <> 'category_only' AND signal <= 0)))),
liked AS (SELECT *, {caps} AS capped, {listed('provider_id', 'preferred_providers')} AS liked, {listed('provider_id', 'avoided_providers')} AS avoided, {listed("lower(COALESCE(brand, ''))", 'preferred_brands')} AS b_liked, {listed("lower(COALESCE(brand, ''))", 'avoided_brands')} AS b_avoided, {_prefs_sql('prefer_exact_reference', 'FALSE')} AND q_ref IS NOT NULL AND NOT exact AS strict FROM kept),
scored AS (SELECT *, CASE WHEN exact THEN 'exact_reference' WHEN provider_id = 'prov4' THEN '{matching.MANUAL}' WHEN tax AND score >= 70 AND n_vehicle > 0 THEN 'vehicle_compatible' WHEN tax AND score >= 35 THEN 'category_only' ELSE '{matching.MANUAL}' END AS match_type,
    list_filter([CASE WHEN liked THEN 'prioriza ' || provider_id || ' por preferencia del taller' END, CASE WHEN avoided THEN 'penaliza ' || provider_id || ' por preferencia del taller' END, CASE WHEN b_liked THEN 'marca ' || brand || ' preferida para este taller' END, CASE WHEN b_avoided THEN 'marca ' || brand || ' marcada para evitar' END,
      CASE WHEN strict THEN 'se prioriza referencia exacta cuando exista' END], lambda x: x IS NOT NULL) AS said
  FROM (SELECT *, LEAST(GREATEST(0, LEAST(100, capped + CASE WHEN liked THEN 8 ELSE 0 END - CASE WHEN avoided THEN 20 ELSE 0 END + CASE WHEN b_liked THEN 5 ELSE 0 END - CASE WHEN b_avoided THEN 12 ELSE 0 END)), CASE WHEN strict THEN 72 ELSE 1000 END,
    CASE WHEN provider_id = 'prov4' THEN CASE WHEN tax THEN 55 ELSE 25 END WHEN provider_id = 'prov3' THEN CASE WHEN tax THEN 78 ELSE 60 END WHEN NOT exact AND q_ref IS NULL THEN 88 ELSE 1000 END) AS score FROM liked) WHERE score >= 20),
firsts AS (SELECT *, row_number() OVER (PARTITION BY part_id, provider_id, {norm_sql('title')}, COALESCE(i_ref, '') ORDER BY score DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS n FROM scored),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY score DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS rank FROM firsts WHERE n = 1) WHERE rank <= {LIMIT} AND rank <= {_prefs_sql('max_options', str(LIMIT))})"""  # fmt: skip


_MANUAL_SQL = "match_type <> 'exact_reference'"
_SAYS_SQL = """CASE WHEN provider_id = 'prov4' THEN ' no expone referencia exacta publica; la coincidencia es por familia/categoria (' WHEN match_type = 'exact_reference' THEN ' muestra una referencia exacta compatible ('
 WHEN match_type = 'vehicle_compatible' THEN ' parece compatible por texto vehicular y tipo de repuesto (' WHEN provider_id = 'prov3' THEN ' ofrece una coincidencia probable por descripcion y categoria, pero requiere validar su codigo interno (' ELSE ' ofrece una coincidencia parcial por nombre/categoria (' END"""


def matched(read):
    return matching.match(requests(read), items(read), LIMIT, POLICY, title_similarity=False)


@query(f"""{scored_sql()} SELECT CAST(part_id AS BIGINT) AS part_id, CAST(item_id AS BIGINT) AS item_id, CAST(rank AS BIGINT) AS rank, CAST(score AS BIGINT) AS score, match_type, array_to_string(risk, ',') AS risk_flags, array_to_string(said, ';') AS preference_notes,
CASE WHEN len(risk) > 0 THEN 'warning' WHEN provider_id = 'prov4' OR {_MANUAL_SQL} THEN 'insufficient_information' ELSE 'compatible' END AS state,
CASE WHEN len(risk) > 0 THEN replace(risk[1], '_', ' ') WHEN match_type = 'exact_reference' THEN 'referencia exacta visible' WHEN provider_id = 'prov4' THEN 'coincidencia por familia o categoria; validar manualmente' WHEN len(said) > 0 THEN said[1] WHEN {_MANUAL_SQL} THEN 'informacion insuficiente; requiere validacion manual' ELSE '' END AS compatibility_summary,
provider_name || {_SAYS_SQL} || score || '%).' AS summary FROM ranked""")  # fmt: skip
def q_rule_score_full(read, spark):
    """The best items of each request, with all rules, preferences and provider policies."""
    m = matched(read)
    return m.select("part_id", "item_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("long").alias("score"), "match_type", F.array_join("risk_flags", ",").alias("risk_flags"), F.array_join("preference_notes", ";").alias("preference_notes"), F.col("compatibility_state").alias("state"), "compatibility_summary", "summary")


def _reviewed_sql() -> str:
    own, asked = words_sql("title || ' ' || COALESCE(brand, '') || ' ' || category_name || '  ' || COALESCE(reference, '') || ' '"), words_sql("part_name || ' ' || COALESCE(q_reference, '')")
    got = "title || ' ' || category_name || '  ' || COALESCE(reference, '')"
    accepts = "CASE r_want " + " ".join(f"WHEN '{q}' THEN r_got IN ({', '.join(repr(x) for x in ok)})" for q, ok in lx.ACCEPTED_SIGNALS.items()) + " END"
    return f"""{scored_sql()},
r1 AS (SELECT *, {own} AS r_own, {_signal_sql(words_sql("part_name || ' ' || COALESCE(q_reference, '')"), norm_sql("part_name || ' ' || COALESCE(q_reference, '')"))} AS r_want, {_signal_sql(words_sql(got), norm_sql(got))} AS r_got, {_prefs_sql('prefer_exact_reference', 'FALSE')} AND COALESCE(q_reference, '') <> '' AS wanted FROM ranked),
r2 AS (SELECT *, GREATEST(0, LEAST(100, CASE WHEN r_want IS NOT NULL AND r_got IS NOT NULL AND NOT {accepts} THEN 0 WHEN r_want IS NOT NULL AND r_got IS NOT NULL THEN score + CASE WHEN r_want = r_got THEN 8 ELSE 4 END ELSE score END
    + LEAST(len(list_intersect(q_brand, r_own)) * 8, 16) + LEAST(len(list_intersect(q_line, r_own)) * 7, 14) + LEAST(len(list_intersect(q_version, r_own)) * 4, 8) - CASE WHEN len(list_intersect({asked}, r_own)) = 0 AND provider_id <> 'prov4' THEN 12 ELSE 0 END
    - CASE WHEN list_contains(risk, 'year_mismatch') THEN 18 ELSE 0 END + CASE WHEN liked THEN 10 ELSE 0 END - CASE WHEN avoided THEN 18 ELSE 0 END + CASE WHEN b_liked THEN 6 ELSE 0 END - CASE WHEN b_avoided THEN 10 ELSE 0 END
    + CASE WHEN wanted THEN CASE WHEN match_type = 'exact_reference' THEN 8 ELSE -6 END ELSE 0 END - CASE WHEN r_want = 'wiper_kit' AND NOT contains({norm_sql('title')}, 'kit') THEN 18 ELSE 0 END)) AS adjusted,
    len(said) > 0 OR liked OR avoided OR b_liked OR b_avoided OR (wanted AND match_type = 'exact_reference') AS noted FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY part_id, provider_id ORDER BY adjusted DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS pn FROM r2 WHERE adjusted >= CASE WHEN provider_id = 'prov4' THEN {review.ACCEPT_CATEGORY_ONLY} ELSE {review.ACCEPT} END),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY adjusted DESC, match_type = 'exact_reference' DESC, provider_name DESC, title DESC, item_id) AS option FROM r3 WHERE pn = 1) WHERE option <= 3)"""  # fmt: skip


@query(f"""{_reviewed_sql()} SELECT CAST(part_id AS BIGINT) AS part_id, CAST(item_id AS BIGINT) AS item_id, CAST(option AS BIGINT) AS option, CAST(adjusted AS BIGINT) AS adjusted_score, 'agentic' AS explanation_source, provider_name || ': revision agentica ' ||
CASE WHEN match_type = 'exact_reference' THEN 'con referencia exacta.' WHEN list_contains(risk, 'year_mismatch') THEN 'heuristica; validar ano o modelo.' WHEN list_has_any(risk, ['color_mismatch', 'finish_mismatch']) THEN 'heuristica; validar color o acabado.' WHEN noted AND option = 1 THEN 'heuristica alineada con preferencia.'
  WHEN option = 1 THEN 'heuristica; mejor opcion.' WHEN provider_id = 'prov4' THEN 'heuristica; validar manualmente.' WHEN contains({norm_sql('title')}, 'kit') THEN 'heuristica; alternativa tipo kit.' ELSE 'heuristica; alternativa util.' END AS comment FROM r""")  # fmt: skip
def q_review_full(read, spark):
    """Second review of those matches, with preferences and provider policies."""
    got = review.review(matched(read), policy=POLICY)
    return got.select("part_id", "item_id", F.col("option").cast("long").alias("option"), F.col("adjusted_score").cast("long").alias("adjusted_score"), "explanation_source", "comment")


@query(f"""{_reviewed_sql()}, o AS (SELECT part_id, COUNT(*) AS options, arg_min(provider_id, option) AS top_provider, arg_min(adjusted, option) AS top_score FROM r GROUP BY part_id)
SELECT req.quote_id, COUNT(*) AS parts_reviewed, COUNT(o.part_id) AS parts_with_options, CAST(COALESCE(SUM(o.options), 0) AS BIGINT) AS options, CAST(MAX(o.top_score) AS BIGINT) AS best_score, COALESCE(string_agg(o.top_provider, ',' ORDER BY req.part_id), '') AS top_providers FROM req LEFT JOIN o ON req.part_id = o.part_id GROUP BY req.quote_id""")  # fmt: skip
def q_review_report(read, spark):
    """Reviewed parts of each quote: how many have options, and their top providers in order of the parts."""
    r = requests(read)
    s = review.part_summary(review.review(matched(read), policy=POLICY))
    d = r.select("quote_id", "part_id").join(s, "part_id", "left")
    tops = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("top_provider").isNotNull(), F.struct("part_id", "top_provider")))))
    return d.groupBy("quote_id").agg(F.count("*").alias("parts_reviewed"), F.count("options").alias("parts_with_options"), F.coalesce(F.sum("options"), F.lit(0)).alias("options"), F.max("top_score").cast("long").alias("best_score"), F.array_join(F.transform(tops, lambda x: x["top_provider"]), ",").alias("top_providers"))
