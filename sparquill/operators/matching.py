"""Record linkage: blocking by shared keys, rule scores, ranks, reports.

Requests (one row for each requested part) and items (one row for each catalog
entry) meet by an equi-join on exploded keys, never by a cross join. The score is
one expression tree; cheap rejections filter rows before the similarity UDF sees
them, and it sees each distinct pair of texts once.

Request columns: part_id, part_name, reference, brand, line, version, year and, by
``with_preferences``, the preference bundle ``prefs``.
Item columns: item_id, provider_id, provider_name, provider_type, title,
category_name, subcategory_name, brand, reference, sku, code, taxonomies, tokens,
manual (requires_manual_confirmation).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as t
from ..shared import dealt, staged

MANUAL = "manual_confirmation_required"
PREFS = "struct<preferred_providers:array<string>,avoided_providers:array<string>,preferred_brands:array<string>,avoided_brands:array<string>,prefer_exact_reference:boolean,year_tolerance:int,max_options:int>"


PREF_FIELDS = ("preferred_providers", "avoided_providers", "preferred_brands", "avoided_brands", "prefer_exact_reference", "year_tolerance", "max_options")


def taxonomies(*values: Column) -> Column:
    """Labels with a keyword anywhere in the normalised text, sorted; a keyword inside a longer word counts."""
    hay = t.normalize(t.joined(*values))
    # a keyword that has another one in it says nothing more; a search for plain text is several times as fast as a pattern
    least = lambda words: [w for w in words if not any(v in w for v in words if v != w)]
    hit = lambda x: F.array(*(F.when(functools.reduce(operator.or_, (x.contains(w) for w in least(words))), F.lit(label)) for label, words in lx.TAXONOMIES.items()))
    return F.array_sort(F.array_compact(t.bound(hay, hit)))


def part_signal(*values: Column) -> Column:
    """The kind of part a text names, the most specific first."""
    return t.bound(F.struct(t.tokens(*values).alias("own"), t.normalize(t.joined(*values)).alias("whole")), lambda x: _signal(x["own"], x["whole"]))


def _signal(own: Column, whole: Column) -> Column:
    has = lambda *w: F.arrays_overlap(own, t.words(w))
    filters, fuel, wiper = has("filtro", "filtros"), has("combustible"), has(*lx.WIPERS)
    return (
        F.when(filters & fuel, "fuel_filter")
        .when(t.contains_pattern(whole, own, "bomba de combustible") | (has("bomba") & fuel), "fuel_pump")
        .when(wiper & has(*lx.KIT_HINTS), "wiper_kit")
        .when(wiper, "wiper")
        .when(has("bujia", "bujias"), "spark_plug")
        .when(filters | has("filtracion"), "filter")
    )


def accepts(query: Column, item: Column) -> Column:
    out = F
    for q, ok in lx.ACCEPTED_SIGNALS.items():
        out = out.when(query == q, item.isin(*ok))
    return out.otherwise(query == item)


def signal_points(query: Column, item: Column) -> Column:
    same = F.when(query.isin(*lx.SPECIFIC_SIGNALS), 28).otherwise(24)
    return F.when(query.isNull() | item.isNull(), 0).when(~accepts(query, item), 0).when(query == item, same).otherwise(20)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that are computed where they stand.

    A generator keeps the optimiser from copying large expressions into later filters
    and from deriving constraints of every pair of them, which grows without bound.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Request keys, each computed once: ref, tok, vehicle tokens, taxonomies, signal, groups."""
    generic = t.words(lx.GENERIC_VEHICLE)
    name, reference = F.col("part_name"), F.col("reference")
    out = computed(
        requests, q_ref=t.normalize_reference(reference), q_tok=t.part_tokens(name, reference), q_brand=t.tokens(F.col("brand")), q_line=t.tokens_without(generic, F.col("line")), q_version=t.tokens_without(generic, F.col("version")),
        q_tax=taxonomies(name, reference), q_signal=part_signal(name), q_year=t.as_int(F.col("year")), q_words=t.tokens(name), q_title=t.normalize(name),
    )
    out = computed(out, q_groups=_groups("q_words"))
    out = out.withColumn("q_line", F.array_except("q_line", "q_brand")).withColumn("q_version", F.array_except(F.array_except("q_version", "q_brand"), "q_line"))
    out = computed(out, q_vehicle=F.array_distinct(F.concat("q_brand", "q_line", "q_version")))
    if "prefs" not in requests.columns:
        out = out.withColumn("prefs", F.lit(None).cast(PREFS))
    # each preference as a column of its own: pruning of nested fields fails over the windows of later steps
    return computed(out, **{f"prefs_{f}": F.col(f"prefs.{f}") for f in PREF_FIELDS}).drop("prefs")


def prepare_items(items: DataFrame) -> DataFrame:
    shown = [F.col(c) for c in ("title", "category_name", "subcategory_name", "reference", "sku", "code")]
    known = t.words(lx.VEHICLE_BRANDS)
    out = computed(
        items, i_refs=F.array_compact(F.array(*(t.normalize_reference(F.col(c)) for c in ("reference", "sku", "code")))), i_own=F.array_intersect(t.tokens(F.col("brand")), known), i_title=t.normalize(F.col("title")),
        i_signal=part_signal(F.col("title"), F.col("category_name"), F.col("subcategory_name"), F.array_join("taxonomies", " ")), i_words=t.tokens(*shown), i_years=t.years(t.joined(*shown)),
    )
    blank = lambda c: F.coalesce(t.normalize_reference(F.col(c)), F.lit(""))
    out = computed(
        out, i_brands=F.when(F.size("i_own") > 0, F.col("i_own")).otherwise(F.array_intersect("tokens", known)), i_groups=_groups("i_words"), i_provider=t.normalize(F.col("provider_id")), i_brand=t.normalize(F.col("brand")),
        i_same=F.concat_ws("|", t.text("provider_id"), "i_title", blank("reference"), blank("sku"), blank("code")),
    ).drop("i_own")
    return computed(out, i_scoped=(F.size("i_brands") > 0) | F.concat(F.lit(" "), F.col("i_title"), F.lit(" ")).rlike(" modelos? "))


def _groups(words: str) -> Column:
    """The label of each kind of conflict that some words name, in order."""
    return F.array(*(t.token_group(F.col(words), groups) for _, groups, _ in lx.CONFLICTS))


def _keys(refs: Column, taxa: Column, words: Column) -> Column:
    pair = lambda kind, x: F.transform(x, lambda v: F.concat(F.lit(kind), v))
    return F.array_distinct(F.concat(pair("r:", refs), pair("x:", taxa), pair("t:", words)))


def _asked_keys() -> Column:
    years = F.array_compact(F.array(F.when(F.length(F.col("year").cast("string")) > 1, F.col("year").cast("string"))))
    return _keys(F.array_compact(F.array("q_ref")), F.col("q_tax"), F.concat("q_tok", "q_vehicle", years))


def _held_keys() -> Column:
    return _keys(F.col("i_refs"), F.col("taxonomies"), F.col("tokens"))


#: Pairs of one key from which it is dealt over several tasks.
HOT_PAIRS = 20_000_000


def candidates(requests: DataFrame, items: DataFrame) -> DataFrame:
    """part_id, item_id: requests and items with a reference, taxonomy or token in common, each pair once.

    Only ids and keys shuffle. A key with many pairs is split: its larger side is dealt by
    ids, the smaller goes to each share. None is dropped, as that would change the
    candidates.
    """
    asked = requests.select("part_id", F.explode(_asked_keys()).alias("key"))
    held = items.select("item_id", F.explode(_held_keys()).alias("key"))
    count = lambda d, n: d.groupBy(F.col("key").alias(f"_{n}")).agg(F.count("*").alias(n))
    hot = count(asked, "a").join(count(held, "h"), F.col("_a") == F.col("_h")).where(F.col("a") * F.col("h") > HOT_PAIRS)
    shares = F.least(F.ceil(F.col("a") * F.col("h") / HOT_PAIRS), F.greatest("a", "h")).cast("long")
    hot = staged(hot.select(F.col("_a").alias("_hot"), shares.alias("shares"), (F.col("h") >= F.col("a")).alias("items_dealt")), "hot_keys")
    meets = F.col("key") == F.col("_hot")
    # a share of the own id, or all shares
    every, own = F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda c: F.array(F.pmod(F.xxhash64(c), F.col("shares")))
    at = lambda dealt, c: F.explode(F.when(F.col("shares").isNull(), F.array(F.lit(0).cast("long"))).when(dealt, own(c)).otherwise(every)).alias("share")
    asked = asked.join(hot, meets, "left").select("part_id", "key", at(~F.col("items_dealt"), "part_id"))
    held = held.join(hot, meets, "left").select("item_id", "key", at(F.col("items_dealt"), "item_id"))
    return asked.join(held, ["key", "share"]).select("part_id", "item_id").distinct()


def similarity():
    """Ratio of matching blocks of two texts (Ratcliff and Obershelp); no built-in equals it."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def run(a, b):
        import pandas as pd

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return run


def conflicts(tolerance: Column) -> tuple[Column, Column]:
    """Risk flags and notes of a pair, in order."""
    flags, notes = [], []
    for i, (flag, _, note) in enumerate(lx.CONFLICTS, 1):
        # false where either side names none
        clash = F.element_at("q_groups", i) != F.element_at("i_groups", i)
        flags.append(F.when(clash, flag))
        notes.append(F.when(clash, note))
    years = F.col("i_years")
    clash = F.coalesce(F.col("q_year") != 0, F.lit(False)) & (F.size(years) > 0) & ~F.exists(years, lambda y: F.abs(y - F.col("q_year")) <= tolerance)
    flags.append(F.when(clash, "year_mismatch"))
    span = F.concat(F.lit("ano fuera del rango visible "), F.array_min(years).cast("string"), F.lit("-"), F.array_max(years).cast("string"))
    single = F.concat(F.lit("ano visible "), F.array_min(years).cast("string"), F.lit(" no coincide"))
    notes.append(F.when(clash, F.when(F.size(years) > 4, "ano visible no coincide").when(F.size(years) > 1, span).otherwise(single)))
    return F.array_compact(F.array(*flags)), F.array_distinct(F.array_compact(F.array(*notes)))


def _points(count: Column, each: int, most: int) -> Column:
    return F.least(count * each, F.lit(most))


#: What ranks need of a scored pair.
RANKED = ["part_id", "item_id", "score", "match_type", "provider_name", "title", "i_same", "prefs_max_options"]


def score(pairs: DataFrame, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY, title_similarity: bool = True, texts: bool = True) -> DataFrame:
    """Pairs (prepared request and item columns) with score, match_type, risk_flags, notes and preference_notes; rejected ones left out.

    Without ``texts`` pairs have the columns that ranks need and no others.
    """
    p = lambda name, empty: F.coalesce(F.col(f"prefs_{name}"), empty)
    none = F.array().cast("array<string>")
    overlap = lambda x: F.size(F.array_intersect(F.col(x), F.col("tokens")))
    # what is cheap to see goes first: a side, a place or a presentation that differs
    for i, (flag, _, _) in enumerate(lx.CONFLICTS, 1):
        if flag in lx.HARD_FLAGS:
            pairs = pairs.where(~F.coalesce(F.element_at("q_groups", i) != F.element_at("i_groups", i), F.lit(False)))
    flags, notes = conflicts(p("year_tolerance", F.lit(0)))
    d = computed(pairs, **{
        "s_flags": flags,
        **({"s_notes": notes} if texts else {}),
        "s_exact": F.coalesce(F.array_contains("i_refs", F.col("q_ref")), F.lit(False)),
        "s_in_text": F.coalesce(F.array_contains("tokens", F.col("q_ref")), F.lit(False)),
        "s_tax": F.arrays_overlap("q_tax", "taxonomies"),
        "s_tok": overlap("q_tok"),
        "s_brand": overlap("q_brand"),
        "s_line": overlap("q_line"),
        "s_version": overlap("q_version"),
        "s_vehicle": overlap("q_vehicle"),
        "s_signal": signal_points(F.col("q_signal"), F.col("i_signal")),
        "s_foreign": (F.size("i_brands") > 0) & ~F.arrays_overlap("i_brands", "q_brand"),
    })
    direct = F.col("s_exact") | F.col("s_in_text")
    clash = F.coalesce(F.col("q_signal").isNotNull() & F.col("i_signal").isNotNull() & ~accepts(F.col("q_signal"), F.col("i_signal")), F.lit(False))
    stray = (F.size("q_tok") > 0) & (F.col("s_tok") == 0) & (F.coalesce(F.col("provider_type"), F.lit("")) != "category_only") & (F.col("s_signal") <= 0)
    # rejections before the similarity of titles is computed
    d = d.where(direct | ~(F.col("s_foreign") | clash | stray))
    if title_similarity:
        # a ratio is at most twice the shorter length over both: below a quarter it gives no points
        long_enough = 8 * F.least(F.length("q_title"), F.length("i_title")) >= F.length("q_title") + F.length("i_title")
        ratios = d.where(~direct & long_enough).select("q_title", "i_title").distinct().withColumn("ratio", similarity()("q_title", "i_title"))
        ratios = ratios.select(F.col("q_title").alias("qt"), F.col("i_title").alias("it"), "ratio")
        d = d.join(ratios, (F.col("q_title") == F.col("qt")) & (F.col("i_title") == F.col("it")), "left").drop("qt", "it")
    else:
        d = d.withColumn("ratio", F.lit(0.0))
    # half-even rounding of doubles
    rounded = lambda x: F.bround(x.cast("double"), 0).cast("int")
    share = F.when(F.size("q_tok") > 0, F.col("s_tok") / F.size("q_tok")).otherwise(0.0)
    added = (
        F.when(F.col("s_tax"), 30).otherwise(0)
        + F.col("s_signal")
        + rounded(share * 45)
        + F.when(F.col("ratio") >= 0.25, rounded(F.col("ratio") * 20)).otherwise(0)
        + _points(F.col("s_brand"), 12, 24)
        + _points(F.col("s_line"), 10, 20)
        + _points(F.col("s_version"), 4, 12)
        + _points(F.col("s_vehicle"), 3, 9)
    )
    scoped, brand, line = F.col("i_scoped"), F.col("s_brand") > 0, F.col("s_line") > 0
    no_brand = scoped & (F.size("q_brand") > 0) & ~brand
    no_line = scoped & (F.size("q_line") > 0) & brand & ~line
    no_version = scoped & (F.size("q_version") > 0) & brand & line & (F.col("s_version") == 0)
    capped = F.least(added, F.when(no_brand, 10).otherwise(1000), F.when(no_line, 18).otherwise(1000), F.when(no_version, 68).otherwise(1000))
    value = F.when(F.col("s_exact"), 100).when(F.col("s_in_text"), 95).otherwise(capped)
    no_cap = 1000
    value = F.least(value, *(F.when(F.array_contains("s_flags", flag), cap).otherwise(no_cap) for flag, cap in lx.SOFT_CAPS.items()))
    provider, item_brand = F.col("i_provider"), F.col("i_brand")
    listed = lambda x, name: (x != "") & F.array_contains(p(name, none), x)
    liked, avoided = listed(provider, "preferred_providers"), listed(provider, "avoided_providers")
    b_liked, b_avoided = listed(item_brand, "preferred_brands"), listed(item_brand, "avoided_brands")
    pick = lambda c, n: F.when(c, n).otherwise(0)
    value = F.greatest(F.lit(0), F.least(F.lit(100), value + pick(liked, 8) - pick(avoided, 20) + pick(b_liked, 5) - pick(b_avoided, 12)))
    strict = p("prefer_exact_reference", F.lit(False)) & F.col("q_ref").isNotNull() & ~F.col("s_exact")
    value = F.least(value, F.when(strict, 72).otherwise(no_cap))
    kind = lambda ids: F.col("provider_id").isin(*ids) if ids else F.lit(False)
    by_tax = lambda a, b: F.when(F.col("s_tax"), a).otherwise(b)
    own_cap = F.when(kind(policy.category_only), by_tax(55, 25)).when(kind(policy.partial), by_tax(78, 60)).when(~F.col("s_exact") & F.col("q_ref").isNull(), 88)
    value = F.least(value, own_cap.otherwise(no_cap))
    shown = t.text("brand")
    said = [
        F.when(liked, F.concat(F.lit("prioriza "), provider, F.lit(" por preferencia del taller"))),
        F.when(avoided, F.concat(F.lit("penaliza "), provider, F.lit(" por preferencia del taller"))),
        F.when(b_liked, F.concat(F.lit("marca "), shown, F.lit(" preferida para este taller"))),
        F.when(b_avoided, F.concat(F.lit("marca "), shown, F.lit(" marcada para evitar"))),
        F.when(strict, F.lit("se prioriza referencia exacta cuando exista")),
    ]
    d = computed(d, score=value.cast("int")).where(F.col("score") >= 20)
    compatible = F.col("s_tax") & (F.col("score") >= 70) & (F.col("s_vehicle") > 0)
    match = F.when(F.col("s_exact"), "exact_reference").when(kind(policy.category_only), MANUAL).when(compatible, "vehicle_compatible").when(F.col("s_tax") & (F.col("score") >= 35), "category_only").otherwise(MANUAL)
    if not texts:
        return d.withColumn("match_type", match).select(*RANKED)
    d = computed(d, match_type=match, preference_notes=F.array_compact(F.array(*said)))
    return d.withColumn("manual", F.coalesce(F.col("manual"), F.lit(False)) | (F.col("match_type") != "exact_reference")).withColumnsRenamed({"s_flags": "risk_flags", "s_notes": "notes"})


def with_state(d: DataFrame, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY, flags: str = "risk_flags") -> DataFrame:
    """warnings, compatibility_state, compatibility_summary and summary of ranked pairs."""
    d = computed(d, warnings=F.transform(flags, lambda x: F.replace(x, F.lit("_"), F.lit(" "))))
    kind = F.col("provider_id").isin(*policy.category_only) if policy.category_only else F.lit(False)
    state = F.when(F.arrays_overlap(flags, t.words(lx.HARD_FLAGS)), "incompatible").when(F.size(flags) > 0, "warning").when(kind | F.col("manual"), "insufficient_information").otherwise("compatible")
    summary = (
        F.when(F.size("warnings") > 0, F.try_element_at("warnings", F.lit(1)))
        .when(F.col("match_type") == "exact_reference", "referencia exacta visible")
        .when(kind, "coincidencia por familia o categoria; validar manualmente")
        .when(F.size("preference_notes") > 0, F.try_element_at("preference_notes", F.lit(1)))
        .when(F.col("manual"), "informacion insuficiente; requiere validacion manual")
        .when(F.col("match_type") == "vehicle_compatible", "compatible por vehiculo y tipo de repuesto")
        .otherwise("coincidencia parcial sin alertas visibles")
    )
    partial = F.col("provider_id").isin(*policy.partial) if policy.partial else F.lit(False)
    says = (
        F.when(kind, " no expone referencia exacta publica; la coincidencia es por familia/categoria (")
        .when(F.col("match_type") == "exact_reference", " muestra una referencia exacta compatible (")
        .when(F.col("match_type") == "vehicle_compatible", " parece compatible por texto vehicular y tipo de repuesto (")
        .when(partial, " ofrece una coincidencia probable por descripcion y categoria, pero requiere validar su codigo interno (")
        .otherwise(" ofrece una coincidencia parcial por nombre/categoria (")
    )
    return computed(d, compatibility_state=state, compatibility_summary=summary, summary=F.concat(t.text("provider_name"), says, F.col("score").cast("string"), F.lit("%).")))


def rank(scored: DataFrame, limit: int = 5) -> DataFrame:
    """The best matches of each part: first of each equal entry, then ``limit`` (or the preference, if less).

    All keys descend, so that ties prefer the last name; item_id breaks full ties.
    """
    order = [F.desc("score"), F.desc(F.col("match_type") == "exact_reference"), F.desc("provider_name"), F.desc("title"), F.asc("item_id")]
    same = Window.partitionBy("part_id", "i_same").orderBy(*order)
    first = scored.withColumn("_n", F.row_number().over(same)).where(F.col("_n") == 1)
    best = Window.partitionBy("part_id").orderBy(*order)
    most = F.least(F.lit(limit), F.coalesce(F.col("prefs_max_options"), F.lit(limit)))
    return first.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= limit) & (F.col("rank") <= most)).drop("_n")


#: What a request's scores depend on but for its own reference, and an item's but for its references.
PROFILE = ["q_brand", "q_line", "q_version", "q_vehicle", "q_tax", "q_signal", "q_year", "year", "q_groups", *(f"prefs_{f}" for f in PREF_FIELDS)]
KIND = ["tokens", "taxonomies", "i_brands", "i_scoped", "i_signal", "i_groups", "i_years", "i_provider", "i_brand", "provider_id", "provider_name", "provider_type", "title"]
#: Entries with a request's own reference from which it is scored by itself.
WIDE = 16


def _digest(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _profiles(asked: DataFrame, held: DataFrame, title: bool) -> DataFrame:
    """``asked`` with ``profile``, and q_tok and q_ref as all requests of the profile have them.

    Tokens of the reference that no item has only count, and a reference that no item
    has is only there: stand-ins that nothing equals take their places.
    """
    name = t.part_tokens(F.col("part_name"), F.lit(None).cast("string"))
    odd = asked.select(F.col("part_id").alias("_id"), F.explode(F.array_except("q_tok", name)).alias("tok"))
    known = held.select(F.explode("tokens").alias("_tok")).distinct()
    odd = odd.join(known, F.col("tok") == F.col("_tok"), "left").where(F.col("_tok").isNull()).groupBy("_id").agg(F.collect_list("tok").alias("unknown"))
    d = asked.join(odd, F.col("part_id") == F.col("_id"), "left").drop("_id")
    unknown = F.coalesce("unknown", F.array().cast("array<string>"))
    blanks = F.transform(unknown, lambda _, i: F.concat(F.lit("\u0001"), i.cast("string")))
    d = d.withColumn("q_tok", F.array_sort(F.concat(F.array_except("q_tok", unknown), blanks))).withColumn("q_ref", F.when(F.col("q_ref").isNotNull(), "\u0001")).drop("unknown")
    return d.withColumn("profile", _digest(["q_tok", "q_ref", *PROFILE, *(["q_title"] if title else [])]))


def _own_references(asked: DataFrame, held: DataFrame) -> DataFrame:
    """part_id, i_same: entries that have a request's reference, or name it."""
    # references are in capitals and tokens in small letters: only numbers can be both
    refs = F.array_distinct(F.concat("i_refs", F.filter("tokens", lambda x: x.rlike("^[0-9]+$"))))
    named = held.select(F.explode(refs).alias("ref"), "i_same").distinct()
    return asked.where(F.col("q_ref").isNotNull()).select("part_id", "q_ref").join(named, F.col("q_ref") == F.col("ref")).select("part_id", "i_same").distinct()


def best_pairs(asked: DataFrame, held: DataFrame, limit: int, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY, title_similarity: bool = True) -> DataFrame:
    """``rank`` over all candidates of prepared and staged sides, with each kind of pair scored once.

    Requests that differ in their reference only are one *profile*, items that differ in
    their references only are one *kind*: their scores are those of a reference that no
    item has. Profiles rank kinds, and keep as many as the ``limit`` best entries of a
    request can need. A request takes its profile's entries but for those that have or
    name its own reference; these few are scored for the request itself. Requests with
    more than ``WIDE`` of them are scored against all their candidates.
    """
    clash = [c for c in held.columns if c in asked.columns]
    aside = lambda d: d.withColumnsRenamed({c: f"asked_{c}" for c in clash})
    # staged items are small as files and large as rows: they aren't for a broadcast. Pairs are few bytes and much work
    whole = lambda pairs, requests, items: dealt(pairs, "item_id").join(items.hint("merge"), "item_id").join(aside(requests), "part_id")
    scored = lambda pairs, requests, items: score(whole(pairs, requests, items), policy, title_similarity, texts=False)
    own = staged(_own_references(asked, held), "own_references")
    counts = own.groupBy("part_id").agg(F.count("*").alias("n"))
    wide = staged(counts.where(F.col("n") > WIDE).select("part_id"), "wide")
    most = limit + (counts.where(F.col("n") <= WIDE).agg(F.max("n").alias("n")).first().n or 0)

    requests = staged(_profiles(asked, held, title_similarity).join(wide, "part_id", "left_anti"), "profiled")
    profiles = staged(requests.drop("part_id").withColumnRenamed("profile", "part_id").dropDuplicates(["part_id"]), "profiles")
    kinds = held.withColumn("kind", _digest(KIND))
    first = Window.partitionBy("kind", "i_same").orderBy("item_id")
    entries = kinds.select("kind", "i_same", "item_id").withColumn("n", F.row_number().over(first)).where("n = 1")
    place = Window.partitionBy("kind").orderBy("item_id")
    entries = staged(entries.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most), "entries")
    # an entry may be of several kinds: then as many more kinds are kept
    spread = kinds.select("i_same", "kind").distinct().groupBy("i_same").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    heads = entries.where("n = 1").select(F.col("item_id").alias("_item"), "kind")
    heads = staged(held.join(heads.hint("merge"), F.col("item_id") == F.col("_item"), "left_semi").withColumn("i_refs", F.array().cast("array<string>")), "kinds")
    pairs = scored(candidates(profiles, heads), profiles, heads)
    order = [F.desc("score"), F.desc("provider_name"), F.desc("title"), F.asc("item_id")]
    top = pairs.withColumn("n", F.row_number().over(Window.partitionBy("part_id").orderBy(*order))).where(F.col("n") <= most * spread).drop("n", "i_same")
    of = entries.where("n = 1").select(F.col("item_id").alias("_head"), F.col("kind").alias("_kind")).join(entries.select("kind", F.col("item_id").alias("_item"), "i_same").hint("merge"), F.col("_kind") == F.col("kind"))
    top = top.join(of.hint("merge"), F.col("item_id") == F.col("_head")).select(F.col("part_id").alias("profile"), F.col("_item").alias("item_id"), "score", "match_type", "provider_name", "title", "i_same")
    once = top.withColumn("n", F.row_number().over(Window.partitionBy("profile", "i_same").orderBy(*order))).where("n = 1")
    once = staged(once.withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy(*order))).where(F.col("n") <= most).drop("n"), "profile_ranks")

    shared = requests.select("part_id", "profile", "prefs_max_options").join(once, "profile").join(own.select(F.col("part_id").alias("_p"), F.col("i_same").alias("_s")), (F.col("part_id") == F.col("_p")) & (F.col("i_same") == F.col("_s")), "left_anti")
    # an item of such an entry may have no key of the request
    few = own.join(wide, "part_id", "left_anti").join(held.select(F.col("i_same").alias("_s"), "item_id", _held_keys().alias("k")).hint("merge"), F.col("i_same") == F.col("_s"))
    few = few.join(asked.select(F.col("part_id").alias("_p"), _asked_keys().alias("q")), (F.col("part_id") == F.col("_p")) & F.arrays_overlap("k", "q")).select("part_id", "item_id")
    pool = shared.select(*RANKED).unionByName(scored(few, asked, held))
    if wide.head(1):
        by_themselves = asked.join(wide, "part_id", "left_semi")
        pool = pool.unionByName(scored(candidates(by_themselves, held), by_themselves, held))
    return rank(pool, limit)


def match(requests: DataFrame, items: DataFrame, limit: int = 5, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY, title_similarity: bool = True) -> DataFrame:
    """Ranked matches of all requests; texts about a pair are made for ranked ones only.

    The prepared sides are staged: candidates and scores read them, each its own columns.
    Pairs are scored for their ranks alone, each kind once (``best_pairs``); the ranked
    ones are scored once more for all that is said about them.
    """
    asked, held = staged(prepare_requests(dealt(requests, "part_id")), "asked"), staged(prepare_items(items), "held")
    best = staged(best_pairs(asked, held, limit, policy, title_similarity).select("part_id", "item_id", "rank"), "ranked")
    clash = [c for c in held.columns if c in asked.columns]
    pairs = best.join(held.hint("merge"), "item_id").join(asked.withColumnsRenamed({c: f"asked_{c}" for c in clash}), "part_id")
    return with_state(score(pairs, policy, title_similarity), policy)


def report(requests: DataFrame, matches: DataFrame, by: str = "quote_id") -> DataFrame:
    """Counts of each quote by the best match of its parts, and hits by provider (sorted map)."""
    best = matches.where(F.col("rank") == 1).select("part_id", "match_type", "provider_id")
    parts = requests.select(by, "part_id").join(best, "part_id", "left")
    is_ = lambda *k: F.count(F.when(F.col("match_type").isin(*k), 1))
    hits = parts.where(F.col("provider_id").isNotNull()).groupBy(by, "provider_id").agg(F.count("*").alias("n"))
    hits = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("provider_id", "n"))).alias("hits"))
    sums = parts.groupBy(by).agg(F.count("*").alias("parts_total"), F.count("match_type").alias("parts_with_matches"), is_("exact_reference").alias("exact_reference_matches"), is_("category_only", "vehicle_compatible").alias("partial_matches"))
    sums = sums.withColumn("manual_confirmation_only", F.col("parts_with_matches") - F.col("exact_reference_matches") - F.col("partial_matches"))
    return sums.join(hits, by, "left").withColumn("provider_hits", F.map_from_entries(F.coalesce("hits", F.array().cast("array<struct<provider_id:string,n:bigint>>")))).drop("hits")
