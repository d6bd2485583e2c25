"""Second review of ranked matches: stricter score, one option for each provider, comments.

Columns of candidates are those of ``matching.match``; ``evidence`` (verdict,
summary) is optional. A rejected kind of part sets the score to 0 and later bonuses
still add to it; a rejected side or position does so after those bonuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as t
from .matching import accepts, computed, part_signal

OPTIONS = 3
ACCEPT, ACCEPT_CATEGORY_ONLY = 35, 18


def adjusted(c: DataFrame, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY) -> DataFrame:
    """Candidates with ``adjusted_score`` (0 to 100) and the notes and flags that review adds."""
    p = lambda name, empty: F.coalesce(F.col(f"prefs_{name}"), empty)
    none = F.array().cast("array<string>")
    shown = [F.col(x) for x in ("title", "brand", "category_name", "subcategory_name", "reference", "sku")]
    own = t.tokens(*shown)
    asked = t.tokens(F.col("part_name"), F.col("asked_reference"))
    want = part_signal(F.col("part_name"), F.col("asked_reference"))
    got = part_signal(F.col("title"), F.col("category_name"), F.col("subcategory_name"), F.col("reference"))
    d = computed(c, r_own=own, r_want=want, r_got=got)
    shared = lambda x: F.size(F.array_intersect(x, F.col("r_own")))
    up = lambda n, each, most: F.least(n * each, F.lit(most))
    both = F.col("r_want").isNotNull() & F.col("r_got").isNotNull()
    fit = F.when(F.col("r_want") == F.col("r_got"), 8).otherwise(4)
    value = F.when(both & ~accepts(F.col("r_want"), F.col("r_got")), 0).when(both, F.col("score") + fit).otherwise(F.col("score"))
    value = value + up(shared(F.col("q_brand")), 8, 16) + up(shared(F.col("q_line")), 7, 14) + up(shared(F.col("q_version")), 4, 8)
    category_only = F.col("provider_id").isin(*policy.category_only) if policy.category_only else F.lit(False)
    value = value - F.when((shared(asked) == 0) & ~category_only, 12).otherwise(0)
    flag = lambda *f: F.arrays_overlap("risk_flags", t.words(f))
    placed = flag("side_mismatch", "position_mismatch")
    value = value * F.when(placed, 0).otherwise(1) - F.when(~placed & flag("year_mismatch"), 18).otherwise(0)
    provider, brand = t.text("provider_id"), t.normalize(F.col("brand"))
    listed = lambda x, name: (x != "") & F.array_contains(p(name, none), x)
    liked, avoided = listed(provider, "preferred_providers"), listed(provider, "avoided_providers")
    b_liked, b_avoided = listed(brand, "preferred_brands"), listed(brand, "avoided_brands")
    exact_wanted = p("prefer_exact_reference", F.lit(False)) & (t.text("asked_reference") != "")
    exact = F.col("match_type") == "exact_reference"
    pick = lambda c, n: F.when(c, n).otherwise(0)
    value = value + pick(liked, 10) - pick(avoided, 18) + pick(b_liked, 6) - pick(b_avoided, 10) + pick(exact_wanted & exact, 8) - pick(exact_wanted & ~exact, 6)
    value = value - pick((F.coalesce(F.col("r_want"), F.lit("")) == "wiper_kit") & ~t.normalize(F.col("title")).contains("kit"), 18)
    verdict = F.col("evidence.verdict") if "evidence" in c.columns else F.lit(None).cast("string")
    value = value + F.when(verdict == "reference_supported", 10).when(verdict == "vehicle_supported", 6).when(verdict == "generic_support", 2).when(verdict == "year_scope_warning", -10).otherwise(0)
    says = [
        F.when(liked, F.concat(provider, F.lit(" tiene preferencia activa"))),
        F.when(avoided, F.concat(provider, F.lit(" tiene alerta para evitar"))),
        F.when(b_liked, F.concat(F.lit("marca "), t.text("brand"), F.lit(" priorizada"))),
        F.when(b_avoided, F.concat(F.lit("marca "), t.text("brand"), F.lit(" marcada para evitar"))),
        F.when(exact_wanted & exact, F.lit("preferencia por referencia exacta")),
    ]
    warned = F.array_compact(F.array(F.when(verdict == "year_scope_warning", F.lit("rag_year_scope_warning"))))
    return (
        computed(d, adjusted_score=F.greatest(F.lit(0), F.least(F.lit(100), value)).cast("int"))
        .withColumn("preference_notes", F.array_distinct(F.concat("preference_notes", F.array_compact(F.array(*says)))))
        .withColumn("risk_flags", F.array_distinct(F.concat("risk_flags", warned)))
        .drop("r_own", "r_want", "r_got")
    )


def select_options(reviewed: DataFrame, limit: int = OPTIONS, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY, ordered_by: list[Column] | None = None) -> DataFrame:
    """Candidates over their threshold, the best of each provider, at most three; ``option`` counts from 1."""
    least = F.when(F.col("provider_id").isin(*policy.category_only), ACCEPT_CATEGORY_ONLY).otherwise(ACCEPT) if policy.category_only else F.lit(ACCEPT)
    order = ordered_by or [F.desc("adjusted_score"), F.desc(F.col("match_type") == "exact_reference"), F.desc("provider_name"), F.desc("title"), F.asc("item_id")]
    by_provider = Window.partitionBy("part_id", t.text("provider_id")).orderBy(*order)
    first = reviewed.where(F.col("adjusted_score") >= least).withColumn("_n", F.row_number().over(by_provider)).where(F.col("_n") == 1)
    best = Window.partitionBy("part_id").orderBy(*order)
    return first.withColumn("option", F.row_number().over(best)).where(F.col("option") <= min(limit, OPTIONS)).drop("_n")


def comments(options: DataFrame, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY) -> DataFrame:
    """Options with their comment and its source."""
    has = "evidence" in options.columns
    verdict, summary = (F.col("evidence.verdict"), F.col("evidence.summary")) if has else (F.lit(None).cast("string"), F.lit(None).cast("string"))
    flag = lambda *f: F.arrays_overlap("risk_flags", t.words(f))
    category_only = F.col("provider_id").isin(*policy.category_only) if policy.category_only else F.lit(False)
    said = (
        F.when(F.col("match_type") == "exact_reference", "con referencia exacta.")
        .when((verdict == "reference_supported") & summary.isNotNull(), "con respaldo RAG por referencia o aplicacion.")
        .when((verdict == "vehicle_supported") & summary.isNotNull(), "con respaldo RAG por aplicacion del vehiculo.")
        .when(verdict == "year_scope_warning", "con alerta RAG; validar anos segun catalogo tecnico.")
        .when(verdict == "generic_support", "con apoyo RAG parcial; validar referencia.")
        .when(flag("year_mismatch"), "heuristica; validar ano o modelo.")
        .when(flag("color_mismatch", "finish_mismatch"), "heuristica; validar color o acabado.")
        .when((F.size("preference_notes") > 0) & (F.col("option") == 1), "heuristica alineada con preferencia.")
        .when(F.col("option") == 1, "heuristica; mejor opcion.")
        .when(category_only, "heuristica; validar manualmente.")
        .when(t.normalize(F.col("title")).contains("kit"), "heuristica; alternativa tipo kit.")
        .otherwise("heuristica; alternativa util.")
    )
    name = F.coalesce(F.nullif(F.col("provider_name"), F.lit("")), F.lit("Proveedor"))
    return options.withColumn("comment", F.concat(name, F.lit(": revision agentica "), said)).withColumn("explanation_source", F.when(summary.isNotNull(), "rag").otherwise("agentic"))


def review(candidates: DataFrame, reviewer: Callable[[DataFrame], DataFrame] | None = None, limit: int = OPTIONS, policy: lx.ProviderPolicy = lx.DEFAULT_POLICY) -> DataFrame:
    """Prepare, review and finish: options of each part. ``reviewer`` may choose and order rows (part_id, choice) itself."""
    if reviewer is None:
        return comments(select_options(adjusted(candidates, policy), limit, policy), policy)
    chosen = reviewer(candidates)
    chosen = chosen if "adjusted_score" in chosen.columns else chosen.withColumn("adjusted_score", F.col("score"))
    return comments(select_options(chosen, limit, policy, [F.asc("choice"), F.asc("item_id")]), policy)


def chosen_indexes(candidates: DataFrame, answers: DataFrame, limit: int = OPTIONS) -> DataFrame:
    """Candidates that a model's answer names: answers have part_id and ``indexes`` (positions from 0, in order).

    Positions out of range are ignored, as are those beyond ``limit``.
    """
    picks = answers.select(F.col("part_id").alias("_part"), F.posexplode(F.slice("indexes", 1, limit)).alias("choice", "_at"))
    return candidates.join(picks, (F.col("part_id") == F.col("_part")) & (F.col("rank") == F.col("_at") + 1)).drop("_part", "_at")


def part_summary(options: DataFrame) -> DataFrame:
    """One row for each reviewed part: its top option and the first two distinct notes of its options."""
    row = F.struct("option", "provider_id", "adjusted_score", "match_type", F.slice("preference_notes", 1, 2).alias("notes"))
    g = options.groupBy("part_id").agg(F.array_sort(F.collect_list(row)).alias("o"))
    top = F.element_at("o", 1)
    return g.select("part_id", F.size("o").alias("options"), top["provider_id"].alias("top_provider"), top["adjusted_score"].alias("top_score"), top["match_type"].alias("top_match_type"), F.slice(F.array_distinct(F.flatten(F.transform("o", lambda x: x["notes"]))), 1, 2).alias("notes"))


def option_fields(options: DataFrame) -> DataFrame:
    """Reviewed options as they are put out: rank, reviewed score, states and notes, evidence where there is some."""
    has = "evidence" in options.columns
    rag = lambda f: F.col(f"evidence.{f}") if has else F.lit(None).cast("string")
    out = {
        "rank": F.col("option"), "provider_id": F.col("provider_id"), "provider_name": F.col("provider_name"), "score_percent": F.col("adjusted_score"), "match_type": F.col("match_type"), "product_name": F.col("title"), "detail_url": F.col("detail_url"),
        "reference": F.col("reference"), "sku": F.col("sku"), "brand": F.col("brand"), "category_name": F.col("category_name"), "subcategory_name": F.col("subcategory_name"), "requires_manual_confirmation": F.coalesce(F.col("manual"), F.lit(False)),
        "compatibility_state": F.col("compatibility_state"), "compatibility_summary": F.col("compatibility_summary"), "compatibility_warnings": F.col("warnings"), "agentic_comment": F.col("comment"), "explanation_source": F.col("explanation_source"),
        "risk_flags": F.col("risk_flags"), "preference_notes": F.col("preference_notes"), "rag_verdict": rag("verdict"), "rag_summary": rag("summary"),
    }
    return options.select("part_id", *(c.alias(n) for n, c in out.items()))
