"""Customer preferences: scopes of a quote, records by scope, one bundle for each quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Types of records and the keys of their values.
LISTS = {
    "preferred_providers": (("preferred_provider", "provider_preference"), ("provider_id", "provider_ids", "providers")),
    "avoided_providers": (("avoided_provider", "provider_avoid"), ("provider_id", "provider_ids", "providers")),
    "preferred_brands": (("preferred_brand", "brand_preference"), ("brand", "brands")),
    "avoided_brands": (("avoided_brand", "brand_avoid"), ("brand", "brands")),
}
# End of the fixed values.


def scopes(subject: Column, commercial_name: Column, workshop: Column, brand: Column) -> Column:
    """Scopes of a quote in their order: global, insurer, workshops, vehicle brand."""
    one = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("scope_key"))
    some = lambda scope, key: F.when(key.isNotNull(), one(scope, key))
    blank = lambda x: F.nullif(t.normalize_ascii(x), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(one("global", F.lit(None).cast("string")), some("insurer", blank(t.insurer(subject))), some("workshop", blank(commercial_name)), some("workshop", blank(workshop)), some("vehicle_brand", blank(brand)))))


def values(raw: Column, keys: tuple[str, ...]) -> Column:
    """Normalised values of a JSON scalar, list or object (the given keys, each a scalar or a list)."""

    def listed(x: Column) -> Column:
        items = F.from_json(x, "array<string>")
        return F.when(x.startswith("["), items).otherwise(F.array(F.regexp_replace(x, '^"|"$', "")))

    raw = F.trim(raw)
    of = F.flatten(F.array_compact(F.array(*(listed(F.get_json_object(raw, f"$.{k}")) for k in keys))))
    found = F.when(raw.startswith("{"), of).otherwise(listed(raw))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), t.normalize_ascii), lambda v: v != "")


def scalar(raw: Column, key: str) -> Column:
    raw = F.trim(raw)
    return F.when(raw.startswith("{"), F.get_json_object(raw, f"$.{key}")).otherwise(F.regexp_replace(raw, '^"|"$', ""))


def records_of(quotes: DataFrame, preferences: DataFrame) -> DataFrame:
    """Active records of each quote with their place: scopes in order, then time of creation.

    ``quotes`` has quote_id and ``scopes``; ``preferences`` scope, scope_key,
    preference_type, value (JSON text), notes, active, created_at, pref_id.
    """
    asked = quotes.select("quote_id", F.posexplode("scopes").alias("scope_pos", "s")).select("quote_id", "scope_pos", F.col("s.scope").alias("q_scope"), F.col("s.scope_key").alias("q_key"))
    live = preferences.where(F.col("active"))
    met = asked.join(live, (F.col("scope") == F.col("q_scope")) & F.col("scope_key").eqNullSafe(F.col("q_key")))
    return met.select("quote_id", F.struct("scope_pos", "created_at", "pref_id").alias("place"), "scope", "scope_key", "preference_type", "value", "notes")


def fold(records: DataFrame) -> DataFrame:
    """One bundle for each quote: lists in order without repetition, scalars by the last valid record."""
    kind = t.normalize_ascii(F.col("preference_type"))
    d = records.withColumn("kind", kind)
    lists = {name: F.when(F.col("kind").isin(*kinds), values(F.col("value"), keys)) for name, (kinds, keys) in LISTS.items()}
    exact = F.when(F.col("kind") == "prefer_exact_reference", t.as_bool(scalar(F.col("value"), "enabled")))
    tolerance = F.when(F.col("kind") == "year_tolerance", F.greatest(F.lit(0), t.as_int(scalar(F.col("value"), "years"))))
    options = F.when(F.col("kind") == "max_options_per_part", F.greatest(F.lit(1), F.least(F.lit(5), t.as_int(scalar(F.col("value"), "count")))))
    # greatest() skips nulls; an unreadable number is no record
    number = lambda c, key: F.when(t.as_int(scalar(F.col("value"), key)).isNotNull(), c)
    d = d.select("quote_id", "place", "kind", t.present(F.col("notes"), False).alias("note"), F.struct(t.normalize_ascii(F.col("scope")).alias("scope"), F.nullif(t.normalize_ascii(F.col("scope_key")), F.lit("")).alias("scope_key")).alias("applied"), exact.alias("exact"), number(tolerance, "years").alias("tolerance"), number(options, "count").alias("options"), *(c.alias(n) for n, c in lists.items()))
    g = d.groupBy("quote_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "note", "applied", "exact", "tolerance", "options", *lists))).alias("r"))
    whole = lambda f: F.array_distinct(F.flatten(F.array_compact(F.transform("r", lambda x: x[f]))))
    each = lambda f: F.array_distinct(F.array_compact(F.transform("r", lambda x: x[f])))
    last = lambda f: F.try_element_at(F.array_compact(F.transform("r", lambda x: x[f])), F.lit(-1))
    return g.select(
        "quote_id",
        *(whole(n).alias(n) for n in lists),
        F.coalesce(last("exact"), F.lit(False)).alias("prefer_exact_reference"),
        F.coalesce(last("tolerance"), F.lit(0)).alias("year_tolerance"),
        last("options").alias("max_options"),
        each("note").alias("notes"),
        each("applied").alias("applied_scopes"),
        F.filter(each("kind"), lambda k: k != "").alias("applied_preferences"),
    )


def with_preferences(requests: DataFrame, bundles: DataFrame) -> DataFrame:
    """Requests with their quote's bundle as the column ``prefs``."""
    fields = ["preferred_providers", "avoided_providers", "preferred_brands", "avoided_brands", "prefer_exact_reference", "year_tolerance", "max_options"]
    return requests.join(bundles.select("quote_id", F.struct(*fields).alias("prefs")), "quote_id", "left")
