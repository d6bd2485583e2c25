"""Quote documents as rows: compaction, normalised tables, status, upserts and replacement.

Upserts take the latest row of each key over the stored and the new rows; without a
transactional table format the result is written aside and then takes the place of
the table. Keys are hashes of natural keys, so a repeated run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# Fields of stored documents, in order.
SPEC_FIELDS = ("provider_id", "display_name", "snapshot_date")
MATCH_FIELDS = (
    "provider_id", "provider_name", "score_percent", "match_type", "detail_url", "product_name", "reference", "sku", "brand", "category_name", "subcategory_name", "risk_flags",
    "compatibility_warnings", "preference_notes", "compatibility_state", "compatibility_summary", "operational_note",
)
SUMMARY_FIELDS = ("parts_total", "parts_with_matches", "exact_reference_matches", "provider_hits")
PART_FIELDS = ("part_name", "requested_reference", "quantity", "best_score_percent", "best_match_type", "best_provider_id")
QUOTE_PART_FIELDS = ("name", "reference", "quantity", "unit_gross_price", "delivery_days", "discount", "quality", "total_value", "reference_validation_text", "raw_status")
QUOTE_FIELDS = (
    "load_status", "retries_used", "aviso_id", "fecha_aviso", "marca", "linea", "version", "ano", "placa", "vin", "taller_entrega", "nombre_comercial", "nit", "ciudad", "direccion", "telefono", "email",
    "repuestos_count", "total_cotizacion", "repuestos_cotizados",
)
OPTION_FIELDS = (
    "rank", "provider_id", "provider_name", "score_percent", "match_type", "product_name", "detail_url", "reference", "brand", "category_name", "compatibility_state", "compatibility_summary",
    "compatibility_warnings", "preference_notes", "risk_flags", "agentic_comment",
)
REVIEW_SUMMARY_FIELDS = ("parts_reviewed", "parts_with_agentic_matches", "provider_hits")
REVIEW_PART_FIELDS = ("part_name", "requested_reference", "top_provider_id", "top_score_percent", "review_status", "risk_notes", "preference_notes")
SOURCE_FIELDS = ("gmail_id", "message_id", "internal_date_ms", "received_at", "sender", "subject")
STORED_MATCHES = 3
# End of the fixed values.

#: A shape: names of fields, or (name, shape of the field, number of entries kept or None).
PART = (*PART_FIELDS, ("matches", MATCH_FIELDS, STORED_MATCHES))
MATCHING = ("generated_at", ("summary", SUMMARY_FIELDS, None), ("provider_specs", SPEC_FIELDS, None), "preferences", ("parts", PART, None))
QUOTE = (*QUOTE_FIELDS, ("parts", QUOTE_PART_FIELDS, None), "warnings")
REVIEW_PART = (*REVIEW_PART_FIELDS, ("selected_matches", OPTION_FIELDS, None))
REVIEW = ("generated_at", "review_mode", ("summary", REVIEW_SUMMARY_FIELDS, None), ("parts", REVIEW_PART, None))
PAYLOAD = ("generated_at", "quote_key", ("source", SOURCE_FIELDS, None), "quote_url_masked", ("orbika", QUOTE, None), ("supplier_matching", MATCHING, None), ("agentic_supplier_matching", REVIEW, None))


def project(x: Column, kind: T.DataType, shape: tuple, keep: int | None = None) -> Column:
    """A value cut to a shape, at every depth: of structs the fields that both have, of arrays each entry (the first ``keep``)."""
    if isinstance(kind, T.ArrayType):
        entries = F.slice(x, 1, keep) if keep else x
        return F.transform(entries, lambda v: project(v, kind.elementType, shape))
    fields = []
    for f in shape:
        name, inner, most = f if isinstance(f, tuple) else (f, None, None)
        if name in kind.names:
            fields.append((project(x.getField(name), kind[name].dataType, inner, most) if inner else x.getField(name)).alias(name))
    return F.when(x.isNotNull(), F.struct(*fields))


def stored(df: DataFrame, column: str, shape: tuple = PAYLOAD) -> Column:
    """A column as the JSON text that is stored: cut to its shape, then compacted."""
    cut = project(F.col(column), df.schema[column].dataType, shape)
    return F.to_json(compact(cut, df.select(cut.alias("x")).schema["x"].dataType))


def compact(x: Column, kind: T.DataType) -> Column:
    """A value without nulls, blank texts and empty lists or objects, at every depth; 0 and false stay.

    The value keeps its type: what goes becomes null, and ``to_json`` leaves nulls out.
    """
    if isinstance(kind, T.StringType):
        return F.nullif(F.trim(x), F.lit(""))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(x, lambda v: compact(v, kind.elementType)), lambda v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        made = [compact(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        some = F.coalesce(*(F.when(compact(x.getField(f.name), f.dataType).isNotNull(), True) for f in kind.fields))
        return F.when(some, F.struct(*made))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(x, lambda _, v: compact(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return x


def compact_json(df: DataFrame, column: str) -> Column:
    return F.to_json(compact(F.col(column), df.schema[column].dataType))


def key(*parts: Column) -> Column:
    """A surrogate key from a natural one."""
    return F.sha2(F.to_json(F.struct(*(p.cast("string").alias(f"k{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}).cast("binary"), 256)


def email_key(gmail_id: Column, message_id: Column, quote_key: Column) -> Column:
    """Mail id, else message id, else quote key: several quotes may share one mail."""
    return t.first_text(gmail_id, message_id, quote_key)


def quote_status(manual_only: Column, with_matches: Column, has_matching: Column, failed: Column | None = None) -> Column:
    """needs_manual_review, ready_for_review or extracted (or failed)."""
    out = F.when(failed, "failed") if failed is not None else F
    return out.when(F.coalesce(manual_only, F.lit(0)) > 0, "needs_manual_review").when(has_matching & (F.coalesce(with_matches, F.lit(0)) > 0), "ready_for_review").otherwise("extracted")


def part_status(matches: Column, reviewed: Column, raw_status: Column) -> Column:
    """matched, needs_review, no_match or requested: by reviewed options, matches, and whether matching ran."""
    return F.when(F.coalesce(reviewed, F.lit(0)) > 0, "matched").when(matches > 0, "needs_review").when(matches == 0, "no_match").otherwise("requested")


def allowed(x: Column, values: tuple[str, ...], default: str) -> Column:
    """A value of a checked list, else the default."""
    return F.when(x.isin(*values), x).otherwise(default)


def percent(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(t.as_int(x), F.lit(0))))


def match_rows(parts: DataFrame) -> DataFrame:
    """Stored match rows of parts (part_key, matches): ranks, defaults and bounds as the tables need them.

    A rank that is missing or 0 is the position. Columns win over nothing: a value
    that is null in the row stays what the document says.
    """
    d = parts.select("part_key", F.posexplode("matches").alias("pos", "m"))
    kind = parts.schema["matches"].dataType.elementType
    has = lambda f: F.col("m").getField(f) if f in kind.names else F.lit(None).cast("string")
    return d.select(
        "part_key",
        F.coalesce(F.nullif(t.as_int(has("rank")), F.lit(0)), F.col("pos") + 1).alias("rank"),
        F.coalesce(t.first_text(has("provider_id")), F.lit("unknown")).alias("provider_id"),
        F.coalesce(t.first_text(has("product_name")), F.lit("Unknown product")).alias("product_name"),
        percent(has("score_percent")).alias("score_percent"),
        t.as_decimal(has("price")).alias("price"),
        F.coalesce(t.first_text(has("currency")), F.lit("COP")).alias("currency"),
        *(t.first_text(has(f)).alias(f) for f in ("provider_name", "match_type", "reference", "sku", "brand", "detail_url")),
        F.to_json("m").alias("raw"),
    )


def related_parts(parts: DataFrame, others: DataFrame, name: str = "name") -> DataFrame:
    """Each part with its counterpart: the one in its place if the names agree or it has none, else the first of its name.

    Both have quote_id, pos and ``name``; the counterpart's place is ``other_pos``, null if there is none.
    """
    n = t.normalize_name(F.col(name))
    a = parts.withColumn("_n", n)
    b = others.select(F.col("quote_id").alias("_q"), F.col("pos").alias("other_pos"), n.alias("_m"))
    same_place = b.select("_q", F.col("other_pos").alias("_p"))
    by_name = b.where(F.col("_m").isNotNull()).groupBy("_q", "_m").agg(F.min("other_pos").alias("_first"))
    d = a.join(same_place, (F.col("quote_id") == F.col("_q")) & (F.col("pos") == F.col("_p")), "left").drop("_q")
    d = d.join(by_name, (F.col("quote_id") == F.col("_q")) & (F.col("_n") == F.col("_m")), "left").drop("_q", "_m", "_n")
    return d.withColumn("other_pos", F.coalesce("_p", "_first")).drop("_p", "_first")


def review_matches(reviews: DataFrame, matches: DataFrame) -> DataFrame:
    """Reviews with the key of their match: by (rank, provider, product, reference, url), else the first of (provider, product) by rank and key."""
    exact_keys = ["rank", "provider_id", "product_name", "reference", "detail_url"]
    m = matches.select(F.col("part_key").alias("_part"), F.col("match_key").alias("_exact"), *(F.col(c).alias(f"_{c}") for c in exact_keys))
    on = F.col("part_key") == F.col("_part")
    for c in exact_keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    first = matches.groupBy(F.col("part_key").alias("_part2"), F.col("provider_id").alias("_p2"), F.col("product_name").alias("_n2")).agg(F.min_by("match_key", F.struct("rank", "match_key")).alias("_first"))
    d = reviews.join(m, on, "left").drop("_part", *(f"_{c}" for c in exact_keys))
    d = d.join(first, (F.col("part_key") == F.col("_part2")) & (F.col("provider_id") == F.col("_p2")) & (F.col("product_name") == F.col("_n2")), "left")
    return d.withColumn("match_key", F.coalesce("_exact", "_first")).drop("_exact", "_first", "_part2", "_p2", "_n2")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Latest row of each key: new rows over stored ones, among new ones the greatest ``version``.

    One aggregation with partial sums; a key with many versions sends one row for each task.
    """
    cols = new.columns
    every = stored.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    return every.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("_new", *version)).alias("_r")).select("_r.*")


def replace_children(stored: DataFrame, new: DataFrame, parents: DataFrame, by: str) -> DataFrame:
    """Rows of all parents in ``parents`` are deleted and those of ``new`` inserted."""
    return stored.join(parents.select(by).distinct(), by, "left_anti").unionByName(new)


def require_keys(stored: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """The rows of the asked keys; a key that isn't there is an error."""
    missing = [r[0] for r in asked.join(stored, by, "left_anti").select(by).limit(5).collect()]
    if missing:
        raise KeyError(f"no rows for {', '.join(map(str, missing))}")
    return stored.join(asked.select(by).distinct(), by, "left_semi")


def generated_names(parts: DataFrame) -> DataFrame:
    """Parts with a name: their own, else one from their place (counted from 1)."""
    return parts.withColumn("name", F.coalesce(t.first_text(F.col("name")), F.concat(F.lit("Repuesto "), (F.col("pos") + 1).cast("string"))))


def ordered_matches(matches: DataFrame, by: str = "part_key") -> DataFrame:
    """Matches as a list for each part: by rank (nulls last), then score descending."""
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last("rank"), F.desc("score_percent"), "match_key")
    d = matches.withColumn("place", F.row_number().over(order))
    return d.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "match_key", "provider_id", "score_percent"))).alias("matches"))


def summaries(rows: DataFrame) -> DataFrame:
    """Rows of quotes as a list shows them: fallbacks for missing times, 0 for missing counts."""
    count = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    when = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        "quote_key", t.text("path").alias("path"), when(F.coalesce("processed_at", "updated_at")).alias("generated_at"), when(F.col("received_at")).alias("received_at"), "subject", "load_status",
        *(count(c) for c in ("parts_total", "parts_with_matches", "exact_reference_matches", "parts_with_options")),
    )


def match_payload(matches: DataFrame, columns: list[str], raw: str = "raw") -> Column:
    """The raw JSON of a match (a flat object) under the table's columns, which win even when they are null."""
    own = F.from_json(F.col(raw), "map<string,string>")
    over = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    return F.map_concat(F.map_filter(F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~k.isin(*columns)), over)


def numbered(x: Column) -> Column:
    """A decimal as text: whole numbers without a point, others without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def touched(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows with the time of their change."""
    return df.withColumn("updated_at", F.current_timestamp() if now is None else now)


def rerun(stored: DataFrame, keys: DataFrame, by: str, process) -> DataFrame:
    """Stored rows of which the asked ones are processed again; a key that isn't there is an error."""
    again = process(require_keys(stored, keys, by))
    return replace_children(stored, again.select(*stored.columns), keys, by)
