"""Catalog snapshots: the latest and the one before a date, first and best of equal records, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def latest(snapshots: DataFrame, by: str = "provider_id", at: str = "snapshot", value: str = "path") -> DataFrame:
    """The value of the lexicographically greatest snapshot of each provider ("2026-06-09-full" follows "2026-06-09")."""
    return snapshots.groupBy(by).agg(F.max(at).alias(at), F.max_by(value, F.struct(at, value)).alias(value))


def previous(snapshots: DataFrame, date: Column, by: str = "provider_id", at: str = "snapshot", value: str = "path") -> DataFrame:
    """The greatest snapshot strictly before a date."""
    return latest(snapshots.where(F.col(at) < date), by, at, value)


def dedupe_best(records: DataFrame, key: Column, tokens: Column, ordinal: str) -> DataFrame:
    """Of records with one key the one with most tokens, the first on ties; ``first_seen`` gives the order of keys.

    Partial aggregation keeps one record for each key and task: large groups don't shuffle.
    """
    whole = F.struct(*records.columns)
    g = records.groupBy(key.alias("record_key")).agg(F.max_by(whole, F.struct(F.size(tokens), -F.col(ordinal))).alias("r"), F.min(ordinal).alias("first_seen"))
    return g.select("record_key", "first_seen", "r.*")


def first_of(records: DataFrame, keys: list, ordinal: str) -> DataFrame:
    """The first record of each key."""
    cols = records.columns
    return records.groupBy(*keys).agg(F.min_by(F.struct(*cols), ordinal).alias("_r")).select("_r.*")


def record_key(provider: Column, reference: Column, sku: Column, code: Column, url: Column, name: Column) -> Column:
    """What identifies a record between snapshots: a code where there is one, else its address, else its name."""
    code_of = F.coalesce(t.normalize_reference(reference), t.normalize_reference(sku), t.normalize_reference(code))
    return F.concat_ws("|", t.text(provider), F.coalesce(code_of, t.present(url, False), t.normalize(name)))


def diff(current: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the fields that changed; equal records give no row.

    A null-safe full outer join: a value that appears or goes is a change. Both sides
    have each key once.
    """
    a = current.select(F.col(key).alias("_a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = before.select(F.col(key).alias("_b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    d = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return d.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("fields")).where(F.col("change").isNotNull())


def set_differences(current: DataFrame, before: DataFrame, kind: str, key: str) -> DataFrame:
    """kind, change, key for keys of several kinds that came or went."""
    a, b = current.select(kind, key).distinct(), before.select(kind, key).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("added")).unionByName(b.exceptAll(a).withColumn("change", F.lit("removed")))


def summary(differences: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return differences.agg(count("added"), count("removed"), count("changed"))


def first_new_pages(pages: DataFrame, page: str, url: str) -> DataFrame:
    """Records of crawled pages before the first page without a new address, each address once."""
    first = pages.groupBy(url).agg(F.min(page).alias("first_page"))
    new = first.groupBy(F.col("first_page").alias("p")).agg(F.count("*").alias("new"))
    empty = pages.select(F.col(page).alias("p")).distinct().join(new, "p", "left").where(F.col("new").isNull()).agg(F.min("p").alias("stop"))
    kept = first.join(F.broadcast(empty)).where(F.col("stop").isNull() | (F.col("first_page") < F.col("stop")))
    return pages.join(kept.select(F.col(url).alias("_u"), "first_page"), (F.col(url) == F.col("_u")) & (F.col(page) == F.col("first_page"))).drop("_u", "first_page")


def merged_lookup(first: Column, other: Column) -> Column:
    """Two maps in one; on clashing keys the first map wins."""
    return F.map_concat(first, F.map_filter(other, lambda k, _: ~F.map_contains_key(first, k)))


def deepest_category(paths: Column) -> Column:
    """The path with most parts, the first of equals."""
    cut = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    ranked = F.transform(paths, lambda p, i: F.struct(F.size(cut(p)).alias("depth"), (-i).alias("pos"), p.alias("path")))
    return F.array_max(ranked)["path"]


def ordered_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
