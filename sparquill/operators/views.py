"""Relational views: lists, details, dashboards, daily reports, queue filters, supervision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def quote_list(quotes: DataFrame, parts: DataFrame, matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counts of each quote over parts, matches and reviews.

    Three named counts of exact matches exist: ``exact_match_rows`` counts joined
    rows, so each review of a part counts its matches again (the list's figure);
    ``exact_matches`` counts match rows. Each child is counted before it is joined,
    which gives the multiplied figure without multiplied rows.
    """
    m = matches.groupBy("part_key").agg(F.count("*").alias("n_matches"), F.count(F.when(F.col("match_type") == "exact_reference", 1)).alias("n_exact"))
    r = reviews.groupBy("part_key").agg(F.count("*").alias("n_reviews"))
    p = parts.join(m, "part_key", "left").join(r, "part_key", "left")
    times = F.greatest(F.coalesce("n_reviews", F.lit(0)), F.lit(1))
    g = p.groupBy("quote_id").agg(
        F.count("*").alias("parts_total"),
        F.count(F.when(F.col("n_matches") > 0, 1)).alias("parts_with_matches"),
        F.coalesce(F.sum(F.coalesce("n_exact", F.lit(0)) * times), F.lit(0)).alias("exact_match_rows"),
        F.coalesce(F.sum("n_exact"), F.lit(0)).alias("exact_matches"),
        F.count("n_reviews").alias("reviewed_parts"),
    )
    return quotes.join(g, "quote_id", "left").na.fill(0, ["parts_total", "parts_with_matches", "exact_match_rows", "exact_matches", "reviewed_parts"])


def newest_first(df: DataFrame, *times: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(F.coalesce(*times)), "quote_id")


def status_counts(df: DataFrame, column: str, values: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row with a count for each named set of values."""
    return df.agg(F.count("*").alias("total"), *(F.count(F.when(F.col(column).isin(*v), 1)).alias(name) for name, v in values.items()))


def provider_hits(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows for each provider over all matches, the most first, ties by name."""
    g = matches.groupBy("provider_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "provider_id")
    return g.limit(limit) if limit else g


def summed_hits(quotes: DataFrame, column: str = "provider_hits") -> DataFrame:
    """Hits by best match: the maps of all quotes, summed."""
    return quotes.select(F.explode(column).alias("provider_id", "n")).groupBy("provider_id").agg(F.sum("n").alias("hits"))


def queue(quotes: DataFrame, show: str = "all", search: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Quotes of a queue whose joined columns contain a text."""
    tests = {
        "all": F.lit(True),
        "needs_attention": F.col("status").isin("needs_manual_review", "failed"),
        "with_agentic": F.col("reviewed_parts") > 0,
        "loaded": F.col("load_status") == "loaded",
        "failed": F.col("status") == "failed",
    }
    found = quotes.where(tests[show])
    needle = search.strip().lower()
    return found.where(F.lower(F.concat_ws(" ", *columns)).contains(needle)) if needle else found


def daily(quotes: DataFrame, date: Column, fields: list[str], specs: Column | None = None) -> DataFrame:
    """A report for each day: number of quotes, their summaries in order, and the last provider spec seen."""
    row = F.struct("quote_id", *fields)
    more = [F.max_by(specs, F.col("quote_id")).alias("provider_spec")] if specs is not None else []
    return quotes.groupBy(date.alias("day")).agg(F.count("*").alias("quotes"), F.array_sort(F.collect_list(row)).alias("summaries"), *more)


def latest_by(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The row of each group with the greatest values of ``order``; partial aggregation sends one row for each group and task."""
    return df.groupBy(by).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def detail(quote: DataFrame, parts: DataFrame, matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Quotes with parts, each with its matches by rank and its newest review.

    A column that is null keeps what the raw document says.
    """
    order = Window.partitionBy("part_key").orderBy(F.asc_nulls_last("rank"), F.desc("score_percent"), "match_key")
    m = matches.withColumn("place", F.row_number().over(order)).groupBy("part_key").agg(F.array_sort(F.collect_list(F.struct("place", "match_key", "provider_id", "score_percent", "match_type"))).alias("matches"))
    newest = reviews.groupBy("part_key").agg(F.max_by(F.struct("review_key", "comment"), F.struct("created_at", "review_key")).alias("review"))
    p = parts.join(m, "part_key", "left").join(newest, "part_key", "left")
    g = p.groupBy("quote_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part_key", "name", "matches", "review"))).alias("parts"))
    return quote.join(g, "quote_id", "left")


def supervision(state: DataFrame, now: Column, stale_seconds: int = 900) -> DataFrame:
    """The first active runner, failures, and whether its state is stale; the stage is read from the current step."""
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return state.agg(
        F.min_by(F.struct("runner", F.col("current.stage").alias("stage")), F.when(F.col("status") == "active", F.col("started_at"))).alias("active"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.coalesce(F.max(F.when(F.col("status") == "active", age > stale_seconds)), F.lit(False)).alias("stale"),
    )


def max_page(html: Column) -> Column:
    """The greatest page number that a page links to, else 1."""
    linked = F.transform(F.regexp_extract_all(t.text(html), F.lit(r"(?:[?&]page=|/page/)([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int"))
    shown = F.transform(F.regexp_extract_all(t.text(html), F.lit(r'class="[^"]*page-numbers[^"]*"[^>]*>\s*([0-9]+)'), F.lit(1)), lambda x: x.try_cast("int"))
    return F.coalesce(F.array_max(linked), F.array_max(shown), F.lit(1))


def last_events(events: DataFrame, by: str, keep: int = 500, replay: int = 50) -> DataFrame:
    """The newest events of each channel: ``keep`` are stored, the last ``replay`` are sent to a new listener."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("event_id"))
    d = events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)
    return d.withColumn("replayed", F.col("age") <= replay)


def sse(event: Column, data: Column) -> Column:
    """The wire form of an event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
