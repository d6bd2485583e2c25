"""Ingest of documents as a unit: unchanged ones are skipped, changed ones replace their chunks, a broken file stays alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs, retrieval, store


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    #: One row: imported, updated, skipped, failed, warnings, warning_messages.
    counters: DataFrame


def ingest(files: DataFrame, documents: DataFrame, chunks: DataFrame, max_chars: int = retrieval.MAX_CHARS, overlap: int = retrieval.OVERLAP, dry_run: bool = False) -> Ingested:
    """``files`` has path, sha256, title, pages (array of page and text) and error; ``documents`` path, sha256 and title.

    A file whose digest is stored is skipped; one with an error, or without text, is
    counted as failed and changes nothing. A dry run counts and stores nothing. Files
    should be a staged table: they are read by each part of the result.
    """
    known = documents.select(F.col("path").alias("_p"), F.col("sha256").alias("_s"))
    some = F.size(F.filter(F.coalesce("pages", F.from_json(F.lit("[]"), "array<struct<page:int,text:string>>")), lambda p: F.coalesce(F.trim(p["text"]), F.lit("")) != "")) > 0
    outcome = F.when(F.col("error").isNotNull() | ~some, "failed").when(F.col("_p").isNull(), "imported").when(F.col("_s") == F.col("sha256"), "skipped").otherwise("updated")
    d = files.join(known, F.col("path") == F.col("_p"), "left").withColumn("outcome", outcome).drop("_p", "_s")
    warning = F.when(F.col("outcome") == "failed", F.coalesce("error", F.lit("no text")))
    counters = jobs.load_counters(d.select(F.col("path").alias("source"), "outcome", warning.alias("warning")))
    if dry_run:
        return Ingested(documents, chunks, counters)
    new = d.where(F.col("outcome").isin("imported", "updated"))
    pages = new.select("path", F.inline("pages")).where(F.trim("text") != "")
    made = retrieval.chunk(pages, max_chars, overlap, document="path").withColumnRenamed("document_id", "path")
    stored = store.upsert(documents, new.select(*documents.columns), ["path"], ["sha256"])
    return Ingested(stored, store.replace_children(chunks, made.select(*chunks.columns), new.select("path"), "path"), counters)
