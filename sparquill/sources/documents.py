"""Landed files as tables: JSON documents, file listings, snapshots, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object for each file, with ``path``; a byte order mark is ignored.

    Files that aren't an object have nulls and their text in ``_corrupt``; nothing is
    inferred, so a file with other fields can't change types.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", F.decode("content", "UTF-8").alias("raw"))
    raw = raw.withColumn("raw", F.regexp_replace("raw", "^﻿", ""))
    parsed = raw.withColumn("doc", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))
    bad = ~F.col("raw").rlike(r"(?s)^\s*\{.*\}\s*$") | F.try_parse_json("raw").isNull()
    return parsed.select("path", F.col("modificationTime").alias("modified"), F.when(bad, F.col("raw")).alias("_corrupt"), "doc")


def listing(spark: SparkSession, path: str, name: str = ".*", limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """path, modified and length of files, by path or by time; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    d = d.where(F.element_at(F.split("path", "/"), -1).rlike(name))
    d = d.orderBy(F.desc("modified"), "path") if newest_first else d.orderBy("path")
    return d.limit(limit) if limit is not None else d


def snapshot_paths(files: DataFrame) -> DataFrame:
    """provider_id, snapshot, path of ``.../<provider>/snapshots/<snapshot>/extracted.json``."""
    form = r"/([^/]+)/snapshots/([^/]+)/extracted\.json$"
    return files.select(F.regexp_extract("path", form, 1).alias("provider_id"), F.regexp_extract("path", form, 2).alias("snapshot"), "path").where("provider_id != ''")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file: the key under which documents are stored once."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def decoded(content: Column, content_type: Column) -> Column:
    """HTML bytes as text by the charset of their header, else UTF-8; misread UTF-8 is repaired."""
    charset = F.lower(F.regexp_extract(t.text(content_type), r"(?i)charset=[\"']?([\w-]+)", 1))
    latin = charset.isin("iso-8859-1", "latin-1", "latin1", "windows-1252")
    return t.repair_mojibake()(F.when(latin, F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "UTF-8")))


def pdf_pages():
    """``mapInPandas`` function over binaryFile rows: path, page, text, title, page_count, error.

    Needs a PDF library; without one each file gives a row with ``error``.
    """

    def run(frames):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = path.rsplit("/", 1)[-1].removesuffix(".pdf")
                if PdfReader is None:
                    rows.append((path, None, None, name, None, "no PDF library"))
                    continue
                try:
                    reader = PdfReader(io.BytesIO(content))
                    title = str(getattr(reader.metadata or {}, "title", "") or name).strip() or name
                    for i, p in enumerate(reader.pages, 1):
                        if x := " ".join((p.extract_text() or "").split()):
                            rows.append((path, i, x, title, len(reader.pages), None))
                except Exception as e:  # a damaged file must not end the others
                    rows.append((path, None, None, name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "title", "page_count", "error"])

    return run


PDF_SCHEMA = "path string, page int, text string, title string, page_count int, error string"


def write_documents(df: DataFrame, path: str, *by: str) -> None:
    """JSON documents, in folders by the given columns; nulls are left out."""
    w = df.write.mode("overwrite").option("ignoreNullFields", True)
    (w.partitionBy(*by) if by else w).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, separator: str = " | ") -> None:
    """CSV with a header; lists are joined, maps are JSON, other structures are left out."""
    cols = []
    for f in df.schema.fields:
        if columns and f.name not in columns:
            continue
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), separator).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            cols.append(F.to_json(f.name).alias(f.name))
        elif not isinstance(f.dataType, (T.ArrayType, T.StructType)):
            cols.append(F.col(f.name))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(products: DataFrame, root: str) -> None:
    """Catalog rows in folders by provider and date, so that a read of one snapshot reads its files only."""
    products.write.mode("overwrite").partitionBy("provider_id", "snapshot_date").parquet(root)


def summary_text(counts: dict[str, int], title: str) -> str:
    return "\n".join([f"# {title}", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in counts.items())]) + "\n"


def envelope(provider_id: str, provider_name: str, snapshot_date: str, products: DataFrame, notes: Column) -> DataFrame:
    """One row that describes a snapshot: its provider, date, number of products, and notes, each once."""
    said = F.array_distinct(F.filter(F.transform(notes, lambda x: F.trim(x)), lambda x: x != ""))
    return products.agg(F.count("*").alias("products_count")).select(F.lit(provider_id).alias("provider_id"), F.lit(provider_name).alias("provider_name"), F.lit(snapshot_date).alias("snapshot_date"), said.alias("notes"), "products_count")


def write_bundle(products: DataFrame, differences: DataFrame, about: DataFrame, root: str, title: str) -> str:
    """A snapshot's folder: its envelope, products (JSON lines and CSV), differences and a summary; returns the folder.

    ``about`` is its ``envelope``. Products are lines, not one document, so that a catalog of any size is written by all tasks.
    """
    head = about.first()
    at = f"{root.rstrip('/')}/{head.provider_id}/snapshots/{head.snapshot_date}"
    write_documents(about, f"{at}/envelope.json")
    write_documents(products, f"{at}/extracted.json")
    write_csv(products, f"{at}/products.csv")
    write_documents(differences, f"{at}/diff.json")
    changes = {r["change"]: r["count"] for r in differences.groupBy("change").count().collect()}  # three kinds
    counts = {"products": head.products_count} | {k: changes.get(k, 0) for k in ("added", "removed", "changed")}
    spark = products.sparkSession
    spark.createDataFrame([(summary_text(counts, title),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/summary.md")
    return at
