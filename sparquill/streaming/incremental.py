"""Incremental processing: new keys, cursors, retries and their streaming form.

The cursor only reports how far completed work reaches. A message is processed
because its id isn't completed, not because it is newer than the cursor: late ones
count. Everything here works on tables or, by ``run_stream``, on a file stream whose
checkpoint holds the offsets; each micro-batch is idempotent by key, so a batch that
runs again after a failure changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import exists


def new_keys(current: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return current.join(known.select(key).distinct(), key, "left_anti")


def to_process(found: DataFrame, states: DataFrame, key: str = "message_id") -> DataFrame:
    """Unfinished messages and new ones, each once, in order of (date or 0, id).

    ``states`` has key, status and internal_date_ms; ``found`` key and internal_date_ms.
    """
    retries = states.where(F.col("status") != "completed").select(key, "internal_date_ms", F.lit(0).alias("_source"))
    finished = states.where(F.col("status") == "completed").select(key)
    fresh = found.join(finished, key, "left_anti").select(key, "internal_date_ms", F.lit(1).alias("_source"))
    both = retries.unionByName(fresh).groupBy(key).agg(F.min_by("internal_date_ms", "_source").alias("internal_date_ms"))
    return both.orderBy(F.coalesce(F.col("internal_date_ms").try_cast("long"), F.lit(0)), key)


def cursor(states: DataFrame, key: str = "message_id", date: str = "internal_date_ms") -> DataFrame:
    """The completed message with the greatest (date, id): one row, nulls if there is none."""
    at = F.struct(F.coalesce(F.col(date).try_cast("long"), F.lit(0)).alias(date), F.col(key))
    return states.where(F.col("status") == "completed").agg(F.max(at).alias("c")).select(F.col(f"c.{date}").alias(date), F.col(f"c.{key}").alias(key))


def advance(now_date: Column, now_id: Column, date: Column, key: Column) -> tuple[Column, Column]:
    """The cursor after one more completed message: it never goes back; on equal dates the last id wins."""
    later = now_date.isNull() | (date >= now_date)
    return F.when(later, date).otherwise(now_date), F.when(later, key).otherwise(now_id)


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """path, change: files that came, changed their time, or went."""
    a, b = files.select("path", F.col("modified").alias("m")), before.select(F.col("path").alias("p"), F.col("modified").alias("n"))
    d = a.join(b, F.col("path") == F.col("p"), "full_outer")
    change = F.when(F.col("p").isNull(), "new").when(F.col("path").isNull(), "gone").when(F.col("m") != F.col("n"), "changed")
    return d.select(F.coalesce("path", "p").alias("path"), change.alias("change")).where(F.col("change").isNotNull())


def run_stream(spark: SparkSession, source: str, schema, process: Callable[[DataFrame, int], None], checkpoint: str, keys: list[str], watermark: tuple[str, str] | None = None, once: bool = True, every: str = "2 seconds", fmt: str = "parquet", files_per_batch: int | None = None):
    """A file stream, each key once, to ``process(batch, number)``.

    With a watermark (time column, delay) the state of seen keys is bounded; without,
    ``process`` must skip known keys itself (``new_keys``), as tables of processed keys
    outlive any stream. ``once`` takes what is there and stops.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(source)
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


BUCKETS = 256


def idempotent_append(spark: SparkSession, target: str, keys: list[str], stream: str = "stream", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A sink that appends rows whose keys the target lacks, each once.

    A batch writes to a folder of its own, named by ``stream`` (one name for each
    checkpoint that writes to the target) and the batch's number. Spark runs a batch
    again if it stopped before its commit: then the batch's earlier rows don't count
    as known, and the folder is written anew with all of them. Rows lie in buckets of
    their keys' hash, so a batch reads known keys of its own buckets only. Null keys
    are equal to each other.
    """

    def process(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        known = None
        if not exists(spark, f"{target}/_columns"):
            # what ``appended`` reads by, also if no batch has had a row yet
            spark.createDataFrame([(batch.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_columns")
        else:
            # an empty batch has left no file that tells a schema
            known = _stored(spark, target, [batch.schema[k] for k in keys])
            known = known.where((F.col("_stream") != stream) | (F.col("_batch") != number))
            mine = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
            known = known.where(F.col("_bucket").isin(mine)).select(*keys, "_bucket")
        rows = _lacking(rows, known, keys)
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/_stream={stream}/_batch={number}")

    return process


def _lacking(rows: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row of each key that ``known`` lacks; both have ``_bucket``.

    Rows and known keys are dealt by key once, then sorted: a sort holds what a task gets of the shuffle and can
    spill, while a partial removal of copies would hold all keys of an input split, nearly all of which differ.
    """
    every = rows.withColumn("_known", F.lit(0))
    if known is not None:
        other = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*keys, "_bucket")]
        every = every.unionByName(known.select(*keys, "_bucket", *other, F.lit(1).alias("_known")))
    by = ["_bucket", *keys]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_known")))
    return every.repartition(*by).withColumn("_place", place).where("_place = 1").where("_known = 0").drop("_place", "_known")


def _stored(spark: SparkSession, target: str, columns: list[T.StructField]) -> DataFrame:
    own = [T.StructField("_stream", T.StringType()), T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())]
    return spark.read.schema(T.StructType([*columns, *own])).option("basePath", target).parquet(target)


def appended(spark: SparkSession, target: str) -> DataFrame:
    """What such a sink wrote, without its own columns; no rows if all its batches were empty."""
    columns = T.StructType.fromJson(json.loads(spark.read.text(f"{target}/_columns").first().value))
    return _stored(spark, target, columns.fields).drop("_stream", "_batch", "_bucket")


def poll_line(cursor_date: Column, processed: Column, failed: Column, seconds: int) -> Column:
    return F.format_string("cursor=%s processed=%d failed=%d next=%ds", F.coalesce(cursor_date.cast("string"), F.lit("-")), processed, failed, F.lit(seconds))
