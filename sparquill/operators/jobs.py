"""Jobs: named steps with their outcome, counters of what a load did, traces, and where outputs go."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Warnings that a report keeps.
KEPT_WARNINGS = 50
STEP = "step string, status string, rows long, seconds double, message string"


@dataclass
class Step:
    """A step takes the tables of those before it and returns one of its own, which is written."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    #: A step that isn't wanted is skipped, and later ones go on without it.
    enabled: bool = True


@dataclass
class Run:
    status: str
    message: str
    steps: list[tuple]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.steps, STEP)


def run_step(step: Step, tables: dict[str, DataFrame], root: str, spark: SparkSession) -> tuple[tuple, DataFrame | None]:
    """One step: its row of the report, and its table as written (none if it failed)."""
    began, path = time.time(), f"{root.rstrip('/')}/{step.name}"
    try:
        step.run(tables).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        return (step.name, "completed", made.count(), round(time.time() - began, 2), None), made
    except Exception as e:
        return (step.name, "failed", None, round(time.time() - began, 2), str(e).split("\n")[0][:4000]), None


def refresh(spark: SparkSession, steps: list[Step], root: str, tables: dict[str, DataFrame] | None = None) -> Run:
    """Steps in their order; after one that fails the others aren't run, and the report says so."""
    known, rows, failed = dict(tables or {}), [], None
    for step in steps:
        if failed:
            rows.append((step.name, "not_run", None, None, None))
        elif not step.enabled:
            rows.append((step.name, "skipped", None, None, None))
        else:
            row, made = run_step(step, known, root, spark)
            rows.append(row)
            if made is None:
                failed = step.name
            else:
                known[step.name] = made
    if failed:
        return Run("failed", f"step {failed} failed", rows, known)
    return Run("completed", "all steps ended", rows, known)


def read_summary(reports: DataFrame, key: str = "quote_id") -> DataFrame:
    """One row: reports seen, with matches, with reviewed options, from (parts_with_matches, parts_with_options)."""
    some = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit(0)) > 0, 1))
    return reports.agg(F.countDistinct(key).alias("quotes_seen"), some("parts_with_matches").alias("quotes_with_provider"), some("parts_with_options").alias("quotes_with_agentic"))


def load_counters(outcomes: DataFrame) -> DataFrame:
    """One row of what a load did to its documents (source, outcome, warning): counts, and the first warnings by source."""
    is_ = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    said = F.when(F.col("warning").isNotNull(), F.struct("source", "warning"))
    # a bounded list: the least 50 of each task, then of all
    first = outcomes.where("warning IS NOT NULL").select(F.concat_ws(": ", "source", "warning").alias("w")).orderBy("w").limit(KEPT_WARNINGS).agg(F.array_sort(F.collect_list("w")).alias("warning_messages"))
    counts = outcomes.agg(*(is_(o) for o in ("imported", "updated", "skipped", "failed")), F.count(said).alias("warnings"))
    return counts.join(F.broadcast(first))


def trace(stage: str, message: Column, at: Column | None = None, **details: Column) -> Column:
    """An event of a trace; details as JSON."""
    said = F.to_json(F.struct(*(c.alias(n) for n, c in details.items()))) if details else F.lit("{}")
    return F.struct((F.current_timestamp() if at is None else at).alias("timestamp"), F.lit(stage).alias("stage"), message.alias("message"), said.alias("details"))


def outputs(mode: str, quotes: str, reports: str, traces: str | None = None, snapshots: str | None = None, root: str = "output") -> dict[str, str | None]:
    """Where the outputs of a mode go: traces from ``standard`` on, snapshots in ``debug``, others only where a folder is named."""
    if mode not in ("minimal", "standard", "debug"):
        raise ValueError(f"no such mode: {mode}")
    return {
        "quotes": quotes or f"{root}/quotes", "reports": reports or f"{root}/reports",
        "traces": traces or (f"{root}/traces" if mode != "minimal" else None), "snapshots": snapshots or (f"{root}/snapshots" if mode == "debug" else None),
    }


def asked_urls(given: DataFrame, records: DataFrame) -> DataFrame:
    """url and its place: addresses given by hand, then those of extracted records, trimmed, each once in order.

    ``given`` has pos and url; ``records`` pos, extraction_status and quote_url.
    """
    one = lambda d, source, url: d.select(F.struct(F.lit(source).alias("source"), "pos").alias("place"), F.trim(t.text(url)).alias("url"))
    every = one(given, 0, "url").unionByName(one(records.where("extraction_status = 'extracted'"), 1, "quote_url")).where("url <> ''")
    return every.groupBy("url").agg(F.min("place").alias("place"))


def shown_hits(hits: DataFrame) -> Column:
    """A hit as JSON text: title, page span, rounded scores, mode, and the first 320 characters."""
    score = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 4).alias(c)
    return F.to_json(F.struct("title", t.page_span(F.col("page"), F.col("page")).alias("page_span"), score("score"), score("text_score"), score("vector_score"), F.coalesce("retrieval_mode", F.lit("text")).alias("retrieval_mode"), F.substring(t.text("content"), 1, 320).alias("excerpt")))
