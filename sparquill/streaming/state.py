"""The state of incremental processing as tables, and one pass over new messages.

A state has a table of messages and one of quotes, the stage that the pass is in and
the counters of the last run. Each save writes a new version aside, claims its number
and renames its folder into place, so a reader finds a whole state or the one before
it. A table that a save doesn't change stays in its folder, which the version names.
A number can be claimed once: of two writers that began with one version the second
is told (``Conflict``) and changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from . import incremental

MESSAGES = "message_id string, status string, internal_date_ms string, extraction_status string"
QUOTES = "quote_key string, message_id string, url string, status string, error string"
SCHEMAS = {"messages": MESSAGES, "quotes": QUOTES}
IDLE = "idle"
KEPT_VERSIONS = 3
#: Seconds after which a claim or a lock is taken for one of a writer that has died.
STALE_SECONDS = 900


class Conflict(RuntimeError):
    """Another writer has changed the state since it was loaded."""


@dataclass
class State:
    messages: DataFrame
    quotes: DataFrame
    stage: str = IDLE
    last_run: dict = field(default_factory=dict)
    version: int = 0


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(self.root))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _about(self, version: int) -> dict:
        at = f"v{version:012d}"
        about = json.loads(self.spark.read.text(f"{self.root}/{at}/about").first().value)
        # versions that don't name their tables have them in their own folder
        return {"tables": {name: f"{at}/{name}" for name in SCHEMAS}} | about

    def table(self, version: int, name: str, more: str = "") -> DataFrame:
        """A table of a version; ``more`` are columns beyond its schema."""
        return self.spark.read.schema(SCHEMAS[name] + more).parquet(f"{self.root}/{self._about(version)['tables'][name]}")

    def load(self) -> State:
        """The last whole version, or an empty state; a stage whose messages are all done counts as idle."""
        versions = self._versions()
        if not versions:
            return State(self.spark.createDataFrame([], MESSAGES), self.spark.createDataFrame([], QUOTES))
        last, about = versions[-1], self._about(versions[-1])
        state = State(self.table(last, "messages"), self.table(last, "quotes"), about["stage"], about["last_run"], last)
        if state.stage != IDLE and not state.messages.where("status = 'in_progress'").head(1):
            state.stage = IDLE
        return state

    def save(self, state: State, changed: tuple[str, ...] = tuple(SCHEMAS)) -> State:
        """Write the version after the loaded one, take it into use, remove those that are no longer read; returns the stored state.

        Tables that aren't named in ``changed`` stay those of the loaded version. Raises ``Conflict`` if the newest
        version isn't the one that ``state`` was made from.
        """
        made, number = uuid.uuid4().hex, state.version + 1
        aside = f"{self.root}/_{made}"
        stored = self._about(state.version)["tables"] if state.version in self._versions() else {}
        own = {name: f"{name}-{made}" for name in SCHEMAS if name in changed or name not in stored}
        try:
            for name, at in own.items():
                getattr(state, name).write.parquet(f"{self.root}/{at}")
            about = {"stage": state.stage, "last_run": state.last_run, "tables": stored | own}
            self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{aside}/about")
            # of several writers one gets the number; then no other can put a folder there
            mine = self._versions()[-1:] in ([], [state.version]) and self.claim(f"v{number:012d}", STALE_SECONDS)
            if not mine or self._versions()[-1:] not in ([], [state.version]):
                raise Conflict(f"{self.root} has changed since version {state.version}")
            if not self._fs.rename(self._path(aside), self._path(f"{self.root}/v{number:012d}")):
                self.release(f"v{number:012d}")
                raise RuntimeError(f"version {number} of {self.root} could not be stored")
        except Exception:
            for at in (aside, *(f"{self.root}/{x}" for x in own.values())):
                self._fs.delete(self._path(at), True)
            raise
        self._remove_old()
        return self.load()

    def _remove_old(self) -> None:
        """Versions before the last ones go, with the tables that no later one names."""
        versions = self._versions()
        if len(versions) <= KEPT_VERSIONS:
            return
        kept = {at for v in versions[-KEPT_VERSIONS:] for at in self._about(v)["tables"].values()}
        for v in versions[:-KEPT_VERSIONS]:
            for at in set(self._about(v)["tables"].values()) - kept:
                self._fs.delete(self._path(f"{self.root}/{at}"), True)
            if not any(at.startswith(f"v{v:012d}/") for at in kept):
                self._fs.delete(self._path(f"{self.root}/v{v:012d}"), True)
                self.release(f"v{v:012d}")

    def claim(self, name: str, stale_seconds: float | None = None) -> bool:
        """Take a lock: whether nobody holds it; creation is atomic.

        One older than ``stale_seconds`` whose version was never stored is removed first.
        """
        lock = self._path(f"{self.root}/_lock-{name}")
        if stale_seconds is not None and self._fs.exists(lock) and not self._fs.exists(self._path(f"{self.root}/{name}")):
            if time.time() * 1000 - self._fs.getFileStatus(lock).getModificationTime() > stale_seconds * 1000:
                self._fs.delete(lock, False)
        try:
            self._fs.create(lock, False).close()
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise

    def release(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/_lock-{name}"), False)


def cursor(state: State) -> DataFrame:
    return incremental.cursor(state.messages)


def process_once(found: DataFrame, states: StateStore, process: Callable[[DataFrame], DataFrame], valid: Callable, reprocess: bool = False) -> dict[str, int]:
    """One pass: messages that aren't completed, their quotes that aren't processed; returns counters.

    ``found`` has message_id, internal_date_ms, extraction_status and quote_urls, and
    holds messages that are to be tried again, too. ``process`` takes new quotes
    (quote_key, message_id, url) and returns quote_key, status (processed or failed)
    and error. A message stays in progress, and is tried again, while a quote of it
    failed; all else completes it. The state is saved before and after each step. One
    pass runs at a time: another one raises ``Conflict``, unless the lock is stale; then
    the first of both that saves goes on.
    """
    if not states.claim("pass", STALE_SECONDS):
        raise Conflict(f"another pass runs over {states.root}")
    passing = states._path(f"{states.root}/_pass-{uuid.uuid4().hex}")
    states._fs.deleteOnExit(passing)
    try:
        return _pass(found, states, process, valid, reprocess, passing.toString())
    finally:
        states._fs.delete(passing, True)
        states.release("pass")


def _newest(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """New rows over stored ones, among new ones the greatest ``version``; ``_own``: a new row in progress.

    Keys have few rows, so rows are dealt before they are grouped: partial results in the tasks that read them would
    sort all they read and save nothing.
    """
    cols = stored.columns
    every = stored.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    grouped = every.repartition(key).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_new", version)).alias("_r"), F.max("_new").alias("_new"))
    return grouped.select("_r.*", ((F.col("_new") == 1) & (F.col("_r.status") == "in_progress")).alias("_own"))


def _pass(found: DataFrame, states: StateStore, process: Callable[[DataFrame], DataFrame], valid: Callable, reprocess: bool, passing: str) -> dict[str, int]:
    """What is new is written to ``passing`` and not joined anew by each step.

    Tables stored during a pass have a column ``_own`` beside their schema: whether a message or quote is one of the
    pass. Steps without new rows leave the tables where they are.
    """
    spark = states.spark

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{passing}/{name}")
        return spark.read.schema(df.schema).parquet(f"{passing}/{name}")

    state = states.load()
    finished = state.messages.where("status = 'completed'").select("message_id")
    new = found.where("message_id IS NOT NULL").select("message_id", "internal_date_ms", "extraction_status", "quote_urls")
    new = kept(new.join(finished, "message_id", "left_anti"), "messages")
    messages_come = bool(new.head(1))
    seen = _newest(state.messages, new.withColumn("status", F.lit("in_progress")), "message_id", "internal_date_ms")
    state = states.save(State(seen, state.quotes, "extracting", state.last_run, state.version), ("messages",) if messages_come else ())
    urls = new.where("extraction_status = 'extracted'").select("message_id", F.explode(F.array_distinct("quote_urls")).alias("url"))
    quotes = urls.select(t.quote_key(F.col("message_id"), F.col("url")).alias("quote_key"), "message_id", "url")
    done = state.quotes.where("status = 'processed'").select("quote_key")
    fresh = quotes if reprocess else quotes.join(done, "quote_key", "left_anti")
    fresh = kept(fresh.withColumn("_valid", valid(F.col("url"))).where("_valid IS NOT NULL"), "quotes")
    good = fresh.where("_valid").drop("_valid")
    word = lambda yes, no: F.when(F.col("_valid"), F.lit(yes)).otherwise(F.lit(no)).cast("string")
    begun = fresh.select("quote_key", "message_id", t.mask_query(F.col("url")).alias("url"), word("in_progress", "invalid_quote_url").alias("status"), word(None, "no address of a quote").alias("error"))
    changed = _newest(state.quotes, begun, "quote_key", "message_id")
    state = states.save(State(state.messages, changed, "processing", state.last_run, state.version), ("quotes",) if fresh.head(1) else ())
    results, quotes_come = {}, bool(good.head(1))
    if quotes_come:
        got = process(good).select(F.col("quote_key").alias("_k"), F.struct(F.col("status").alias("status"), F.col("error").alias("error")).alias("_got"))
        got = got.repartition("_k").groupBy("_k").agg(F.min("_got").alias("_got"))
        value = lambda c: F.when(F.col("_k").isNotNull(), F.col(f"_got.{c}")).otherwise(F.col(c)).alias(c)
        ended = states.table(state.version, "quotes", ", _own boolean").join(got, F.col("quote_key") == F.col("_k"), "left")
        changed = ended.select("quote_key", "message_id", "url", value("status"), value("error"), "_own")
    state = states.save(State(state.messages, changed, "completing", state.last_run, state.version), ("quotes",) if quotes_come else ())
    if quotes_come:
        own = states.table(state.version, "quotes", ", _own boolean").where("_own")
        results = {r.status: r.n for r in own.groupBy("status").agg(F.count("*").alias("n")).collect()}
    one = lambda d: d.agg(F.count("*").alias("n")).first().n
    total, taken = one(urls), one(good)
    counters = {"messages_seen": one(new), "messages_with_quotes": one(new.where("extraction_status = 'extracted'")), "quotes_processed": results.get("processed", 0), "quotes_failed": results.get("failed", 0), "quotes_skipped": total - taken}
    open_ = state.quotes.where("status IN ('failed', 'in_progress')").select(F.col("message_id").alias("_m")).repartition("_m").distinct()
    ended = states.table(state.version, "messages", ", _own boolean").join(open_, F.col("message_id") == F.col("_m"), "left")
    status = F.when(F.col("_own") & F.col("_m").isNull(), "completed").otherwise(F.col("status")).alias("status")
    states.save(State(ended.select("message_id", status, "internal_date_ms", "extraction_status"), state.quotes, IDLE, counters, state.version), ("messages",) if messages_come else ())
    return counters
