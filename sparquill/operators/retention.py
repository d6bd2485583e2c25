"""Retention: what is expired, counts for a dry run, deletes in their order, old files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States that end a quote or a task.
ENDED = ("completed", "failed", "cancelled", "archived")
# End of the fixed values.


@dataclass(frozen=True)
class Policy:
    """Days that rows and files are kept."""

    quotes: int = 90
    tasks: int = 30
    logs: int = 30
    debug: int = 7
    experiments: int = 7


def cutoff(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def expired(rows: DataFrame, now: Column, days: int, states: tuple[str, ...] = ENDED, at: str = "created_at", status: str = "status") -> DataFrame:
    """Rows that ended and are older than the cutoff; active ones are protected whatever their age."""
    return rows.where(F.col(status).isin(*states) & (F.col(at) < cutoff(now, days)))


@dataclass
class Store:
    quotes: DataFrame
    tasks: DataFrame
    events: DataFrame
    emails: DataFrame
    children: dict[str, DataFrame]


def delete_expired(store: Store, now: Column, policy: Policy = Policy()) -> Store:
    """The tables after the deletes, in this order: events of expired quotes, those quotes with all their
    children, events of expired tasks, those tasks, old events, mails that no quote refers to.

    Events don't go with their quote by themselves, which is why they come first.
    """
    old = expired(store.quotes, now, policy.quotes).select("quote_id")
    events = store.events.join(old, "quote_id", "left_anti")
    quotes = store.quotes.join(old, "quote_id", "left_anti")
    children = {name: c.join(old, "quote_id", "left_anti") for name, c in store.children.items()}
    done = expired(store.tasks, now, policy.tasks).select("task_id")
    events = events.join(done, "task_id", "left_anti")
    tasks = store.tasks.join(done, "task_id", "left_anti")
    events = events.where(~F.coalesce(F.col("created_at") < cutoff(now, policy.logs), F.lit(False)))
    emails = store.emails.join(quotes.select("email_id").where("email_id IS NOT NULL").distinct(), "email_id", "left_semi")
    return Store(quotes, tasks, events, emails, children)


def counts(store: Store, now: Column, policy: Policy = Policy()) -> DataFrame:
    """What a run would delete: one row of counts."""
    one = lambda d, name: d.agg(F.count("*").alias(name))
    orphans = store.emails.join(store.quotes.select("email_id").where("email_id IS NOT NULL").distinct(), "email_id", "left_anti")
    protected = store.quotes.where(~F.col("status").isin(*ENDED) & (F.col("created_at") < cutoff(now, policy.quotes)))
    out = one(expired(store.quotes, now, policy.quotes), "expired_quotes").crossJoin(one(protected, "protected_quotes"))
    out = out.crossJoin(one(expired(store.tasks, now, policy.tasks), "expired_tasks")).crossJoin(one(store.events.where(F.col("created_at") < cutoff(now, policy.logs)), "old_events"))
    return out.crossJoin(one(orphans, "orphan_emails"))


def old_files(spark: SparkSession, path: str, now: Column, days: int, name: str = ".*") -> DataFrame:
    """path and modified of files older than the cutoff whose name matches; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.where((F.col("modified") < cutoff(now, days)) & F.element_at(F.split("path", "/"), -1).rlike(name))


def candidates(*lists: DataFrame) -> DataFrame:
    """Candidates of several lists, each path once, the first list's reason kept."""
    every = None
    for i, d in enumerate(lists):
        d = d.withColumn("_list", F.lit(i))
        every = d if every is None else every.unionByName(d)
    cols = [c for c in every.columns if c != "_list"]
    return every.groupBy("path").agg(F.min_by(F.struct(*cols), "_list").alias("r")).select("r.*")
