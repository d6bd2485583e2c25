"""Mixing sources to target weights by hierarchical budgeting.

A tree of columns (domain, language, source) has weights on its edges. A budget of
tokens flows from the root: each parent divides what it has among its children in
proportion to their weights, but no child gets more than its leaves can give in
``max_epochs`` epochs (a leaf at or below a weight of 0 gives nothing); what a child
can't take goes to its siblings, and only what all of them can't take stays with the
parent's own siblings. Budgets are whole tokens: what rounding leaves over goes, one
each, to siblings with room in order of their names, so the leaves' budgets sum up to
the total or to all that the leaves can give. Each leaf then takes a prefix of its
documents in a seeded order: whole epochs first, then documents of the last epoch,
each with its own order, until the budget is full.

The prefix needs no sorted leaf: sums of hash ranges say which ranges are in, out
or cut; the cut range is parted into ranges again, and only the documents of its cut
part (about one in ``RANGES`` squared) are ordered. A leaf with a third of all rows
is spread over all tasks.

Defined results: null tree columns form a leaf of their own; nodes without a weight
have ``default_weight``; a weight of 0 gives nothing; null or empty texts (or counts)
have no tokens and come with their place in the order; the document on the budget's
edge is taken whole if at least half of it fits. Repeated rows count one by one and
are taken or left together only where their ids and sizes are equal. Columns may have
any names, but for ``copies``, which is replaced. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

RANGES = 4096
UNIT = 1_000_000


def words(text: Column) -> Column:
    """Words of a text: the number of tokens that budgets count unless a column says otherwise."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], ordinal: list[str]) -> DataFrame:
    """``budget`` of each node from its parent's ``above``, by ``weight`` and ``capacity`` (longs).

    Siblings in order of capacity/weight fill up one after another: with C and W the
    sums of capacities before and of weights from a node on, the level is the
    greatest (above - C) / W, and a node gets min(capacity, weight * level), in whole
    numbers; the rest that these leave goes to nodes with room, one each.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("ratio"), *ordinal)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    named = Window.partitionBy(*parent).orderBy(*ordinal)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    filled = F.least(F.col("capacity"), F.floor(F.expr("(CAST(weight AS DECIMAL(18,0)) * CAST(at.num AS DECIMAL(19,0))) div CAST(at.den AS DECIMAL(19,0))")).cast("long"))
    return (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("num", F.greatest(F.lit(0), F.col("above") - F.coalesce(F.sum(big("capacity")).over(before).cast("long"), F.lit(0))))
        .withColumn("den", F.sum("weight").over(onward))
        .withColumn("at", F.max_by(F.struct("num", "den"), F.when(F.col("den") > 0, F.col("num") / F.col("den"))).over(whole))
        .withColumn("filled", F.when((F.col("weight") > 0) & (F.col("at.den") > 0), filled).otherwise(0))
        .withColumn("rest", F.least(F.col("above"), F.sum("capacity").over(whole)) - F.sum("filled").over(whole))
        .withColumn("room", (F.col("filled") < F.col("capacity")).cast("int"))
        .withColumn("budget", F.col("filled") + F.when((F.col("room") == 1) & (F.sum("room").over(named) <= F.col("rest")), 1).otherwise(0))
        .drop("ratio", "num", "den", "at", "filled", "rest", "room")
    )


def budgets(leaves: DataFrame, levels: list[str], total: int, max_epochs: int, weight_of: dict[str, dict[str, float]], default_weight: float = 1.0) -> DataFrame:
    """``leaves`` (levels, tokens) with a budget each; the table has a row for each leaf."""
    path = [f"l{i}" for i in range(len(levels))]

    def weight(i: int) -> Column:
        w = F.lit(int(default_weight * UNIT))
        for value, x in weight_of.get(levels[i], {}).items():
            w = F.when(F.col(path[i]) == value, int(x * UNIT)).otherwise(w)
        return w.cast("long")

    out = leaves.select(*(F.col(c).alias(p) for c, p in zip(levels, path, strict=True)), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), F.lit(total).cast("long").alias("above"))
    given = F.lit(True)
    for i in range(len(levels)):
        given &= weight(i) > 0
    out = out.withColumn("capacity", F.when(given, F.col("tokens") * F.lit(max_epochs)).otherwise(0))
    for i in range(len(levels)):
        own, parent = path[: i + 1], path[:i]
        nodes = out.groupBy(*own, "above").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(i))
        nodes = share_out(nodes, parent or [F.lit(0)], [F.col(path[i]).asc_nulls_first()]).select(*(F.col(c).alias(f"_{c}") for c in own), "budget")
        out = out.drop("above").join(nodes, _same(own, [f"_{c}" for c in own])).select(*path, "tokens", "capacity", F.col("budget").alias("above"))
    return out.select(*(F.col(p).alias(c) for c, p in zip(levels, path, strict=True)), "tokens", F.col("above").alias("budget"))


def _same(left: list[str], right: list[str]) -> Column:
    match = F.lit(True)
    for a, b in zip(left, right, strict=True):
        match &= F.col(a).eqNullSafe(F.col(b))
    return match


def _order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix(sizes: DataFrame, levels: list[str], total: int, max_epochs: int, weight_of: dict[str, dict[str, float]], seed: str = "mix", default_weight: float = 1.0) -> DataFrame:
    """Rows of ``sizes`` (doc_id, n_tokens, levels; more pass through) with ``copies``, those with none left out.

    ``sizes`` should be a staged table: it is read four times. Tables with a row for
    each leaf are staged between the steps, so the plan stays small.
    """
    ws = Workspace(sizes.sparkSession, "mixing")
    path = [f"l{i}" for i in range(len(levels))]
    # the caller's columns travel in one struct, so none of them can clash with a name in here
    kept = F.struct(*(F.col(f"`{c}`") for c in sizes.columns if c.lower() != "copies")).alias("row")
    rows = sizes.select(kept, *(F.col(c).alias(p) for c, p in zip(levels, path, strict=True)), F.col("doc_id").alias("id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n"))
    leaves = ws.stage(rows.groupBy(*path).agg(F.sum("n").alias("tokens")), "leaves")
    plan = budgets(leaves, path, total, max_epochs, {p: weight_of.get(c, {}) for c, p in zip(levels, path, strict=True)}, default_weight)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    beside = [f"_{p}" for p in path]
    aside = lambda d, *columns: d.select(*(F.col(p).alias(b) for p, b in zip(path, beside, strict=True)), *columns)
    # the leaf table has a row for each leaf; Spark broadcasts it where its size allows
    rows = rows.join(ws.stage(aside(plan, "full", "rest"), "plan"), _same(path, beside)).drop(*beside).withColumn("key", _order_key(seed, F.col("full"), F.col("id"))).withColumn("base", F.lit(0).cast("long"))
    out = []
    for level in range(2):
        # the first range that reaches the budget is cut; of those before it all documents are in
        digits = F.substring("key", 1 + 3 * level, 3)
        sums = rows.where(F.col("rest") > 0).groupBy(*path, "rest", "base", digits.alias("range")).agg(F.sum("n").alias("n"))
        before = Window.partitionBy(*path).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("start") < F.col("rest"))
        cut = F.when(F.col("start") + F.col("n") > F.col("rest"), F.struct("range", "start"))
        edge = sums.groupBy(*path).agg(F.max("range").alias("last"), F.max(cut).alias("cut"))
        rows = rows.join(ws.stage(aside(edge, "last", "cut"), f"edge{level}"), _same(path, beside), "left").drop(*beside).withColumn("at_edge", F.coalesce(digits == F.col("cut.range"), F.lit(False)))
        sure = rows.where(~F.col("at_edge"))
        out.append(sure.select("row", (F.col("full") + F.coalesce(digits <= F.col("last"), F.lit(False)).cast("long")).alias("copies")))
        rows = rows.where("at_edge").withColumn("base", F.col("cut.start")).drop("last", "cut", "at_edge")
    order = Window.partitionBy(*path).orderBy("key", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0))
    out.append(rows.withColumn("at", at).select("row", (F.col("full") + (2 * (F.col("rest") - F.col("at")) >= F.col("n")).cast("long")).alias("copies")))
    return out[0].unionByName(out[1]).unionByName(out[2]).where(F.col("copies") > 0).select("row.*", "copies")
