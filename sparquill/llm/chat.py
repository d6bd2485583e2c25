"""Chat formatting from event logs, with DataFrame operations only.

A log has events (conv_id, slot, seq, kind, role, text). A slot is the place of a
message in its conversation. Kinds: ``start`` begins a message (and its text, if
any), ``delta`` appends, ``edit`` puts other text in place of all before,
``regenerate`` clears the message and drops what later slots had said until then,
``delete`` removes the message. Events are folded by message in order of ``seq``,
messages by conversation in order of ``slot``, and rendered as

    ### role:
    text
    </turn>

Backslashes, number signs and ``</turn>`` in texts are escaped, reversibly; colons
and line ends in roles, too. ``loss`` has, for each assistant message, the number of
its block and where its text is in it (code points).

Defined results: null texts are empty; an unknown kind is read as ``delta``; a null
role keeps the one before (empty if none); null conversation ids are one
conversation; in one ``seq`` the last of the resets by name wins (start, regenerate,
edit, delete) and deltas follow it; empty messages are rendered; a conversation without messages gives no
row; equal events count each; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
HEAD = "### "
#: Code points of a delta that a stored text is streamed as.
DELTA = 2048
RESETS = ("start", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def escape_role(role: Column) -> Column:
    role = F.replace(escape(role), F.lit("\n"), F.lit("\\n"))
    return F.replace(role, F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    """Escapes are read from left to right: parts between doubled backslashes hold none."""
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(F.regexp_replace(p, r"\\([#/])", "$1"), F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")))
    return F.array_join(parts, "\\")


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A log of stored turns (conv_id, turn, role, text) that ends in their texts.

    Each text is streamed in deltas. Of about every third, a draft comes first: what an
    assistant said is regenerated, what another said is edited. ``seq`` is ordered by
    slot, then by place.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    slots = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order))
    slots = slots.withColumn("slot", F.struct(F.col("turn").cast("long").alias("turn"), "n"))
    none = F.lit(None).cast("string")
    event = lambda place, kind, role, text: F.struct(F.struct("slot", place.cast("long").alias("place")).alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    piece = lambda i: F.substring(F.col("text"), i * DELTA + 1, F.lit(DELTA))
    drafted = (F.length("text") > 0) & (F.pmod(F.xxhash64("conv_id", "turn", "n"), F.lit(3)) == 0)
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    # an edit brings the first piece itself
    edited = drafted & ~assistant
    start = event(F.lit(0), F.lit("start"), F.col("role"), none)
    draft = F.array(event(F.lit(1), F.lit("delta"), none, F.concat(F.lit("draft of "), F.substring("text", 1, 9))), event(F.lit(2), F.when(assistant, "regenerate").otherwise("edit"), none, F.when(~assistant, piece(F.lit(0)))))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / DELTA).cast("int")), lambda i: event(i + 3, F.lit("delta"), none, piece(i)))
    log = F.concat(F.array(start), F.when(drafted, draft).otherwise(F.slice(draft, 1, 0)), F.when(F.length("text") > 0, F.filter(pieces, lambda x, i: ~edited | (i > 0))).otherwise(F.slice(F.array(start), 1, 0)))
    return slots.select("conv_id", "slot", F.inline(log))


def messages(events: DataFrame) -> DataFrame:
    """conv_id, slot, role, text: what each message says at the end of its log."""
    kind = F.coalesce("kind", F.lit("delta"))
    event = F.struct("seq", (~kind.isin(*RESETS)).alias("after"), kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    cleared = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    logs = events.groupBy("conv_id", "slot").agg(F.array_sort(F.collect_list(event)).alias("log"), cleared.alias("cleared"))
    # what a slot said before an earlier slot was regenerated is void
    earlier = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    logs = logs.withColumn("bound", F.max("cleared").over(earlier))
    logs = logs.withColumn("log", F.when(F.col("bound").isNull(), F.col("log")).otherwise(F.filter("log", lambda x: x["seq"] >= F.col("bound")))).where(F.size("log") > 0)
    last = F.array_max(F.transform(F.filter("log", lambda x: x["kind"].isin(*RESETS)), lambda x: F.struct(x["seq"].alias("seq"), x["kind"].alias("kind"))))
    logs = logs.withColumn("last", last).where(F.coalesce(F.col("last.kind") != "delete", F.lit(True)))
    live = F.filter("log", lambda x: F.col("last").isNull() | (x["seq"] > F.col("last.seq")) | ((x["seq"] == F.col("last.seq")) & (x["after"] | (x["kind"].isin("start", "edit") & (x["kind"] == F.col("last.kind"))))))
    roles = F.transform(F.filter("log", lambda x: x["role"].isNotNull()), lambda x: x["role"])
    return logs.select("conv_id", "slot", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(said: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (array of block, start, length); each block is made before conversations meet."""
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(":\n"))
    body = escape(F.col("text"))
    blocks = said.select("conv_id", "slot", F.concat(head, body, F.lit("\n" + END)).alias("block"), F.when(F.col("role") == "assistant", F.struct(F.length(head).alias("start"), F.length(body).alias("length"))).alias("mask"))
    got = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("slot", "block", "mask"))).alias("b"))
    masks = F.transform("b", lambda x, i: F.when(x["mask"].isNotNull(), F.struct(i.alias("block"), x["mask"]["start"].alias("start"), x["mask"]["length"].alias("length"))))
    return got.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("formatted"), F.array_compact(masks).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_texts and formatted_chars, from rendered text and mask alone."""
    blocks = F.split("formatted", "</turn>\\n", -1)
    got = formatted.select("conv_id", "loss", F.length("formatted").cast("long").alias("formatted_chars"), F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))).alias("blocks"))

    def turn(b: Column) -> Column:
        head = F.substring_index(b, ":\n", 1)
        role = F.substring(head, F.lit(len(HEAD) + 1), F.length(head))
        text = F.substring(b, F.length(head) + 3, F.length(b) - F.length(head) - 3)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    inside = F.transform("loss", lambda x: unescape(F.substring(F.element_at("blocks", x["block"] + 1), x["start"] + 1, x["length"])))
    return got.select("conv_id", "formatted_chars", F.transform("blocks", turn).alias("turns"), inside.alias("loss_texts"))


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars")
