"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the greatest length are cut into pieces of it and a rest. In
order of decreasing length each piece goes to the open bin that it fills best; if
none has room, a bin is opened whose length costs least for what is likely to fill
it: cost(length) / min(length, tokens still to place) over all permitted lengths
that hold the piece. At the end every bin shrinks to the shortest permitted length
that holds its contents.

Rows are dealt by a hash of their id and length into shards of about ``SHARD_ROWS``
documents, each to the task of its number; a shard is packed in windows of at most ``WINDOW`` pieces, so memory is bounded
whatever its size. Only ids and lengths shuffle.

Defined results: a document without tokens has one empty piece in no bin (bin_id and
capacity null); a null count is 0; null ids are dealt like an id of their own; repeated
rows are packed one by one; other columns aren't read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 16_384
WINDOW = 65_536


def cost(length: int) -> float:
    """Work of one sequence: linear layers, attention that grows with the square, and a fixed part."""
    return 64 + length + length * length / 16_384


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (all of 1 to max(lengths) tokens), and the length of each bin.

    ``sizes`` must come in decreasing order.
    """
    lengths = sorted(lengths)
    costs = [cost(x) for x in lengths]
    rest: list[tuple[int, int]] = []  # free room and bin, ascending
    used: list[int] = []
    bins: list[int] = []
    offsets: list[int] = []
    left = sum(sizes)
    for n in sizes:
        k = bisect_left(rest, (n, -1))
        if k < len(rest):
            room, b = rest.pop(k)
        else:
            first = bisect_left(lengths, n)
            # a bin can't be filled by more than what is still to place
            best = min(range(first, len(lengths)), key=lambda i: (costs[i] / min(lengths[i], max(left, n)), lengths[i]))
            b, room = len(used), lengths[best]
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if room > n:
            insort(rest, (room - n, b))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pack_documents(sizes: DataFrame, lengths: Sequence[int] = LENGTHS, doc_id: str = "doc_id", n_tokens: str = "n_tokens", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces: doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity.

    ``sizes`` should be a staged table: it is counted first.
    """
    most = max(lengths)
    shards = max(1, math.ceil(sizes.count() / shard_rows))
    id_type = sizes.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "n_tokens")), T.StructField("bin_id", T.StringType()), T.StructField("bin_offset", T.LongType()), T.StructField("capacity", T.LongType())])

    def settle(shard: int, window: int, ids: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        pieces = np.maximum(1, -(-n // most))
        owner = np.repeat(np.arange(len(n)), pieces)
        first = np.zeros(len(n), np.int64)
        np.cumsum(pieces[:-1], out=first[1:])
        piece = np.arange(len(owner)) - first[owner]
        start = piece * most
        size = np.minimum(most, n[owner] - start)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        bins, offsets, caps = pack(size[order].tolist(), lengths)
        name: list[str | None] = [None] * len(owner)
        at: list[int | None] = [None] * len(owner)
        cap: list[int | None] = [None] * len(owner)
        for i, b, o in zip(order.tolist(), bins, offsets, strict=True):
            name[i], at[i], cap[i] = f"{shard}-{window}-{b}", o, caps[b]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(piece), pa.array(start), pa.array(size), pa.array(name, pa.string()), pa.array(at, pa.int64()), pa.array(cap, pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of shard, decreasing length and id."""
        held: list[pa.RecordBatch] = []
        shard, window, count = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                ids = whole.column("id").combine_chunks() if isinstance(whole.column("id"), pa.ChunkedArray) else whole.column("id")
                yield settle(shard, window, ids, whole.column("n").to_numpy())

        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    if shard != of[a]:
                        yield from flush()
                        held, shard, window, count = [], int(of[a]), 0, 0
                    elif count >= WINDOW:
                        yield from flush()
                        held, window, count = [], window + 1, 0
                    n = batch.column("n").slice(a, b - a).to_numpy()
                    take = max(1, int(np.searchsorted(np.cumsum(np.maximum(1, -(-n // most))), WINDOW - count, side="right")))
                    held.append(batch.slice(a, min(take, b - a)))
                    count += int(np.maximum(1, -(-n[:take] // most)).sum())
                    a += min(take, b - a)
        yield from flush()

    rows = sizes.select(F.col(doc_id).alias("id"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "n"), F.lit(shards)).cast("int"))
    tasks = max(1, min(shards, 20_000))
    dealt = rows.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", F.desc("n"), "id")
    return dealt.mapInArrow(run, schema)
