"""Exact deduplication by two passes over Bloom filters.

Pass one: each task makes two bitmaps of its texts' hashes, the bits that are set
(``once``) and those that repeated hashes set (``twice``). Bitmaps merge by
``twice |= later.twice | once & later.once`` and ``once |= later.once``, in any order,
so no hash is shuffled: tasks send their bitmaps in slices, compressed, and each
slice is merged by a task of its own. Pass two probes the merged ``twice``: a text
with a bit outside it is unique and passes straight through; only the others shuffle,
as digests, and meet by their SHA-256.

A unique row takes the other way only if other rows set both its bits: with
``BITS_PER_ROW`` bits for each row about one in seventy does. The filter that is sent to the executors has at most ``max_filter_bytes``;
beyond, its bits serve more rows, which sends more digests through the shuffle and
changes no result. Groups of equal texts are counted with partial sums; the few
largest ones reach their rows by a table of at most ``HOT`` rows, so a group with a
third of all rows isn't in one task.

Defined results: a null text equals an empty one; texts are equal after runs of
ASCII white space become one space, not trimmed. Of equal texts the row with the
smallest id stays, null ids last; of rows that also share the id, one stays. Empty
tables give empty results. Names of other columns don't matter.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, mix

PROBES = 2
BITS_PER_ROW = 16
MAX_FILTER_BYTES = 64 << 20
#: Bits of one slice of the filter.
SLICE_BITS = 1 << 22
#: Hashes from which a task makes its bitmaps at once.
LOCAL_ROWS = 1 << 20
HOT = 1024
HOT_ROWS = 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, ``bits`` a power of two: rows of PROBES positions."""
    h = hashes.view(np.uint64)
    out = np.empty((len(h), PROBES), np.int64)
    for k in range(PROBES):
        out[:, k] = (mix(h + np.uint64(k + 1)) & np.uint64(bits - 1)).astype(np.int64)
    return out


def _pack(places: np.ndarray) -> bytes:
    """A sparse bitmap: the gaps between its bits, compressed."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.int64)


def bitmaps(hashes: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Slices of ``width`` bits of both bitmaps of some hashes: slice, once, twice."""
    own, count = np.unique(hashes, return_counts=True)
    both = [np.unique(_positions(h, bits)) for h in (own, own[count > 1])]
    edges = np.arange(0, bits + 1, width)
    cuts = [np.searchsorted(x, edges) for x in both]
    for k in np.flatnonzero(np.diff(cuts[0])):
        once, twice = (x[c[k] : c[k + 1]] - edges[k] for x, c in zip(both, cuts, strict=True))
        yield int(k), _pack(once), _pack(twice)


def merged(slices: Iterator[tuple[bytes, bytes]], width: int) -> np.ndarray:
    """``twice`` of one slice, from those of all tasks."""
    once, twice = np.zeros(width, bool), np.zeros(width, bool)
    for a, b in slices:
        a = _unpack(a)
        twice[a[once[a]]] = True
        twice[_unpack(b)] = True
        once[a] = True
    return np.packbits(twice, bitorder="little")


def repeated_filter(digests: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """Pass one over the column ``h`` (long): the bytes of ``twice``."""
    most = 1 << max(10, (max_filter_bytes * 8).bit_length() - 1)
    bits = min(most, 1 << max(10, (max(1, digests.count()) * BITS_PER_ROW - 1).bit_length()))
    width = min(bits, SLICE_BITS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def settle() -> pa.RecordBatch:
            k, once, twice = zip(*bitmaps(np.concatenate(held), bits, width), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["slice", "once", "twice"])

        for batch in batches:
            held.append(batch.column("h").to_numpy())
            count += len(held[-1])
            if count >= LOCAL_ROWS:
                yield settle()
                held, count = [], 0
        if count:
            yield settle()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, a.as_py(), b.as_py()) for batch in batches for k, a, b in zip(batch.column("slice").to_pylist(), batch.column("once"), batch.column("twice"), strict=True))
        for k, group in itertools.groupby(rows, lambda r: r[0]):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([merged(((a, b) for _, a, b in group), width).tobytes()], pa.binary())], names=["slice", "bits"])

    made = digests.select("h").mapInArrow(local, "slice int, once binary, twice binary")
    dealt = made.repartitionById(bits // width, "slice").sortWithinPartitions("slice")
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(merge, "slice int, bits binary").collect():  # at most ``max_filter_bytes``
        out[r.slice * width // 8 : (r.slice + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def probe(digests: DataFrame, twice: np.ndarray, out: str = "maybe", of: str = "h") -> DataFrame:
    """Pass two: ``digests`` with a flag for rows whose hash is possibly repeated."""
    sent = digests.sparkSession.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def hit(h):
        import pandas as pd

        bits = sent.value
        at = _positions(h.to_numpy(np.int64), len(bits) * 8)
        return pd.Series(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(1))

    return digests.withColumn(out, hit(of))


def decisions(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_t"))
    digests = ws.stage(norm.select("doc_id", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")), "digests")
    digests = digests.withColumn("h", F.xxhash64("sha"))
    marked = ws.stage(probe(digests, repeated_filter(digests, max_filter_bytes)).drop("h"), "marked")
    ws.drop("digests")
    alone, maybe = marked.where(~F.col("maybe")), marked.where("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    groups = ws.stage(maybe.groupBy("sha").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    groups = groups.select(F.col("sha").alias("g"), F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size")
    hot = [bytes(r.g) for r in groups.where(F.col("group_size") >= HOT_ROWS).orderBy(F.desc("group_size"), "g").limit(HOT).select("g").collect()]
    is_hot = F.col("g").isin(hot) if hot else F.lit(False)
    meets = F.col("sha") == F.col("g")
    cold = maybe.where(~F.col("sha").isin(hot)) if hot else maybe
    met = cold.join(groups.where(~is_hot), meets)
    if hot:
        met = met.unionByName(maybe.where(F.col("sha").isin(hot)).join(F.broadcast(groups.where(is_hot)), meets))
    columns = lambda keep, size, kept: ["doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    return alone.select(*columns(F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))).unionAll(met.select(*columns(F.col("keep_id"), F.col("group_size"), F.col("rid") == F.col("keep_rid"))))


def deduplicate(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, whole. Texts of rows outside the filter never shuffle."""
    made = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    digests = ws.stage(docs.select(F.col(doc_id).alias("id"), made.alias("sha")), "ids").withColumn("h", F.xxhash64("sha"))
    twice = repeated_filter(digests, max_filter_bytes)
    groups = ws.stage(probe(digests, twice).where("maybe").groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id")).alias("first")), "winners")
    ws.drop("ids")
    sha, h, maybe, group, keep = fresh(docs.columns, "sha", "h", "maybe", "group", "keep")
    winners = groups.select(F.col("sha").alias(group), F.col("first.id").alias(keep))
    rows = probe(docs.withColumn(sha, made).withColumn(h, F.xxhash64(sha)), twice, maybe, h)
    # the key has the id too: rows of one large group of copies are dealt over all tasks
    met = rows.where(maybe).join(winners, (F.col(sha) == F.col(group)) & F.col(doc_id).eqNullSafe(F.col(keep)), "left_semi").dropDuplicates([sha, doc_id])
    return rows.where(~F.col(maybe)).unionByName(met).select(*docs.columns)
