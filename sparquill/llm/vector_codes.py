"""Codes of vectors by codebooks of their parts, trained by Lloyd's rounds with Elkan's bounds.

Vectors become integers on a grid and are cut into equal parts. Each round assigns
every part to the nearest entry of its codebook and moves the entries to the means.
Between rounds the shared folder keeps, for each part of each vector, its entry, an
upper bound of its distance to that entry and one lower bound for each entry of the
codebook. When entries move, bounds shift by the distance that they moved; an entry is
compared only if neither its lower bound nor half its distance to the part's own entry
is strictly above the upper bound. Bounds are whole numbers, rounded to the safe
side, and what they leave open is settled by integer distances, so a tie is never pruned
and goes to the lower index. Tasks read and write their own rows; only sums and counts
of entries shuffle, one row for each entry from a task.

Defined results: a vector that is null, or holds null or non-finite components, is left
out, and so is one whose length isn't a positive multiple of the parts or isn't that
of the kept vector with the smallest id, and one with components so large (beyond
``limit``, about 23,000 at 64 dimensions) that squared distances exceed 61 bits. Null ids
come last among the ids, rows with one id are ordered by their vectors; repeated rows all
count. With fewer vectors than entries each is an entry. An entry without parts stays.
Empty tables give empty results. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small_batches

SCALE = 4096
#: Bytes of the grid that one numpy step holds.
STEP = 2 << 20
#: Labels whose sums are sent to all tasks; more meet their rows by a shuffle.
SENT_LABELS = 100_000


def limit(dim: int) -> int:
    """The largest component, on the grid, whose distances fit."""
    return math.isqrt((1 << 61) // (4 * dim))


def on_grid(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column, parts: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)


def floor_sqrt(d: np.ndarray) -> np.ndarray:
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def ceil_sqrt(d: np.ndarray) -> np.ndarray:
    r = floor_sqrt(d)
    return r + (r * r < d)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def assign(q: np.ndarray, book: np.ndarray, gaps: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Move each row of one part to its nearest entry, in place.

    ``gaps`` are squared distances between entries. Returns the squared distances to the
    own entries that were computed (-1: not) and how many distances that took.
    """
    own = np.full(len(q), -1, np.int64)
    took = 0

    def open_for(rows: np.ndarray, j: int) -> np.ndarray:
        u, a = upper[rows], code[rows]
        return rows[(a != j) & (u >= lower[rows, j]) & (4 * u * u >= gaps[a, j])]

    every = np.arange(len(q))
    for j in range(len(book)):
        at = open_for(every, j)
        loose = at[own[at] < 0]
        if len(loose):
            own[loose] = d = _squares(q[loose], book[code[loose]])
            upper[loose], lower[loose, code[loose]] = ceil_sqrt(d), floor_sqrt(d)
            took += len(loose)
            at = open_for(at, j)
        if len(at):
            d = _squares(q[at], book[j])
            lower[at, j] = floor_sqrt(d)
            took += len(at)
            nearer = (d < own[at]) | ((d == own[at]) & (j < code[at]))
            at, d = at[nearer], d[nearer]
            code[at], own[at], upper[at] = j, d, ceil_sqrt(d)
    return own, took


class _Rounds:
    """The passes over the vectors; ``book`` is parts x entries x width on the driver, a few kilobytes."""

    def __init__(self, book: np.ndarray, most: int):
        self.parts, self.entries, self.width = book.shape
        self.grid = np.dtype(np.int16 if most < 1 << 15 else np.int32)
        self.far = math.isqrt(4 * self.width * most * most) + 1
        self.bound = np.dtype(np.uint16 if self.far < 1 << 16 else np.uint32)
        self.rows = max(256, STEP // (self.parts * self.width * 8))

    def steps(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= self.rows:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    def fixed(self, column: pa.Array, kind: np.dtype, *shape: int) -> np.ndarray:
        _, at, data = column.cast(pa.large_binary()).buffers()
        begin = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
        return np.frombuffer(data, kind, (begin[-1] - begin[0]) // kind.itemsize, begin[0]).reshape(len(column), *shape)

    def binary(self, x: np.ndarray) -> pa.Array:
        flat = np.ascontiguousarray(x).reshape(len(x), -1)
        size = flat.shape[1] * flat.itemsize
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * size), pa.py_buffer(flat)])

    def read(self, batch: pa.RecordBatch, first: bool, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
        n, shape = len(batch), (self.parts, self.width)
        if first:
            flat = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = {"q": flat.reshape(n, *shape), "code": np.zeros((n, self.parts), np.int64), "upper": np.full((n, self.parts), self.far, np.int64), "lower": np.zeros((n, self.parts, self.entries), np.int64)}
            return {c: out[c] for c in columns}
        kinds = {"q": (self.grid, *shape), "code": (np.dtype(np.uint8), self.parts), "upper": (self.bound, self.parts), "lower": (self.bound, self.parts, self.entries)}
        return {c: self.fixed(batch.column(c), *kinds[c]).astype(np.int64) for c in columns}

    def assigned(self, rows: DataFrame, book: np.ndarray, moved: np.ndarray, first: bool, last: bool) -> DataFrame:
        """A pass of assignment: bounds shift by ``moved`` (parts x entries), parts move to their nearest entries."""
        gaps = _squares(book[:, :, None, :], book[:, None, :, :])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in self.steps(batches):
                x = self.read(batch, first, ("q", "code", "upper", "lower"))
                q, code, upper, lower = x["q"], x["code"], x["upper"], x["lower"]
                np.minimum(upper + np.take_along_axis(moved[None], code[:, :, None], 2)[:, :, 0] if len(code) else upper, self.far, out=upper)
                np.maximum(lower - moved, 0, out=lower)
                error = np.zeros(len(batch), np.int64)
                for p in range(self.parts):
                    args = q[:, p], book[p], gaps[p], np.ascontiguousarray(code[:, p]), np.ascontiguousarray(upper[:, p]), np.ascontiguousarray(lower[:, p])
                    own, _ = assign(*args)
                    code[:, p], upper[:, p], lower[:, p] = args[3:]
                    if last:
                        error += np.where(own < 0, _squares(args[0], book[p][args[3]]), own)
                ids = [batch.column("vec_id"), batch.column("label")]
                if last:
                    text = pa.array([bytes(c).hex() for c in code.astype(np.uint8)], pa.string())
                    yield pa.RecordBatch.from_arrays([*ids, text, pa.array(error)], names=["vec_id", "label", "code", "error"])
                else:
                    blobs = [self.binary(q.astype(self.grid)), self.binary(code.astype(np.uint8)), self.binary(upper.astype(self.bound)), self.binary(np.minimum(lower, np.iinfo(self.bound).max).astype(self.bound))]
                    yield pa.RecordBatch.from_arrays([*ids, *blobs], names=["vec_id", "label", "q", "code", "upper", "lower"])

        kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, "
        return rows.mapInArrow(run, kinds + ("code string, error long" if last else "q binary, code binary, upper binary, lower binary"))

    def means(self, state: DataFrame, book: np.ndarray) -> np.ndarray:
        """Entries at the floor of the mean of their parts: a task gives one row for each entry, Spark adds them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = self.parts * self.entries
            total, count = np.zeros((size, self.width), np.int64), np.zeros(size, np.int64)
            for batch in self.steps(batches):
                x = self.read(batch, False, ("q", "code"))
                slot = (x["code"] + np.arange(self.parts) * self.entries).ravel()
                count += np.bincount(slot, minlength=size)
                order = np.argsort(slot, kind="stable")
                begin = np.flatnonzero(np.diff(slot[order], prepend=-1))
                total[slot[order][begin]] += np.add.reduceat(x["q"].reshape(-1, self.width)[order], begin)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(self.width))], names=["slot", "n", *(f"s{i}" for i in range(self.width))])

        names = ["n", *(f"s{i}" for i in range(self.width))]
        sums = state.select("q", "code").mapInArrow(run, "slot long, " + ", ".join(f"{c} long" for c in names))
        out = book.copy()
        for r in sums.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).collect():  # a row for each entry
            out[r.slot // self.entries, r.slot % self.entries] = [x // r.n for x in r[2:]]
        return out


def train(vectors: DataFrame, ws: Workspace, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each kept vector, and the codebooks (parts x entries x width)."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(usable(F.col("v"), parts)).select("vec_id", "label", on_grid(F.col("v")).alias("q"))
    order = [F.col("vec_id").asc_nulls_last(), "q"]
    least = rows.select("vec_id", "q").orderBy(*order).limit(1).collect()
    dim = len(least[0].q) if least else parts
    most = lambda q: F.greatest(F.array_max(q), -F.array_min(q))
    rows = rows.where((F.size("q") == dim) & (most(F.col("q")) <= limit(dim)))
    seeds = rows.select("vec_id", "q").orderBy(*order).limit(entries).collect()
    book = np.array([r.q for r in seeds], np.int64).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)
    if not seeds:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"), book
    passes = _Rounds(book, rows.agg(F.max(most(F.col("q")))).first()[0])
    state, moved = rows, np.zeros(book.shape[:2], np.int64)
    for r in range(rounds):
        state = ws.stage(passes.assigned(state, book, moved, r == 0, False), f"state{r}")
        ws.drop(f"state{r - 1}")
        new = passes.means(state, book)
        moved, book = ceil_sqrt(_squares(new, book)), new
    out = ws.stage(passes.assigned(state, book, moved, rounds == 0, True), "coded")
    ws.drop(f"state{rounds - 1}")
    return out, book


def codebooks_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, ws: Workspace, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector."""
    coded, book = train(vectors, ws, parts, entries, rounds, vec_id, vector, label)
    totals = ws.stage(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "labels")
    sent = F.broadcast(totals) if totals.count() <= SENT_LABELS else totals
    return coded.join(sent, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book)).alias("codebooks_sha256"))
