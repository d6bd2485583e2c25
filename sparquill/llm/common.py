"""Shared pieces: staged tables, bounded Arrow batches, vectorised word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: Bytes of text that one numpy step holds, whatever the size of an Arrow batch.
STEP_BYTES = 4 << 20
#: Rows that the JVM hands to Python at once; very long texts then stay within memory.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows; text columns otherwise put 10,000 long rows in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as no column has in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


_SCRATCH: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


class Workspace:
    """Staged tables in the folder that all executors share (``shared_folder``).

    A result may read them until the session ends, when Hadoop removes the folder;
    ``close`` removes it at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        fs, at = self._at(self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        held = _SCRATCH.get()
        if held is not None:
            held.append(self)

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write, then read again: later steps neither recompute nor depend on lost executors."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove staged tables that nothing reads any more."""
        for name in names:
            fs, at = self._at(self.path(name))
            fs.delete(at, True)

    def close(self) -> None:
        fs, at = self._at(self.root)
        fs.delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Workspaces that this thread makes inside are removed at the end: for steps whose result is written there."""
    held: list[Workspace] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for ws in held:
            ws.close()


def text_steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < len(sizes):
        yield batch.slice(first)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined, and split, so that each one's texts hold about ``limit`` bytes; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for part in text_steps(batch, column, limit):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and total + n > limit:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held, total = [], 0
            held.append(part)
            total += n
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of each (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_U = np.uint64
_P = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_INV = tuple(_U(pow(int(p), -1, 1 << 64)) for p in _P)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)

        def row(p):
            x = np.full(size, p, _U)
            x[0] = 1
            return np.cumprod(x, dtype=_U)

        _POWERS[:] = [(row(p), row(q)) for p, q in zip(_P, _INV, strict=True)]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text.

    Words never reach over the end of a text.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.empty(len(data) + 1, bool)
    edge[:-1] = inside
    edge[-1] = False
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(edge & (~before | cut))
    ends = np.flatnonzero(before & (~edge | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from two rolling polynomials with different bases."""
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    one = data.astype(_U) + _U(1)
    sums = np.zeros(len(data) + 1, _U)
    for k, (up, down) in enumerate(_powers(len(data) + 1)):
        np.cumsum(one * up[: len(data)], out=sums[1:])
        out = mix(out + (sums[ends] - sums[starts]) * down[starts] + _U(k))
    return mix(out ^ (ends - starts).astype(_U))
