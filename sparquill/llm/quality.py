"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so pairwise interactions cost time linear in the features of a text.

Features of a text: its distinct words, lower-cased and hashed (together of length
1), structure statistics (shares of upper case, digits, symbols, shouted and
symbol-laden words, repeated words and lines, lengths) as buckets, and numeric
metadata columns as logarithmic buckets. The whole text is read.

The model is fitted on at most ``sample`` labelled rows, those with the smallest
hash of their id, whose features together have at most ``sample_bytes``: bounds of
this operator, not of the corpus. All rows are scored.

Defined results: a null or empty text has no words and is scored by its structure
buckets; without any labelled row every score is 0.5; a null metadata value has no
feature; labels that contradict each other for one id count as their maximum;
repeated rows get equal scores. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, as_bytes, lower_ascii, mix, small_batches, text_steps, word_hashes, word_spans

WORD_BITS = 15
STATS = 16
BUCKETS = 12
META_BUCKETS = 40
#: Weight of a structure bucket beside the unit length of the words together.
STAT_VALUE = 0.4
SAMPLE = 6000
#: Bytes of features that come to the driver; one row has at most 8 for each slot of the model.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that the model never learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def features(texts: pa.Array, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and row offsets of the features of some texts."""
    data, at = as_bytes(texts)
    n = len(at) - 1
    starts, ends, first = word_spans(data, at)
    low = lower_ascii(data)
    owner = np.repeat(np.arange(n), np.diff(first))
    slot = (word_hashes(low, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.unique((owner.astype(np.int64) << WORD_BITS) | slot)
    w_owner, w_index = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(w_owner, minlength=n)
    w_value = (1 / np.sqrt(np.maximum(distinct, 1)))[w_owner]

    size = np.maximum(np.diff(at), 1)
    words = np.diff(first)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    high = data >= 128
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 44) | (data == 46)
    symbol = ~(upper | lower | high | digit | space | stop)
    line = data == 10
    per = [_sums(x, at[:-1], at[1:]) for x in (upper, digit, symbol, line, high, stop)]
    w_upper, w_lower, w_symbol = (_sums(x, starts, ends) for x in (upper, lower, symbol))
    shouted = np.bincount(owner[(w_upper > 1) & (w_lower == 0)], minlength=n)
    marked = np.bincount(owner[w_symbol > 0], minlength=n)
    bare = np.bincount(owner[w_symbol == ends - starts], minlength=n)
    capital = np.bincount(owner[(w_upper > 0) & (w_lower > 0)], minlength=n)
    many = np.maximum(words, 1)
    # lines that repeat within the text
    edge = np.union1d(np.flatnonzero(line) + 1, at[:-1])
    edge = edge[edge < len(data)] if len(data) else np.zeros(0, np.int64)
    l_owner = np.searchsorted(at, edge, side="right") - 1
    l_hash = word_hashes(data, edge, np.append(edge[1:], len(data))) if len(edge) else np.zeros(0, np.uint64)
    lines = np.bincount(l_owner, minlength=n)
    l_key = np.unique(mix(l_hash + mix(l_owner.astype(np.uint64))), return_index=True)[1] if len(edge) else np.zeros(0, np.int64)
    l_distinct = np.bincount(l_owner[l_key], minlength=n)
    shares = [
        per[0] / size, per[1] / size, per[2] / size, per[4] / size, per[5] / many, shouted / many, marked / many, bare / many,
        capital / many, distinct / many, l_distinct / np.maximum(lines, 1), per[3] / many,
    ]
    scaled = [np.clip(np.ceil(np.sqrt(np.clip(x, 0, 1)) * (BUCKETS - 1)), 0, BUCKETS - 1) for x in shares]
    scaled += [np.clip(np.log2(x + 1), 0, BUCKETS - 1) for x in (words / 2, np.diff(at) / many, many / np.maximum(lines, 1), size / 8)]
    base = 1 << WORD_BITS
    s_index = np.stack([base + k * BUCKETS + x.astype(np.int64) for k, x in enumerate(scaled)], axis=1)
    base += STATS * BUCKETS
    rows = [(w_owner, w_index, w_value), (np.repeat(np.arange(n), STATS), s_index.ravel(), np.full(n * STATS, STAT_VALUE))]
    for k, x in enumerate(meta):
        there = np.flatnonzero(np.isfinite(x))
        bucket = np.clip(np.log2(np.abs(x[there]) + 1), 0, META_BUCKETS - 1).astype(np.int64)
        rows.append((there, base + k * META_BUCKETS + bucket, np.full(len(there), STAT_VALUE)))
    owner, index, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(owner, kind="stable")
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return index[order].astype(np.int32), value[order].astype(np.float32), offsets


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Linear time: one pass over the features for both sums of each factor."""
        if len(offsets) == 1:
            return np.zeros(0)
        vx = self.factors[index] * value[:, None]
        one = np.add.reduceat(vx, offsets[:-1])
        two = np.add.reduceat(vx * vx, offsets[:-1])
        return self.bias + np.add.reduceat(self.weights[index] * value, offsets[:-1]) + 0.5 * (one * one - two).sum(1)

    def score(self, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*x), -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, labels: np.ndarray, size: int, rank: int = 8, epochs: int = 16, step: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over shuffled small batches; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    w = np.zeros(size, np.float32)
    v = (rng.normal(0, 0.02, (size, rank)) * (len(labels) > 0)).astype(np.float32)
    p = np.clip(labels.mean(), 0.02, 0.98) if len(labels) else 0.5
    m = Machine(float(np.log(p / (1 - p))), w, v)
    gw, gv, gb = np.full(size, 1e-4, np.float32), np.full((size, rank), 1e-4, np.float32), 1e-4
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            count = offsets[rows + 1] - offsets[rows]
            at = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(count, out=at[1:])
            pick = np.repeat(offsets[rows] - at[:-1], count) + np.arange(at[-1])
            i, x = index[pick], value[pick]
            vx = v[i] * x[:, None]
            one = np.add.reduceat(vx, at[:-1])
            raw = m.bias + np.add.reduceat(w[i] * x, at[:-1]) + 0.5 * (one * one - np.add.reduceat(vx * vx, at[:-1])).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(slope, count).astype(np.float32)
            # features of the batch, each once
            own, back = np.unique(i, return_inverse=True)
            dw = np.zeros(len(own), np.float32)
            dv = np.zeros((len(own), rank), np.float32)
            np.add.at(dw, back, each * x)
            np.add.at(dv, back, (each * x)[:, None] * (np.repeat(one, count, 0) - vx))
            dw += decay * w[own]
            dv += decay * v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            w[own] -= step * dw / np.sqrt(gw[own])
            v[own] -= step * dv / np.sqrt(gv[own])
            db = float(slope.sum())
            gb += db * db
            m.bias -= step * db / np.sqrt(gb)
    return m


def _meta(part: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def model_size(metadata: list[str]) -> int:
    return (1 << WORD_BITS) + STATS * BUCKETS + len(metadata) * META_BUCKETS


def train(docs: DataFrame, labels: DataFrame, metadata: list[str], doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Fit on at most ``sample`` labelled rows that aren't held out, and of them on the first that have ``sample_bytes``."""
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, text):
                index, value, at = features(part.column(text), _meta(part, metadata))
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), pa.array(cut(index), pa.binary()), pa.array(cut(value), pa.binary())], names=["id", "label", "i", "v"])

    # the broadcast side has ``sample`` rows of two numbers at most
    rows = docs.select(F.col(doc_id).alias("_id"), text, *metadata).join(F.broadcast(known), "_id")
    id_type = docs.schema[doc_id].dataType.simpleString()
    ws = Workspace(spark, "quality")
    made = ws.stage(rows.mapInArrow(run, f"id {id_type}, label int, i binary, v binary"), "features")
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("i", "v")]
    size = made.select((F.octet_length("i") + F.octet_length("v")).alias("b"), *(c.alias(f"k{n}") for n, c in enumerate(order))).orderBy("k0", "k1", "k2").limit(sample).collect()
    fit_in = int(np.searchsorted(np.cumsum([r.b for r in size]), sample_bytes, side="right"))
    got = sorted(made.orderBy(*order).limit(fit_in).collect(), key=lambda r: (r.id, r.i, r.v))
    ws.close()
    index = np.frombuffer(b"".join(r.i for r in got), np.int32)
    value = np.frombuffer(b"".join(r.v for r in got), np.float32)
    at = np.zeros(len(got) + 1, np.int64)
    np.cumsum([len(r.i) // 4 for r in got], out=at[1:])
    return fit(index, value, at, np.array([r.label for r in got], np.float32), model_size(metadata))


def score(docs: DataFrame, model: Machine, metadata: list[str], text: str = "text", keep_text: bool = False, out: str = "score") -> DataFrame:
    """Rows of ``docs`` with a score from 0 to 1; the model has a fixed size and is sent once to each executor."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c != out and (keep_text or c != text)]
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    columns = list(dict.fromkeys([*kept, text, *metadata]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, text):
                got = sent.value.score(*features(part.column(text), _meta(part, metadata)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(got.astype(np.float64))], names=[*kept, out])

    return docs.select(*columns).mapInArrow(run, schema)
