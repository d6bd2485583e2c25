"""Token ids as Parquet list columns, for selective reads.

Documents are dealt by ranges of their id, sorted, encoded once and written by
Spark's writer: ids as a list column with a dictionary (or, with
``encoding="delta"``, delta-packed pages of the second format), row groups of
``row_group_bytes``, small pages and the page indexes that the writer adds. The
metadata columns beside the list can be read without a page of ids; a filter on
doc_id skips row groups and pages.

Files in order of ``part`` hold ascending ids. ``offset`` counts the ids of a part
before a document; ``index`` has the sums of the parts.

Defined results: a null text is empty and gives the end id alone; null ids come
first; rows that share an id are written all, ordered by a hash of their text;
special strings in a text are encoded as the library does by default.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import STEP_BYTES, Workspace, as_bytes, gathered, small_batches  # noqa: F401

#: Pieces that a worker remembers between steps; the pieces of one step are held whatever their number.
CACHE = 500_000
SPACE, LETTER, NUMBER, OTHER, WHOLE = range(5)


def _class(code: int) -> int:
    c = chr(code)
    return SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


#: Classes of the ASCII bytes, and of the characters of two bytes up to U+00FF by their place from U+0080.
_ASCII = np.array([_class(b) if b < 128 else OTHER for b in range(256)], np.uint8)
_LATIN = np.array([_class(c) for c in range(128, 256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HIGH, _BLANK = re.compile(b"[\xc4-\xff]"), re.compile(b"[\t-\r ]")


class WordEncoder:
    """The library's encodings of whole texts, each distinct piece encoded once.

    A step's bytes are cut into the pieces of the vocabulary's pattern (contractions,
    runs of letters, single numbers, runs of other signs) by whole arrays, the pieces
    dictionary-encoded, and only distinct new ones reach the library; ids are gathered
    by offsets. Merges never cross pieces, so a text's ids are those of its pieces in
    order. A word with characters beyond U+00FF, which normalisation may change, goes
    to the library whole; so does a text with special strings or control characters
    that only some call white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ends = [i for t, i in self.library.get_vocab(False).items() if t.endswith("</w>")]
        self.ends = np.zeros(max(ends) + 1, bool)
        self.ends[ends] = True
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, pieces: list[bytes], size: np.ndarray, ids: np.ndarray) -> None:
        self.rows.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def _learn(self, pieces: list[bytes]) -> None:
        plain = [p for p in pieces if not _HIGH.search(p)]
        if plain:
            # the last id of each piece, and no other, carries the mark of a word's end
            ids = np.array(self.library.encode(b" ".join(plain).decode(), add_special_tokens=False).ids, np.int32)
            end = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)] & (ids < len(self.ends))) + 1
            if len(end) == len(plain) and end[-1] == len(ids):
                self._remember(plain, np.diff(end, prepend=0), ids)
            else:
                self._one_by_one(plain)
        if len(plain) < len(pieces):
            self._one_by_one([p for p in pieces if _HIGH.search(p)])

    def _one_by_one(self, pieces: list[bytes]) -> None:
        got = self._library([p.decode() for p in pieces])
        self._remember(pieces, np.array([len(x) for x in got]), np.array([i for x in got for i in x], np.int32))

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, which of them are in a piece, and where pieces start; ``at`` has the starts of texts."""
        n = len(data)
        low = _LOWER[data]
        cls = _ASCII[low]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        wide = np.flatnonzero((low == 0xC2) | (low == 0xC3))
        if len(wide):
            cls[wide] = cls[wide + 1] = _LATIN[((low[wide] & 1) << 6) | (low[wide + 1] & 63)]
            up = wide[low[wide] == 0xC3] + 1
            low[up[(low[up] <= 0x9E) & (low[up] != 0x97)]] += 32
        inside = cls != SPACE
        high = np.flatnonzero(data >= 0xC4)
        if len(high):
            edge = np.zeros(n + 2, bool)
            edge[1:-1] = inside
            begin = np.flatnonzero(inside & (~edge[:-2] | cut[:n]))
            stop = np.flatnonzero(inside & (~edge[2:] | cut[1:])) + 1
            words = np.unique(np.searchsorted(begin, high, side="right") - 1)
            step = np.zeros(n + 1, np.int8)
            step[begin[words]] += 1
            step[stop[words]] -= 1
            whole = np.cumsum(step[:n], dtype=np.int8) > 0
            cls[whole] = WHOLE
            low[whole] = data[whole]
        start = cut[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        single = np.flatnonzero(cls == NUMBER)
        start[single[(low[single] & 0xC0) != 0x80]] = True
        start &= inside
        quote = np.flatnonzero(low == 39)
        quote = quote[start[quote] & (cls[quote] == OTHER)]
        if len(quote):
            # a contraction is taken where a run of signs begins with its quote
            more = np.concatenate([low, np.zeros(2, np.uint8)])
            a, b = more[quote + 1], more[quote + 2]
            joined = ~cut[np.minimum(quote + 1, n)]
            one = joined & np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (cls[np.minimum(quote + 1, n - 1)] == LETTER)
            two = joined & ~cut[np.minimum(quote + 2, n)] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            for hit, k in ((one, 2), (two, 3)):
                start[quote[hit] + 1] = False
                after = quote[hit] + k
                after = after[after < n]
                start[after[inside[after]]] = True
        return low, inside, np.flatnonzero(start)

    def _window(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, inside, start = self._pieces(data, at)
        place = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(place[start] - 1, place[-1:]).astype(np.int32) if len(start) else np.zeros(1, np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > CACHE:
            self._forget()
            new = words
        if new:
            self._learn(new)
        row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))[pieces.indices.to_numpy()]
        size = self.size[row]
        end = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.ids[np.arange(end[-1]) + np.repeat(self.first[row] - end[:-1], size)]
        return ids, end[np.searchsorted(start, at)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more than texts)."""
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for m in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, m))
        odd = pc.fill_null(odd, False)
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(alone):
            strings = texts.take(pa.array(alone)).to_pylist()
            texts = pc.if_else(odd, pa.scalar("", texts.type), texts)
        data, at = as_bytes(texts)
        ids, begin = [], np.zeros(len(at), np.int64)
        a = held = 0
        while a < len(data):
            # a longer text is cut before white space of one byte
            cut = _BLANK.search(data, a + STEP_BYTES) if len(data) - a > STEP_BYTES else None
            b = cut.start() if cut else len(data)
            own = np.searchsorted(at, [a, b], side="left")
            got, first = self._window(data[a:b], at[own[0] : own[1]] - a)
            begin[own[0] : own[1]] = held + first
            ids.append(got)
            held += len(got)
            a = b
        begin[np.searchsorted(at, len(data), side="left") :] = held
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if len(alone):
            parts = [flat[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
            for i, x in zip(alone, self._library(strings), strict=True):
                parts[i] = np.array(x, np.int32)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            flat = np.concatenate(parts)
        return flat, begin


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", parts: int | None = None, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """Encode and write; nothing is kept on the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, offset = encoder(vocabulary), 0
        part_no = TaskContext.get().partitionId()
        for step in gathered(batches, "text"):
            ids, begin = enc.encode(step.column("text"))
            n = np.diff(begin) + 1
            at = np.concatenate([[0], np.cumsum(n)])
            flat = np.full(at[-1], end_id, np.int32)
            own = np.ones(len(flat), bool)
            own[at[1:] - 1] = False
            flat[own] = ids
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part_no, np.int32)), step.column("doc_id"), pa.array(offset + at[:-1]), pa.array(n), lists], schema=pa.schema([("part", pa.int32()), ("doc_id", step.column("doc_id").type), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", lists.type)]))
            offset += int(at[-1])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # many rows with one id are dealt by their texts, too
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    writer = dealt.mapInArrow(run, schema).write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def part_starts(tokens: DataFrame) -> DataFrame:
    """``part`` and the number of ids before it: reads two small columns, has a row for each part."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of written files."""
    import zlib

    small_batches(tokens.sparkSession)
    schema = T.StructType([tokens.schema["part"], tokens.schema["doc_id"], tokens.schema["offset"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = tokens.select("part", "doc_id", "offset", "ids").mapInArrow(run, schema)
    return rows.join(part_starts(tokens), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
