"""Token counts by rank-synchronous merging of ragged arrays.

The bytes of a step of texts are cut into pre-tokens by whole arrays: classes of
characters, and the places where the vocabulary's pattern begins a new piece. Distinct
pieces are byte sequences in one flat array of symbols. In each round every sequence finds its lowest-rank pair and merges all its
occurrences at once, left to right; sequences without a pair left are done and
leave the array. The number of symbols that survive is the number of tokens.
This equals one-at-a-time merging because every symbol has one merge that makes
it, of a lower rank than all merges that use it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); strings of
special tokens inside a text are one token each, as the library does by default;
texts of any length are counted whole, in windows cut before white space where a
pre-token always begins. Extra columns pass through; rows with equal keys are
counted one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, gathered, small_batches

NONE = np.int32(2**31 - 1)
#: Distinct pre-tokens that a worker remembers between steps; those of one step are held whatever their number.
CACHE = 400_000
#: Bytes of one window of a long text.
WINDOW = 4 << 20
OTHER, SPACE, LETTER, NUMBER = range(4)
_CUT = re.compile(rb"(?<=[!-~])[\t-\r ]")


def character_classes() -> np.ndarray:
    """The class of each character, by its code."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    return out


def pre_tokens(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that start at ``at``; a piece ends where the next begins.

    Pieces are, in this order at each place: a contraction in small letters; a run of
    letters, of numbers or of other signs, with one blank before it; white space up to
    the last character before something else; white space.
    """
    n = len(data)
    cls = classes[data]
    leads = np.flatnonzero(data >= 0xC0)
    if len(leads):
        more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        first = more[leads]
        width = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & np.array([0, 0, 31, 15, 7], np.int32)[width]
        for k in (1, 2, 3):
            code = np.where(width > k, (code << 6) | (more[leads + k] & 63), code)
        kind = classes[code]
        cls[leads] = kind
        for k in (1, 2, 3):
            far = width > k
            cls[leads[far] + k] = kind[far]
    cut = np.zeros(n + 1, bool)
    cut[at] = cut[0] = cut[n] = True
    start = cut[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(start)
    # a blank before a run belongs to it; any other white space there stands alone
    after = run[(cls[run] != SPACE) & ~cut[run]]
    after = after[cls[after - 1] == SPACE]
    blank = data[after - 1] == 32
    start[after[blank]] = False
    start[after[blank] - 1] = True
    last = after[~blank] - 1
    for _ in range(2):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    quote = np.flatnonzero(data == 39)
    # a run of signs that begins with its quote begins with a contraction
    quote = quote[start[quote]]
    if len(quote):
        more = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = more[quote + 1], more[quote + 2]
        joined = ~cut[quote + 1]
        one = joined & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = joined & ~cut[np.minimum(quote + 2, n)] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for hit, k in ((one, 2), (two, 3)):
            start[quote[hit] + 1] = False
            then = quote[hit] + k
            then = then[then < n]
            # a run of letters goes on; before anything else a piece has its start
            start[then[cls[then] == LETTER]] = True
    return np.flatnonzero(start)


class PairTable:
    """Ranks of symbol pairs in two open tables, looked up for whole arrays."""

    BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.tables = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD):
            key = np.full(1 << self.BITS, 2**64 - 1, np.uint64)
            value = np.full(1 << self.BITS, NONE, np.int32)
            slot = self._slot(keys, seed)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], value[slot[first]] = keys[first], rank[first]
            self.tables.append((seed, key, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, rank = keys[rest], rank[rest]
            if not len(keys):
                break
        assert not len(keys), "more tables are needed"

    def _slot(self, keys: np.ndarray, seed: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(seed) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        for seed, key, value in self.tables:
            slot = self._slot(keys, seed)
            hit = key[slot] == keys
            out[hit] = value[slot[hit]]
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.table = PairTable(left, right, np.arange(len(pairs), dtype=np.int32))
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.classes = character_classes()
        self.known: dict[bytes, int] = {}

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = size.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.flatnonzero(size > 1)
        keep = np.repeat(size > 1, size)
        symbols, size = symbols[keep], size[owner]
        while len(owner):
            start = np.zeros(len(size), np.int64)
            np.cumsum(size[:-1], out=start[1:])
            last = start + size - 1
            ranks = np.full(len(symbols), NONE, np.int32)
            ranks[:-1] = self.table.ranks(symbols[:-1], symbols[1:])
            ranks[last] = NONE
            least = np.minimum.reduceat(ranks, start)
            done = least == NONE
            out[owner[done]] = size[done]
            hit = np.flatnonzero((ranks == np.repeat(least, size)) & (ranks != NONE))
            if len(hit):
                # a pair of equal symbols can overlap itself: of a run, every other one from its left
                run = np.ones(len(hit), bool)
                run[1:] = np.diff(hit) != 1
                begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
                symbols[hit] = self.merged[ranks[hit]]
            alive = np.repeat(~done, size)
            gone = np.zeros(len(symbols), np.int64)
            gone[hit + 1] = 1
            size = (size - np.add.reduceat(gone, start))[~done]
            symbols = symbols[alive & (gone == 0)]
            owner = owner[~done]
            if len(owner):
                single = size == 1
                out[owner[single]] = 1
                if single.any():
                    symbols, owner, size = symbols[~np.repeat(single, size)], owner[~single], size[~single]
        return out

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts without special strings."""
        data, at = as_bytes(texts)
        total = np.zeros(len(at), np.int64)
        a = 0
        while a < len(data):
            # a longer text is cut where white space follows something else: a piece begins there
            cut = _CUT.search(data, a + WINDOW) if len(data) - a > WINDOW else None
            b = cut.start() if cut else len(data)
            own = np.searchsorted(at, [a, b])
            begin = pre_tokens(data[a:b], at[own[0] : own[1]] - a, self.classes)
            pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, b - a).astype(np.int32)), pa.py_buffer(data[a:b])]).dictionary_encode()
            n = np.concatenate([[0], np.cumsum(self._counts_of(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()])])
            # tokens before each text, those before the window included
            total[own[0] :] += n[np.searchsorted(begin, np.clip(at[own[0] :] - a, 0, b - a))]
            a = b
        return np.diff(total)

    def _counts_of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        if new:
            known.update(zip(new, self.merge_counts(new).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        special = pa.array(np.zeros(len(texts), bool))
        for m in self.marks:
            special = pc.or_(special, pc.fill_null(pc.match_substring(texts, m), False))
        odd = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._plain(texts)
        parts = [self.special.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
        out = self._plain(pc.if_else(special, pa.scalar("", texts.type), texts))
        own = self._plain(pa.array([p for ps in parts for p in ps], texts.type))
        sizes = [len(ps) for ps in parts]
        out[odd] = np.add.reduceat(own, np.cumsum([0, *sizes[:-1]])) + np.array(sizes) - 1
        return out


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each vocabulary and worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Every row of ``docs`` without its text, plus n_bytes, n_tokens and over_limit.

    Columns of ``docs`` that have one of these names are replaced.
    """
    small_batches(docs.sparkSession)
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c not in new]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for step in gathered(batches, text):
            col = step.column(text)
            n = c.counts(col)
            sizes = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(step.column(k) for k in kept), sizes, pa.array(n), pa.array(n > limit)], names=[*kept, *new])

    return docs.select(*kept, text).mapInArrow(run, schema)
