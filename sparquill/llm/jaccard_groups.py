"""N-gram Jaccard join by a token-group matrix: exact components of similar texts.

Texts become sets of hashed word shingles; equal sets become one class. Then

1. *Groups.* Sets that share their smallest hash form a cluster; so do those that
   share the smallest of a second hash, where there are many. A cluster is dealt into
   blocks of bounded size, a task each, and links within a block are found exactly by
   counting tokens in common. Only links leave a task, at most one for each set, so a
   family of near copies makes no table of its pairs. In a cluster of several blocks
   most sets of a block are one component; the others, and a few of its own, then meet
   all sets of all blocks. That copies few sets, joins the blocks of a family of any
   size, and compares the others with their whole cluster; where it would copy many
   sets, the cluster is left to step 2.
2. *Matrix.* In one order of all tokens (frequent ones last) two sets that link
   share one of their first ``d + 1`` tokens, d the most that either may miss, and
   if they share them all but few: with a and b the first counts and o the overlap
   that the sizes need, at least min(a - (n_q - o), b - (n_s - o)). Each group, a
   part of one component and block, stores the union of its members' first tokens (the
   bound needs no others): a row of the matrix for each token and group. A set joined
   with the matrix counts its tokens in each group of another component and block; only
   groups that reach the bound are opened. Tokens with many rows and groups are dealt
   over several tasks. What is opened is one row for each pair of groups: of two
   components the best pairs first, the others only if that doesn't join the two. A
   task holds one group, the members of those that meet it pass by, whole, and only
   links leave, so two large families that don't link make no table of their pairs.
3. Links of all steps give components by repeated hooking to the smallest id.

Nothing is dropped: pairs that step 1 doesn't compare are left to the matrix; order,
groups and filters only decide what is compared first or need not be compared.
Frequent tokens are a bounded list that shapes the order.

Defined results: texts without words (or null) have no set and link with nothing;
texts of fewer words than a shingle are one shingle; letters A-Z are compared in
lower case. Ids are whole numbers (or text of such); other ids raise an error. A row's
component is the smallest id that links reach. Rows with one id are one node with the
links of all of them; rows with a null id have no component. Empty tables give empty
results; extra columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, lower_ascii, mix, small_batches, text_steps, word_hashes, word_spans

_U = np.uint64
#: Sets and tokens of one block.
BLOCK_ROWS = 4096
BLOCK_TOKENS = 1_000_000
#: Sets that share a second hash from which they are a cluster, too.
LARGE = 32
#: Rows of a token from which it counts as frequent, and how many such tokens order the rest.
FREQUENT = 64
FREQUENT_MOST = 1 << 17
#: Bits of a filter of ids: four or more for each id, within these powers of two.
FILTER_BITS = (16, 28)
#: Pairs of rows and groups of one token from which it is dealt over tasks.
TOKEN_PAIRS = 2_000_000
#: Sets of the main component of a block that meet the other blocks.
SCOUTS = 16
#: Copies that sets may have for it, for each set of their cluster.
COPIES = 2
#: Sets of one component in a group of the matrix.
MATRIX_GROUP = 64
#: Pairs of groups of two components that are compared before all others.
TRY_FIRST = 4
#: Sets that pass by a group in one task.
PASSING = 4096


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, at = as_bytes(texts)
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, at)
    words = word_hashes(low, starts, ends)
    step = _U(0x9DDFEA08EB382D69)

    def fold(columns: list[np.ndarray]) -> np.ndarray:
        s = np.full(len(columns[0]), len(columns), _U)
        for c in columns:
            s = mix(s * step + c)
        return s

    whole = fold([words[j : len(words) - k + 1 + j] for j in range(k)]) if len(words) >= k else np.zeros(0, _U)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(fold([words[j : j + 1] for j in range(a, b)]))
        else:
            out.append(np.zeros(0, _U))
    return out


def missable(n, percent: int):
    """Tokens of a set of n that a similar one may lack."""
    return n - (percent * n + 99) // 100


class Frequent:
    """A set of tokens: a bitmap of their low bits, then the tokens themselves."""

    MASK = _U((1 << 22) - 1)

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.sort(tokens)
        self.flags = np.zeros(int(self.MASK) + 1, bool)
        self.flags[(self.tokens & self.MASK).astype(np.int64)] = True

    def among(self, s: np.ndarray) -> np.ndarray:
        out = self.flags[(s & self.MASK).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
            out[at] = self.tokens[place] == s[at]
        return out


def first_tokens(s: np.ndarray, percent: int, frequent: Frequent | None = None) -> np.ndarray:
    d = missable(len(s), percent)
    if frequent is None:
        return s[: d + 1]
    last = frequent.among(s)
    return np.concatenate([s[~last][: d + 1], s[last]])[: d + 1]


#: What a set is mixed with before its smallest hash is taken, for each cluster key after the first.
_SALTS = (0xA5A5F00DCAFE1234, 0x3C6EF372FE94F82B, 0x510E527FADE682D1)


def cluster_key(s: np.ndarray, i: int) -> int:
    """The smallest hash of a set, for i = 1 and more under another hash."""
    return int((mix(s ^ _U(_SALTS[i - 1])).min() if i else s[0]).view(np.int64))


def cluster_keys(sets: list[np.ndarray], keys: int) -> list[pa.Array]:
    return [pa.array([cluster_key(s, i) if len(s) else None for s in sets], pa.int64()) for i in range(keys)]


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_table(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, fingerprint (f1, f2), the two cluster hashes and the first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                sets = shingles(part.column("text"), k)
                keys = [_i64(first_tokens(s, percent)) if len(s) else np.zeros(0, np.int64) for s in sets]
                at = np.zeros(len(keys) + 1, np.int32)
                np.cumsum([len(x) for x in keys], out=at[1:])
                f1 = np.array([s.sum(dtype=_U) for s in sets], _U)
                f2 = np.array([mix(s + _U(77)).sum(dtype=_U) for s in sets], _U)
                n = pa.array([len(s) for s in sets], pa.int64())
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(_i64(f1)), pa.array(_i64(f2)), *cluster_keys(sets, 2), pa.ListArray.from_arrays(pa.array(at), flat)], names=["doc_id", "n", "f1", "f2", "k1", "k2", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, k1 long, k2 long, keys array<long>")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids of a bounded size; it may hold more ids, never fewer."""
    least, most = FILTER_BITS
    bits = min(most, max(least, (4 * max(1, ids.count()) - 1).bit_length()))
    block = 1 << 12
    h = F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("h").to_numpy()
            for b in np.unique(x // block):
                held.setdefault(int(b), np.zeros(block, bool))[x[x // block == b] % block] = True
        for b, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["b", "bits"])

    got = ids.select(h.alias("h")).distinct().repartition(16, F.floor(F.col("h") / block)).mapInArrow(run, "b int, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in got:
        out[r.b * (block // 8) : (r.b + 1) * (block // 8)] |= np.frombuffer(r.bits, np.uint8)
    return out


def scan_sets(docs: DataFrame, k: int, keep: np.ndarray, doc_id: str, text: str, key: int = 0) -> DataFrame:
    """Whole sets of (at least) the texts whose ids are in a filter: doc_id, key (the cluster key of that number), tokens (binary)."""
    sent = docs.sparkSession.sparkContext.broadcast(keep)
    bits = len(keep) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = sent.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            there = (flags[h >> 3] >> (h & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(there.astype(bool)))
            for part in text_steps(batch, "text"):
                sets = shingles(part.column("text"), k)
                full = np.array([len(s) > 0 for s in sets], bool)
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").filter(pa.array(full)), pa.array([cluster_key(s, key) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                        names=["doc_id", "set_key", "tokens"],
                    )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    return rows.mapInArrow(run, "doc_id long, set_key long, tokens binary")


def group_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Components of some sets, as the position of one member: every link among them is counted exactly."""
    m = len(sets)
    label = np.full(m, -1, np.int64)
    if m == 2:
        a, b = sets
        o = len(np.intersect1d(a, b, assume_unique=True))
        return np.array([0, 0 if 100 * o >= percent * (len(a) + len(b) - o) else 1])
    size = np.array([len(s) for s in sets], np.int64)
    at = np.zeros(m + 1, np.int64)
    np.cumsum(size, out=at[1:])
    vocabulary, token = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(vocabulary), np.int64)
    left = np.arange(m)
    flat, flat_at = token, at
    for p in range(m):
        if label[p] >= 0:
            continue
        label[p] = p
        queue = [p]
        while queue:
            # members that have a component leave the array
            still = label[left] < 0
            if not still.any():
                break
            if still.mean() < 0.7:
                keep = np.repeat(still, np.diff(flat_at))
                flat, left = flat[keep], left[still]
                flat_at = np.zeros(len(left) + 1, np.int64)
                np.cumsum(size[left], out=flat_at[1:])
                still = np.ones(len(left), bool)
            q = queue.pop()
            own = token[at[q] : at[q + 1]]
            mark[own] = 1
            o = np.add.reduceat(mark[flat], flat_at[:-1])
            mark[own] = 0
            found = left[still & (100 * o >= percent * (size[q] + size[left] - o))]
            label[found] = p
            queue.extend(found.tolist())
    return label


def clusters_of(reps: DataFrame, key: str, least: int) -> DataFrame:
    """key, blocks of clusters with ``least`` sets or more."""
    g = reps.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("t")).where(F.col("m") >= least)
    return g.select(key, F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("int").alias("blocks"))


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks.cast("long"))


def cluster_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, key: str, k: int, percent: int, ws: Workspace, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """a, b: links that join similar sets of one cluster; token: tokens that are frequent in one.

    And the sets (doc_id) that were compared with their whole cluster, none if no
    cluster has several blocks. Sets of one block were compared with each other.
    """
    c = clusters.withColumnRenamed(key, "_key")
    own = reps.select("doc_id", F.col(key).alias("key")).join(c, F.col("key") == F.col("_key")).select("doc_id", "key", "blocks")
    number = int(key[1:]) - 1
    sets = scan_sets(docs, k, id_filter(own, "doc_id"), doc_id, text, number).join(c, F.col("set_key") == F.col("_key"))
    out = ws.stage(linked(sets.select(F.col("set_key").alias("key"), block_of(F.col("blocks")).alias("pair"), "doc_id", "tokens"), percent), f"{key}-blocks")
    if not clusters.where("blocks > 1").head(1):
        return out, None
    links = out.where("a IS NOT NULL").select("a", F.col("b").alias("root"))
    big = own.where("blocks > 1").join(links, F.col("doc_id") == F.col("a"), "left")
    big = ws.stage(big.select("doc_id", "key", "blocks", block_of(F.col("blocks")).alias("block"), F.coalesce("root", "doc_id").alias("root")), f"{key}-big")
    sizes = big.groupBy("key", "block", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy(F.col("key").alias("m_key"), F.col("block").alias("m_block")).agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    order = Window.partitionBy("key", "block", "root").orderBy(F.xxhash64("doc_id", F.lit(3)))
    roles = big.join(main, (F.col("key") == F.col("m_key")) & (F.col("block") == F.col("m_block"))).withColumn("place", F.row_number().over(order))
    roles = ws.stage(roles.select("doc_id", "key", "blocks", "block", ((F.col("root") != F.col("main")) | (F.col("place") <= SCOUTS)).alias("moves")), f"{key}-roles")
    load = roles.groupBy(F.col("key").alias("l_key")).agg(F.count("*").alias("m"), F.count(F.when(F.col("moves"), 1)).alias("n"), F.first("blocks").alias("b")).where(F.col("n") * (F.col("b") - 1) <= F.col("m") * COPIES)
    chosen = ws.stage(roles.join(load.select("l_key"), F.col("key") == F.col("l_key"), "left_semi"), f"{key}-chosen")
    if not chosen.head(1):
        return out, None
    places = F.when(F.col("moves"), F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).otherwise(F.array("block"))
    at = chosen.select(F.col("doc_id").alias("id"), "key", F.explode(places).alias("pair"))
    sets = scan_sets(docs, k, id_filter(chosen, "doc_id"), doc_id, text, number)
    met = sets.join(at, (F.col("doc_id") == F.col("id")) & (F.col("set_key") == F.col("key"))).select("key", "pair", "doc_id", "tokens")
    return out.unionByName(ws.stage(linked(met, percent), f"{key}-across")), chosen.where("moves").select("doc_id").distinct()


def linked(rows: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(ids) < 2:
                return
            label = group_labels(sets, percent)
            own = np.array(ids, np.int64)
            link = np.flatnonzero(own[label] != own)
            frequent = np.zeros(0, np.int64)
            if len(sets) > FREQUENT:
                token, count = np.unique(np.concatenate(sets), return_counts=True)
                frequent = _i64(token[count > FREQUENT])
            if len(link) or len(frequent):
                none = lambda n: pa.nulls(n, pa.int64())
                a, b = (pa.concat_arrays([pa.array(x), none(len(frequent))]) for x in (own[link], own[label[link]]))
                yield pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([none(len(link)), pa.array(frequent)])], names=["a", "b", "token"])

        for batch in batches:
            keys, pairs, own, blobs = batch.column("key").to_pylist(), batch.column("pair").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tokens")
            for i in range(len(own)):
                if key != (keys[i], pairs[i]):
                    yield from flush()
                    ids, sets = [], []
                    key = (keys[i], pairs[i])
                ids.append(own[i])
                sets.append(np.frombuffer(blobs[i].as_buffer(), _U).copy())
        yield from flush()

    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "doc_id").mapInArrow(run, "a long, b long, token long")


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, root for every end of ``edges`` (a, b): root is the smallest id of its component."""
    live = ws.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-e0")
    roots = ws.stage(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), f"{name}-r0")
    turn = 0
    while live.head(1):
        hook = live.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "from")
        # a hook may lead to a node that hooks itself: follow it once
        far = hook.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        hook = ws.stage(hook.join(far, F.col("to") == F.col("mid"), "left").select("from", F.coalesce("end", "to").alias("to")), f"{name}-h{turn}")
        to = lambda c: hook.select(F.col("from").alias(f"f_{c}"), F.col("to").alias(f"t_{c}"))  # noqa: E731, B023
        moved = live.join(to("a"), F.col("a") == F.col("f_a"), "left").join(to("b"), F.col("b") == F.col("f_b"), "left")
        moved = moved.select(F.coalesce("t_a", "a").alias("x"), F.coalesce("t_b", "b").alias("y")).where("x != y")
        roots_next = roots.join(to("a"), F.col("root") == F.col("f_a"), "left").select("node", F.coalesce("t_a", "root").alias("root"))
        turn += 1
        new = ws.stage(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), f"{name}-e{turn}")
        roots = ws.stage(roots_next, f"{name}-r{turn}")
        ws.drop(f"{name}-e{turn - 1}", f"{name}-r{turn - 1}", f"{name}-h{turn - 1}")
        live = new
    return roots


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def tokens_needed(n: Column, low: Column, high: Column, percent: int) -> Column:
    """First tokens that a set of n shares at least with one of low to high (both n or more) that links."""
    miss = lambda x: x - F.floor((F.lit(percent) * x + 99) / 100)
    one = miss(n) + 1 - (n - overlap_needed(n, low, percent))
    two = miss(high) + 1 - (high - overlap_needed(n, high, percent))
    # rounding makes it rise at some sizes; what it exceeds, without rounding, only falls
    least = F.floor(F.lit(percent) * (n * 100 - high * percent) / F.lit(100 * (100 + percent))) + 1
    return F.greatest(F.lit(1), F.least(one, F.when(low == high, two).otherwise(least)))


@dataclass
class Families:
    """Classes of equal sets, what links blocks of clusters, and one row for each class.

    ``near`` has doc_id, n, comp, what it was compared with (``marks``), blocks and the payload columns of the table.
    """

    table: DataFrame
    classes: DataFrame
    edges: DataFrame
    near: DataFrame
    grouped: DataFrame
    marks: list[str]


SAME = ["n", "f1", "f2"]


def _meets() -> Column:
    return (F.col("n") == F.col("c_n")) & (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2"))


def families(docs: DataFrame, table: DataFrame, payload: list[str], keys: int, ws: Workspace, words: int, percent: int, doc_id: str, text: str) -> Families:
    """Step 1 of the join, over a staged table of doc_id, n, f1, f2, cluster keys (k1, k2, ...) and the payload."""
    names = [f"k{i + 1}" for i in range(keys)]
    some = table.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = ws.stage(some.groupBy(*SAME).agg(F.min("doc_id").alias("rep")), "classes")
    cls = classes.select(*(F.col(c).alias(f"c_{c}") for c in SAME), "rep")
    member = ws.stage(some.select("doc_id", *SAME).join(cls, _meets()).select("doc_id", "rep").distinct(), "member")
    reps = ws.stage(some.join(cls, _meets() & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["doc_id", *SAME]).select("doc_id", "n", *names, *payload), "reps")

    clusters, grouped, all_of = {}, None, {}
    for k in names:
        clusters[k] = ws.stage(clusters_of(reps, k, LARGE if grouped else 2), f"clusters_{k}")
        if grouped is None or clusters[k].head(1):
            more, all_of[k] = cluster_links(docs, reps, clusters[k], k, words, percent, ws, doc_id, text)
            grouped = grouped.unionByName(more) if grouped else more
    rep_of = lambda e: e.join(member.select(F.col("doc_id").alias("da"), F.col("rep").alias("ra")), F.col("a") == F.col("da")).join(member.select(F.col("doc_id").alias("db"), F.col("rep").alias("rb")), F.col("b") == F.col("db")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    edges = ws.stage(rep_of(grouped.where("a IS NOT NULL").select("a", "b")), "edges1")
    # rows with one id in several classes are one node
    twice = member.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("id"))
    edges = edges.unionByName(member.join(twice, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(edges, ws, "cc1")

    # c1, c2, ... name the blocks of a set; k1, k2, ... its clusters of several blocks; whole says with which of these (bits) it was compared
    near = reps.join(roots, F.col("doc_id") == F.col("node"), "left").withColumn("whole", F.lit(0))
    marks = []
    for bit, k in enumerate(names):
        near = near.join(clusters[k].select(F.col(k).alias(f"_{k}"), F.col("blocks").alias(f"_b{k}")), F.col(k) == F.col(f"_{k}"), "left")
        if all_of.get(k) is not None:
            near = near.join(all_of[k].select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left").withColumn("whole", F.col("whole") + F.when(F.col("_id").isNotNull(), 1 << bit).otherwise(0)).drop("_id")
        marks += [F.when(F.col(f"_b{k}") > 1, F.col(k)).alias(k), F.when(F.col(f"_{k}").isNotNull(), F.xxhash64(k, block_of(F.col(f"_b{k}")))).alias(f"c{k[1:]}")]
    near = near.select("doc_id", "n", F.coalesce("root", "doc_id").alias("comp"), *marks, "whole", F.coalesce("_bk1", F.lit(1)).alias("blocks"), *payload)
    return Families(table, cls, edges, ws.stage(near, "near"), grouped, [*(c for k in names for c in (k, f"c{k[1:]}")), "whole"])


def in_groups(near: DataFrame, marks: list[str]) -> DataFrame:
    """``near`` with ``gid``: a group is a part of one component and lies in one block of its cluster."""
    sizes = near.groupBy("comp").agg(F.count("*").alias("members")).select(F.col("comp").alias("c"), "members")
    # the number of parts is a multiple of that of blocks
    parts = F.ceil(F.col("members") / (MATRIX_GROUP * F.col("blocks"))) * F.col("blocks")
    near = near.join(sizes, F.col("comp") == F.col("c")).withColumn("part", block_of(parts).cast("int")).drop("c", "members")
    # a group by its hash: if two had one, both would be opened together
    return near.withColumn("gid", F.xxhash64("comp", "part", *marks))


def shared_tokens(near: DataFrame, column: str, ws: Workspace, name: str) -> DataFrame:
    """token, rows: tokens that sets of several components have."""
    tokens = near.select("comp", F.explode(column).alias("token"))
    return ws.stage(tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo != hi").select("token", "rows"), name)


def uncompared(marks: list[str]) -> Column:
    """Whether a row and one whose columns begin with g_ weren't compared in step 1."""
    in_block = lambda i: F.coalesce(F.col(f"c{i}") == F.col(f"g_c{i}"), F.lit(False))
    in_cluster = lambda i: F.coalesce((F.col(f"k{i}") == F.col(f"g_k{i}")) & (F.col("whole").bitwiseOR(F.col("g_whole")).bitwiseAND(1 << (i - 1)) != 0), F.lit(False))
    return ~functools.reduce(Column.__or__, (f(i + 1) for i in range(len(marks) // 2) for f in (in_block, in_cluster)))


def meeting(rows: DataFrame, marks: list[str], percent: int, ws: Workspace) -> DataFrame:
    """Rows (doc_id, n, comp, gid, marks, token) beside each group with their token that is of another component, wasn't compared with them and may fit by size.

    The row's group is ``own``, the other ``gid`` with ``low`` and ``high``, the sizes of its members with the token.
    """
    matrix = rows.groupBy(F.col("token").alias("g_token"), "gid").agg(F.min("n").alias("low"), F.max("n").alias("high"), *(F.first(c).alias(f"g_{c}") for c in ("comp", *marks)))
    matrix = ws.stage(matrix, "matrix")
    rows = rows.withColumnRenamed("gid", "own")
    # a token with many rows and groups is dealt over tasks: its groups go to all of them, each row to one
    many = rows.groupBy(F.col("token").alias("h_token")).agg(F.count("*").alias("r")).where(F.col("r") > FREQUENT)
    many = many.join(matrix.groupBy(F.col("g_token").alias("h_g")).agg(F.count("*").alias("g")), F.col("h_token") == F.col("h_g")).where(F.col("r") * F.col("g") > TOKEN_PAIRS)
    hot = ws.stage(many.select("h_token", F.least(F.col("r"), F.ceil(F.col("r") * F.col("g") / TOKEN_PAIRS)).cast("int").alias("salts")), "hot")
    salted = rows.join(hot, F.col("token") == F.col("h_token"), "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("h_token", "salts")
    spread = matrix.join(hot, F.col("g_token") == F.col("h_token"), "left").withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("h_token", "salts")
    largest = F.least(F.col("high"), F.floor(F.col("n") * 100 / percent))
    return salted.join(spread, (F.col("token") == F.col("g_token")) & (F.col("salt") == F.col("g_salt")) & (F.col("comp") != F.col("g_comp")) & uncompared(marks) & (largest >= F.col("n")) & (F.col("low") * percent <= F.col("n") * 100))


def pairs_of_groups(met: DataFrame) -> DataFrame:
    """ga, gb, ca, cb, c from rows of own, gid, comp, g_comp, c: a row for each pair of groups, whatever the number of their members."""
    swap = F.col("own") > F.col("gid")
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rows = met.select(side("own", "gid").alias("ga"), side("gid", "own").alias("gb"), side("comp", "g_comp").alias("ca"), side("g_comp", "comp").alias("cb"), "c")
    return rows.groupBy("ga", "gb").agg(F.first("ca").alias("ca"), F.first("cb").alias("cb"), F.max("c").alias("c"))


def opened(pairs: DataFrame, members: DataFrame, sets: DataFrame, enough: Callable, ws: Workspace, name: str, confirm: bool) -> DataFrame:
    """Compare the members of pairs of groups (ga, gb) whole.

    ``members`` has gid, doc_id, comp; ``sets`` doc_id, tokens; ``enough(o, n, m)`` says
    whether sets of n and m with o tokens in common link. The larger group is held by a
    task, the members of all groups that meet it pass by, dealt over tasks where they are
    many. With ``confirm`` links (a, b) leave, one for each component and held group; else
    pairs (ga, gb, c) that have such members, c the most tokens in common.
    """
    size = members.groupBy("gid").agg(F.count("*").alias("m"))
    of = lambda c: size.select(F.col("gid").alias(f"s_{c}"), F.col("m").alias(f"m_{c}"))
    both = pairs.select("ga", "gb").join(of("ga"), F.col("ga") == F.col("s_ga")).join(of("gb"), F.col("gb") == F.col("s_gb"))
    swap = F.col("m_ga") > F.col("m_gb")
    both = ws.stage(both.select(F.when(swap, F.col("gb")).otherwise(F.col("ga")).alias("passes"), F.when(swap, F.col("ga")).otherwise(F.col("gb")).alias("held"), F.least("m_ga", "m_gb").alias("m")), f"{name}-ways")
    load = ws.stage(both.groupBy(F.col("held").alias("l_held")).agg(F.ceil(F.sum("m") / PASSING).cast("int").alias("salts")), f"{name}-load")
    dealt = both.join(load, F.col("held") == F.col("l_held")).select("passes", "held", F.pmod(F.xxhash64("passes"), F.col("salts").cast("long")).cast("int").alias("salt"))
    passing = dealt.join(members, F.col("passes") == F.col("gid")).select("held", "salt", F.col("passes"), "doc_id", "comp")
    holding = load.select(F.col("l_held").alias("held"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(members, F.col("held") == F.col("gid")).select("held", "salt", F.lit(None).cast("long").alias("passes"), "doc_id", "comp")
    rows = passing.unionByName(holding).join(sets.select(F.col("doc_id").alias("t_id"), "tokens"), F.col("doc_id") == F.col("t_id")).drop("t_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, ids, sets, joined = None, None, [], [], set()
        for batch in batches:
            keys = list(zip(batch.column("held").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            passes, own, comps, blobs = (batch.column(c) for c in ("passes", "doc_id", "comp", "tokens"))
            passes, own, comps = passes.to_pylist(), own.to_pylist(), comps.to_pylist()
            out = []
            for i in range(len(batch)):
                if keys[i] != key:
                    key, index, ids, sets, joined = keys[i], None, [], [], set()
                x = np.frombuffer(blobs[i].as_buffer(), _U)
                if passes[i] is None:
                    ids.append(own[i])
                    sets.append(x.copy())
                    continue
                if not sets or confirm and comps[i] in joined:
                    continue
                if index is None:
                    index = Overlap(sets)
                o = index.of(x)
                fit = enough(o, len(x), index.size)
                if fit.any():
                    if confirm:
                        joined.add(comps[i])
                        out.append((own[i], ids[int(fit.argmax())], 0))
                    else:
                        out.append((min(passes[i], key[0]), max(passes[i], key[0]), int(o[fit].max())))
            if out:
                a, b, c = (pa.array(v, pa.int64()) for v in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([a, b, c], names=["a", "b", "c"])

    # members of the held group first
    rows = rows.repartition("held", "salt").sortWithinPartitions("held", "salt", F.col("passes").asc_nulls_first(), "doc_id").mapInArrow(run, "a long, b long, c long")
    if confirm:
        out = ws.stage(rows.select("a", "b"), f"{name}-links")
    else:
        out = ws.stage(rows.groupBy(F.col("a").alias("ga"), F.col("b").alias("gb")).agg(F.max("c").alias("c")), f"{name}-kept")
    ws.drop(f"{name}-ways", f"{name}-load")
    return out


class Overlap:
    """Tokens that a set shares with each of some sets, by the sets' joint vocabulary."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.words, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.words), np.int64)

    def of(self, s: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
        place = place[self.words[place] == s]
        self.mark[place] = 1
        o = np.add.reduceat(self.mark[self.flat], self.at)
        self.mark[place] = 0
        return o


def settled(pairs: DataFrame, near: DataFrame, edges: DataFrame, docs: DataFrame, ws: Workspace, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """node, root of all links: the best pairs of groups of each two components first, then those whose components are still apart."""
    pairs = ws.stage(pairs, "pairs")
    near = near.select("gid", "doc_id", "comp")
    similar = lambda o, n, m: 100 * o >= percent * (n + m - o)

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        gids = some.select(F.explode(F.array("ga", "gb")).alias("g")).distinct()
        members = ws.stage(near.join(gids, F.col("gid") == F.col("g"), "left_semi"), f"{name}-members")
        sets = ws.stage(scan_sets(docs, words, id_filter(members, "doc_id"), doc_id, text).select("doc_id", "tokens"), f"{name}-sets")
        out = opened(some, members, sets, similar, ws, name, True)
        ws.drop(f"{name}-members", f"{name}-sets")
        return out

    best = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("c"), "ga", "gb")
    tried = ws.stage(pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= TRY_FIRST).select("ga", "gb"), "tried")
    links = edges.unionByName(confirmed(tried, "v1"))
    roots = components(links, ws, "cc2")
    root = lambda c: roots.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))
    rest = pairs.join(root("ca"), F.col("ca") == F.col("n_ca"), "left").join(root("cb"), F.col("cb") == F.col("n_cb"), "left")
    rest = rest.where(F.coalesce("r_ca", "ca") != F.coalesce("r_cb", "cb")).select("ga", "gb").join(tried, ["ga", "gb"], "left_anti")
    rest = ws.stage(rest, "rest")
    if rest.head(1):
        roots = components(links.unionByName(confirmed(rest, "v2")), ws, "cc3")
    return roots


def every_row(found: Families, roots: DataFrame) -> DataFrame:
    full = found.table.select("doc_id", *SAME).join(found.classes, _meets(), "left")
    full = full.join(roots, F.col("rep") == F.col("node"), "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))


def similar_components(docs: DataFrame, ws: Workspace, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: 100 * overlap >= percent * union is a link."""
    small_batches(docs.sparkSession)
    table = ws.stage(shingle_table(docs, words, percent, doc_id, text), "table")
    found = families(docs, table, ["keys"], 2, ws, words, percent, doc_id, text)
    near = found.near
    live = shared_tokens(near, "keys", ws, "live1")
    often = live.where(F.col("rows") > FREQUENT).unionByName(found.grouped.where("token IS NOT NULL").select("token", F.lit(1 << 40).alias("rows")))
    often = often.groupBy("token").agg(F.max("rows").alias("rows")).orderBy(F.desc("rows"), "token").limit(FREQUENT_MOST)
    frequent = np.array([r.token for r in often.select("token").collect()], np.int64).view(_U)
    if len(frequent):
        changed = reordered(docs, words, percent, frequent, doc_id, text)
        changed = changed.select(F.col("doc_id").alias("id"), F.col("n").alias("m"), F.col("keys").alias("new")).dropDuplicates(["id", "m"])
        near = ws.stage(near.join(changed, (F.col("doc_id") == F.col("id")) & (F.col("n") == F.col("m")), "left").select("doc_id", "n", "comp", *found.marks, "blocks", F.coalesce("new", "keys").alias("keys")), "near2")
        live = shared_tokens(near, "keys", ws, "live2")
    near = in_groups(near, found.marks)
    rows = near.select("doc_id", "n", "comp", "gid", *found.marks, F.explode("keys").alias("token")).join(live.select(F.col("token").alias("t")), F.col("token") == F.col("t"), "left_semi")
    met = meeting(ws.stage(rows, "rows"), found.marks, percent, ws)
    met = met.groupBy("doc_id", "n", "comp", "own", "gid", "g_comp").agg(F.count("*").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
    n, low, high = F.col("n"), F.greatest("n", "low"), F.least(F.col("high"), F.floor(F.col("n") * 100 / percent))
    met = met.where(F.col("c") >= tokens_needed(n, low, high, percent))
    roots = settled(pairs_of_groups(met), near, found.edges, docs, ws, words, percent, doc_id, text)
    ws.drop("near", "near2", "rows", "matrix", "hot", "live1", "live2", "reps")
    return every_row(found, roots)


def reordered(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """New first tokens of texts whose first tokens hold frequent ones: doc_id, n, keys."""
    sent = docs.sparkSession.sparkContext.broadcast(Frequent(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                keep, keys, sizes = [], [], []
                for i, s in enumerate(shingles(part.column("text"), k)):
                    if len(s) and sent.value.among(first_tokens(s, percent)).any():
                        keep.append(i)
                        keys.append(_i64(first_tokens(s, percent, sent.value)))
                        sizes.append(len(s))
                if keep:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id long, n long, keys array<long>")
