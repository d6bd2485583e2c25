"""A Merkle manifest of a dataset: a tree of row hashes for each partition value, and a tree of their roots.

Leaves get their place among the rows of their tree by range partitions and counts of
partitions. Aligned blocks of ``2 ** bits`` leaves are reduced by tasks, one block in
one, to a node; the nodes are reduced in the same way until at most ``top`` are left.
The driver builds the rest of all trees and the tree over their roots from those, and
gives each remaining node its suffix path: the siblings from there to the root. Paths
are broadcast (at most ``top`` of them); executors put them behind the siblings inside the
blocks and fold each row's leaf, and its tampered leaf, to the root. If nodes were
reduced more than once, or there are more trees than ``top``, longer paths are joined by
block first, so nothing that grows with the data reaches the driver.

Defined results: a null tree value is a tree of its own and comes first; leaves of a tree
ascend by id (null first), then by leaf, so repeated rows are neighbours. An empty table
gives an empty manifest. A level's last run of one node is hashed alone, too. Names of
other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace, small_batches

BITS = 12
TOP = 16_384
_SIZE = 32


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in fields)).cast("binary"), 256))


def places(rows: DataFrame, tree: list[str], order: list[Column], ws: Workspace, name: str) -> DataFrame:
    """``rows`` with ``place`` (from 0) among those of one tree, and ``total``, their number."""
    keys = [*(F.col(c).asc_nulls_first() for c in tree), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    low = F.monotonically_increasing_id()
    ranked = ws.stage(dealt.withColumn("_row", low.bitwiseAND((1 << 33) - 1)), f"{name}-ranked")
    own = ranked.groupBy("_part", *tree).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part and tree in it
    own = own.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(tree)), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*tree)).alias("total"))
    meets = F.col("_part") == F.col("_p")
    for i, c in enumerate(tree):
        meets = meets & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    own = ws.stage(own, f"{name}-starts")
    met = ranked.join(own, meets)
    return met.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("place"), "total")


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _digest(a: bytes, b: bytes = b"") -> bytes:
    return hashlib.sha256((a.hex() + b.hex()).encode()).digest()


def reduced(leaves: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]]]:
    """The node above some leaves, and the levels below it."""
    rows = [leaves]
    for _ in range(levels):
        x = rows[-1]
        rows.append([_digest(*x[i : i + 2]) for i in range(0, len(x), 2)])
    return rows[-1][0], rows[:-1]


def siblings(place: int, rows: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Siblings of a leaf from bottom to top, and a byte for each level: 0 none, 1 on the left, 2 on the right."""
    path, sides = [], bytearray()
    for x in rows:
        other = place ^ 1
        if other < len(x):
            path.append(x[other])
            sides.append(1 if place & 1 else 2)
        else:
            sides.append(0)
        place >>= 1
    return b"".join(path), bytes(sides)


def fold(leaf: bytes, path: bytes, sides: bytes) -> bytes:
    """The root above a leaf, by its siblings."""
    at = 0
    for s in sides:
        if s:
            other = path[at : at + _SIZE]
            at += _SIZE
            leaf = _digest(other, leaf) if s == 1 else _digest(leaf, other)
        else:
            leaf = _digest(leaf)
    return leaf


@dataclass
class Level:
    """Nodes of one reduction: path, sides inside the block, and the nodes above."""

    rows: DataFrame
    nodes: DataFrame


def reduce_blocks(nodes: DataFrame, bits: int, ws: Workspace, name: str) -> Level:
    """Reduce aligned blocks of (tree, place, total, digest, ...) by up to ``bits`` levels, one task a block.

    Rows keep their columns and get ``block``, ``path`` and ``sides``. Nodes above have
    (tree, place, total, digest), ``total`` the number of nodes of the tree at that level.
    """
    rows = nodes.withColumn("block", F.shiftright("place", bits)).withColumn("levels", F.least(F.lit(bits), height(F.col("total"))))
    schema = rows.schema.add("path", "binary").add("sides", "binary").add("node", "binary")
    most = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def settle() -> Iterator[pa.RecordBatch]:
            group = pa.concat_batches(held)
            place = group.column("place").to_numpy()
            if len(place) > most or (np.diff(place) != 1).any():
                raise ValueError("a block isn't a run of leaves")
            top, levels = reduced([x.as_py() for x in group.column("digest")], group.column("levels")[0].as_py())
            paths = [siblings(i, levels) for i in range(len(group))]
            node = pa.array([top, *[None] * (len(group) - 1)], pa.binary())
            for i in range(0, len(group), 1024):
                some = [*group.slice(i, 1024).columns, *(pa.array(c, pa.binary()) for c in zip(*paths[i : i + 1024], strict=True)), node.slice(i, 1024)]
                yield pa.RecordBatch.from_arrays(some, names=schema.names)

        for batch in batches:
            trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_numpy()
            begin = 0
            for i in range(len(batch) + 1):
                own = (trees[i], blocks[i]) if i < len(batch) else None
                if i < len(batch) and own == key:
                    continue
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if i < len(batch):
                    if held:
                        yield from settle()
                    held, key, begin = [], own, i
        if held:
            yield from settle()

    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    made = ws.stage(dealt.mapInArrow(run, schema), name)
    above = F.ceil(F.col("total") / (1 << bits)).cast("long")
    nodes = made.where("node IS NOT NULL").select("tree", F.col("block").alias("place"), above.alias("total"), F.col("node").alias("digest"))
    return Level(made.drop("node", "levels"), nodes)


def _upper(nodes: list, join: bool) -> tuple[dict, dict, bytes]:
    """On the driver: suffix paths of at most ``top`` nodes by (tree, place), the trees' roots, and the root over them if ``join``."""
    trees: dict = {}
    for r in sorted(nodes, key=lambda r: (r.tree is not None, (r.tree or "").encode() if isinstance(r.tree, str) else r.tree or 0, r.place)):
        trees.setdefault(r.tree, []).append(bytes(r.digest))
    own = {}
    roots = {}
    for tree, x in trees.items():
        roots[tree], levels = reduced(x, (len(x) - 1).bit_length())
        own[tree] = [siblings(i, levels) for i in range(len(x))]
    root, levels = reduced(list(roots.values()), (len(roots) - 1).bit_length()) if join and roots else (b"", [])
    paths = {}
    for k, (tree, x) in enumerate(own.items()):
        tail = siblings(k, levels) if join else (b"", b"")
        for i, (path, sides) in enumerate(x):
            paths[tree, i] = (path + tail[0], sides + tail[1])
    return paths, roots, root


def _suffixes(spark, paths: dict, roots: dict, tree_type) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("s_tree", tree_type), T.StructField("s_place", T.LongType()), T.StructField("s_path", T.BinaryType()), T.StructField("s_sides", T.BinaryType()), T.StructField("subroot", T.BinaryType())])
    return spark.createDataFrame([(t, p, path, sides, roots[t]) for (t, p), (path, sides) in paths.items()], schema)


def _below(rows: DataFrame, suffixes: DataFrame, small: bool) -> DataFrame:
    """Rows of a reduction with whole paths: their own siblings, then those of their block's node."""
    suffixes = F.broadcast(suffixes) if small else suffixes
    met = rows.join(suffixes, F.col("tree").eqNullSafe(F.col("s_tree")) & (F.col("block") == F.col("s_place")))
    return met.withColumn("path", F.concat("path", "s_path")).withColumn("sides", F.concat("sides", "s_sides")).drop("s_tree", "s_place", "s_path", "s_sides", "block")


def _climb(nodes: DataFrame, bits: int, top: int, ws: Workspace, name: str) -> tuple[list[Level], DataFrame, bool]:
    """Reductions until at most ``top`` nodes are left, or one for each tree."""
    levels: list[Level] = []
    while not levels or (nodes.count() > top and nodes.where("total > 1").head(1)):
        levels.append(reduce_blocks(nodes, bits, ws, f"{name}{len(levels)}"))
        nodes = levels[-1].nodes
    return levels, nodes, nodes.count() <= top


def paths(leaves: DataFrame, ws: Workspace, bits: int = BITS, top: int = TOP) -> tuple[DataFrame, bytes]:
    """``leaves`` (tree, place, total, digest, ...) with ``path``, ``sides`` up to the root and ``subroot``; and the root."""
    spark = leaves.sparkSession
    kind = leaves.schema["tree"].dataType
    levels, nodes, small = _climb(leaves, bits, top, ws, "level")
    if small:
        found, roots, root = _upper(nodes.collect(), True)
        suffixes = _suffixes(spark, found, roots, kind)
    else:
        # more trees than the driver takes: their roots are leaves of one more tree
        subroots = nodes.select(F.col("tree").alias("of"), "digest")
        ranked = places(subroots.withColumn("tree", F.lit(0)), ["tree"], [F.col("of").asc_nulls_first()], ws, "trees")
        over, last, _ = _climb(ranked, bits, top, ws, "over")
        found, roots, root = _upper(last.collect(), False)
        root = next(iter(roots.values()))
        up = _suffixes(spark, found, roots, over[0].rows.schema["tree"].dataType)
        for i in reversed(range(len(over))):
            rows = _below(over[i].rows, up.drop("subroot"), i == len(over) - 1)
            if i:
                up = ws.stage(rows.select(F.col("tree").alias("s_tree"), F.col("place").alias("s_place"), F.col("path").alias("s_path"), F.col("sides").alias("s_sides"), F.lit(None).cast("binary").alias("subroot")), f"up{i}")
            else:
                suffixes = ws.stage(rows.select(F.col("of").alias("s_tree"), F.lit(0).cast("long").alias("s_place"), F.col("path").alias("s_path"), F.col("sides").alias("s_sides"), F.col("digest").alias("subroot")), "suffixes")
    for i in reversed(range(len(levels))):
        rows = _below(levels[i].rows, suffixes, small and i == len(levels) - 1)
        if i:
            suffixes = ws.stage(rows.select(F.col("tree").alias("s_tree"), F.col("place").alias("s_place"), F.col("path").alias("s_path"), F.col("sides").alias("s_sides"), "subroot"), f"suffix{i}")
    return rows, root


def manifest(docs: DataFrame, ws: Workspace, fields: list[str], tampered: dict[str, Column], changed: Column, doc_id: str = "doc_id", tree: str = "lang", bits: int = BITS, top: int = TOP) -> DataFrame:
    """A row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` make the leaf, in order. Where ``changed`` holds, the fold starts at the
    leaf of the row with the columns of ``tampered`` in place of its own; siblings are
    the original ones. Texts are read once and never shuffle.
    """
    small_batches(docs.sparkSession)
    other = F.when(changed, leaf_hash([tampered.get(c, F.col(c)) for c in fields]))
    leaves = docs.select(F.col(tree).alias("tree"), F.col(doc_id).alias("doc_id"), leaf_hash([F.col(c) for c in fields]).alias("digest"), other.alias("tampered"))
    # equal leaves are the same whatever their order; the place in the input lets ranges part them
    leaves = ws.stage(leaves.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    ranked = places(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_at")], ws, "leaves").drop("_at")
    rows, root = paths(ranked, ws, bits, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, bad, path, sides, sub in zip(*(batch.column(c).to_pylist() for c in ("digest", "tampered", "path", "sides", "subroot")), strict=True):
                proof = hashlib.sha256(path.hex().encode()).hexdigest()
                folded = fold(bad or leaf, path, sides)
                out.append((leaf.hex(), sub.hex(), root.hex(), proof, folded.hex(), folded == root))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string()] * 5 + [pa.bool_()], strict=True)] if out else [pa.array([], k) for k in [pa.string()] * 5 + [pa.bool_()]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = rows.select("doc_id", "digest", "tampered", "path", "sides", "subroot")
    return rows.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
