"""A stored index of vectors in cells: searches read the files of the cells they probe.

Cells belong to centers of k-means, fitted once on a bounded sample; every vector of
the centers' length is stored in the cell of its nearest center, vectors of other
lengths in a cell of their own, which queries of those lengths read. Each ingest
writes one segment with a folder for each cell, large cells in several files; keys of
a later segment replace those of earlier ones (see ``segments``).

A search probes the nearest cells of each query, a number of them, or as many as reach
a recall by a stored measurement (``measure``), or as many as prove the answer exact:
a cell keeps its widest angle to its center, so no vector in it is nearer to a query
than the query's angle to the center less that, and cells that can't beat a query's
last place stay closed.
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import shared_folder, staged
from . import nearest
from .retrieval import QUERY_BLOCK
from .segments import Segments

CELLS, PROBES = 100, 10
#: Vectors that the centers are fitted on, and queries that recall is measured with: the smallest hashes of all.
SAMPLE, ASKED = 20_000, 256
#: Vectors of a cell in one file.
FILE_ROWS = 100_000
#: The cell of vectors that have another length than the centers.
OTHER = -1
#: Room for the rounding of sums in angles.
SLACK = 1e-7


def _smallest_hashes(vectors: DataFrame, vector: str, n: int) -> DataFrame:
    return vectors.where(_has_direction(F.col(vector))).orderBy(F.xxhash64(vector)).limit(n)


def _has_direction(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _placed(centers):
    """Rows (key or query_id, vector) with the cell of the nearest center and the angle to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for rows, v in nearest.matrices(batch.column(1)):
                if len(centers) and v.shape[1] == centers.shape[1]:
                    score = v @ centers.T
                    cell = score.argmax(1)
                    angle = np.arccos(np.clip(score[np.arange(len(cell)), cell], -1, 1))
                else:
                    cell, angle = np.full(len(v), OTHER), np.zeros(len(v))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=[*batch.schema.names, "cell", "angle"])

    return run


def _in_cells(sent, limit: int, schema):
    """The rows of a task that are among the nearest to each query of a block that opens their cell."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, asked, opened = sent.value
        best = nearest.Best(len(names), limit)
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for rows, v in nearest.matrices(batch.column("vector")):
                if v.shape[1] not in asked:
                    continue
                which, q = asked[v.shape[1]]
                for cell in np.unique(cells[rows]):
                    here = cells[rows] == cell
                    mine = np.isin(which, opened.get(int(cell), ()))
                    best.add(which[mine], batch.column("key").take(pa.array(rows[here])), nearest.scores(v[here], q[mine]))
        yield from nearest.answers(best, names, schema)

    return run


class VectorIndex(Segments):
    """Vectors have a key and an array; rows without a key aren't indexed, those without a direction (null, zero, not finite) have no score.

    Rows of one ingest that share a key are all kept. ``create`` makes an index; one that
    exists is opened by its folder.
    """

    parts = ("entries", "cells", "gone")
    owner = "key"

    @classmethod
    def create(cls, spark: SparkSession, root: str, vectors: DataFrame, cells: int = CELLS, key: str = "vec_id", vector: str = "embedding", seed: int = 7, sample: int = SAMPLE) -> VectorIndex:
        """Fit at most ``cells`` centers on the ``sample`` vectors of most frequent length with the smallest hashes, and ingest all."""
        index = cls(spark, root)
        index._fit(vectors, cells, vector, seed, sample)
        index.ingest(vectors, key, vector)
        return index

    def _fit(self, vectors: DataFrame, cells: int, vector: str, seed: int, sample: int) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        some = staged(_smallest_hashes(vectors, vector, sample).select(F.transform(vector, lambda x: x.cast("double")).alias("v")), "cell-sample")
        lengths = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        centers: list[list[float]] = []
        if lengths:
            own = some.where(F.size("v") == lengths[0].n).select(array_to_vector("v").alias("features"))
            if own.count() > 1 and cells > 1:
                model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(own)
                centers = [c.tolist() for c in model.clusterCenters()]
            else:
                centers = [own.first().features.toArray().tolist()]
        self._put("centers", {"centers": centers, "id": uuid.uuid4().hex})

    def _put(self, name: str, content: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _get(self, name: str) -> dict | None:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _centers(self):
        import numpy as np

        made = self._get("centers")
        if made is None:
            raise ValueError("the index has no centers: make it with VectorIndex.create")
        if not made["centers"]:
            return made["id"], np.zeros((0, 0))
        c = np.asarray(made["centers"], float)
        return made["id"], c / np.sqrt((c * c).sum(1))[:, None]

    def _schema(self, part: str) -> str:
        now = self._newest()[1] or {}
        return {
            "entries": f"key {now['key']}, vector {now['vector']}, angle double, segment string, cell int",
            "cells": "cell int, n bigint, angle double, segment string",
            "gone": f"key {now['key']}, segment string",
        }[part]

    # --- writing

    def ingest(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> str:
        """Add vectors as a segment; their keys are replaced, also where a new vector has no direction."""
        rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        made, centers = self._centers()
        types = {f.name: f.dataType.simpleString() for f in rows.schema}
        placed = rows.mapInArrow(_placed(centers), f"key {types['key']}, vector {types['vector']}, cell int, angle double")
        return self._write(placed, rows.select("key"), made, types["vector"], self._added)

    def remove(self, keys: DataFrame, key: str = "vec_id") -> str:
        """Remove the vectors of keys."""
        kind = (self._newest()[1] or {"vector": "array<float>"})["vector"]
        return self.ingest(keys.select(key, F.lit(None).cast(kind).alias("_v")), key, "_v")

    def merge(self, first: int = 0) -> str:
        """Write the segments from number ``first`` on as one, without what later ones of them replace."""
        old = self.segments()[first:]
        if not old:
            raise ValueError("no segments to merge")
        now = self._newest()[1]
        rows = self._alive(self._read("entries", old), old).select("key", "vector", "cell", "angle")
        gone = self._read("gone", old).select("key")
        return self._write(rows, gone if first else gone.limit(0), now["centers"], now["vector"], lambda new: self._replaced(new, old, first))

    def _write(self, placed: DataFrame, gone: DataFrame, centers: str, vector: str, change) -> str:
        new = uuid.uuid4().hex
        at = {part: f"{self.root}/{part}/segment={new}" for part in self.parts}
        work = self._path(f"{self.root}/work/{new}")
        self._fs.deleteOnExit(work)
        try:
            rows = self._stage(placed, f"{work}/rows")
            cells = self._stage(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")), at["cells"])
            # a row for each cell: no more than there are centers, and one
            files = F.broadcast(cells.select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("files")))
            dealt = rows.join(files, "cell").withColumn("file", F.pmod(F.xxhash64("key"), "files"))
            out = dealt.repartition("cell", "file").sortWithinPartitions("cell").select("key", "vector", "angle", "cell")
            out.write.option("maxRecordsPerFile", 2 * FILE_ROWS).partitionBy("cell").parquet(at["entries"])
            gone.where("key IS NOT NULL").distinct().write.parquet(at["gone"])
        finally:
            self._fs.delete(work, True)
        self._commit(change(new), {"key": gone.schema["key"].dataType.simpleString(), "vector": vector, "centers": centers})
        return new

    # --- reading

    def measure(self, limit: int = 5, asked: int = ASKED) -> list[float]:
        """Recall for each number of probes, from 1 to all cells, of ``asked`` stored vectors as queries; kept for searches by recall.

        The exact neighbours of each are found once; what counts is how far down the
        query's list of cells each lies, so one search measures all numbers.
        """
        import numpy as np

        _, centers = self._centers()
        segments = self.segments()
        stored = self._alive(self._read("entries", segments), segments).where(F.col("cell") != OTHER)
        some = staged(stored.orderBy(F.xxhash64("vector"), "key").limit(asked).select(F.col("key").alias("query_id"), F.col("vector").alias("q")), "recall-queries")
        found = self.search(some, limit, exact=True)
        at = found.join(stored.select("key", "cell").distinct(), "key").join(some, "query_id")
        rows = at.select("q", "cell").collect()  # asked * limit rows (and repeated keys)
        if not rows:
            recall = [1.0] * max(len(centers), 1)
        else:
            q = np.stack([np.asarray(r.q, float) for r in rows])
            score = q @ centers.T
            own = score[np.arange(len(rows)), [r.cell for r in rows]]
            need = (score > own[:, None]).sum(1) + 1
            recall = [float((need <= p).mean()) for p in range(1, len(centers) + 1)]
        self._put("recall", {"limit": limit, "recall": recall})
        return recall

    def probes(self, recall: float) -> int:
        """The least number of probes that reached a recall when it was measured."""
        measured = self._get("recall")
        if measured is None:
            raise ValueError("measure() the index first")
        return next((i for i, r in enumerate(measured["recall"], 1) if r >= recall), len(measured["recall"]))

    def search(self, queries: DataFrame, limit: int, probes: int = PROBES, recall: float | None = None, exact: bool = False) -> DataFrame:
        """query_id, key, score, place: nearest by cosine for queries (query_id, q); ties to the smaller key.

        ``recall`` takes as many probes as reached it in ``measure``. ``exact`` goes on
        from the probed cells to all that could hold a better vector. Queries come to the
        driver in blocks, ordered by their nearest cell, so that a block opens few cells.
        """
        made, centers = self._centers()
        probes = self.probes(recall) if recall is not None else probes
        segments = self.segments()
        key = (self._newest()[1] or {"key": "bigint"})["key"]
        kind = {f.name: f.dataType for f in queries.schema}
        schema = T.StructType([T.StructField("query_id", kind["query_id"]), *T._parse_datatype_string(f"key {key}").fields, T.StructField("score", T.DoubleType())])
        placed = queries.select("query_id", "q").mapInArrow(_placed(centers), f"query_id {kind['query_id'].simpleString()}, q {kind['q'].simpleString()}, cell int, angle double")
        none = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("place", T.IntegerType(), False)]))
        if not segments:
            return none
        widest = {r.cell: r.angle for r in self._read("cells", segments).groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
        asked = placed.orderBy("cell").select("query_id", "q").toLocalIterator()
        block = lambda: [tuple(r) for r in itertools.islice(asked, QUERY_BLOCK)]
        some, more = block(), block()
        if not some:
            return none
        if not more:
            return self._answers(some, segments, centers, widest, schema, limit, probes, exact)
        at = f"{shared_folder(self.spark)}/cells-{uuid.uuid4().hex}"
        self._fs.deleteOnExit(self._path(at))
        while some:
            self._answers(some, segments, centers, widest, schema, limit, probes, exact).write.mode("append").parquet(at)
            some, more = more, block()
        return self.spark.read.schema(none.schema).parquet(at)

    def _answers(self, some: list, segments: list[str], centers, widest: dict, schema, limit: int, probes: int, exact: bool) -> DataFrame:
        import numpy as np

        asked, names = nearest.by_length(some), [r[0] for r in some]
        opened: dict = {}
        angle = {}
        for length, (which, q) in asked.items():
            if len(centers) and length == centers.shape[1]:
                cells = np.array(sorted(c for c in widest if c != OTHER), int)
                score = q @ centers[cells].T if len(cells) else np.zeros((len(q), 0))
                order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                for j, cell in enumerate(cells):
                    opened[int(cell)] = which[(order == j).any(1)]
                angle = {"which": which, "cells": cells, "angle": np.arccos(np.clip(score, -1, 1))}
            elif OTHER in widest:
                opened[OTHER] = np.append(opened.get(OTHER, np.zeros(0, int)), which)
        first = self._open(names, asked, opened, segments, schema, limit)
        if not exact or not angle or not len(angle["cells"]):
            return self._best(first, limit)
        first = staged(self._best(first, limit), "probed").drop("place")
        # a row for each query of a block
        last = {r.query_id: r.score for r in first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= limit).collect()}
        least = np.array([last.get(names[i], -2.0) for i in angle["which"]])
        nearer = np.cos(np.maximum(angle["angle"] - [widest[c] for c in angle["cells"].tolist()] - SLACK, 0.0))
        can = nearer >= least[:, None] - SLACK
        rest = {int(c): np.setdiff1d(angle["which"][can[:, j]], opened[int(c)]) for j, c in enumerate(angle["cells"])}
        return self._best(first.unionByName(self._open(names, asked, rest, segments, schema, limit)), limit)

    def _open(self, names, asked, opened: dict, segments: list[str], schema, limit: int) -> DataFrame:
        opened = {c: w for c, w in opened.items() if len(w)}
        entries = self._read("entries", segments).where(F.col("cell").isin(list(opened)) if opened else F.lit(False))
        rows = self._alive(entries.select("key", "vector", "segment", "cell"), segments).select("key", "vector", "cell")
        return rows.mapInArrow(_in_cells(self.spark.sparkContext.broadcast((names, asked, opened)), limit, to_arrow_schema(schema)), schema)

    @staticmethod
    def _best(found: DataFrame, limit: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
