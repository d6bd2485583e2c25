"""The stored cells of vectors against a scan of all."""

import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.operators import retrieval, vector_index
from sparquill.operators.segments import Conflict
from sparquill.operators.vector_index import VectorIndex

VECTORS = "vec_id string, embedding array<double>"


def scan(rows, queries, limit):
    """query -> [(key, score)] over every row."""
    out = {}
    unit = lambda v: np.array(v) / np.sqrt((np.array(v) ** 2).sum())
    real = lambda v: bool(v) and None not in v and np.isfinite(v).all() and any(v)
    for name, q in queries:
        if real(q):
            hits = [(-round(float(unit(v) @ unit(q)), 9), k) for k, v in rows if k is not None and real(v) and len(v) == len(q)]
            if hits:
                out[name] = [(k, -s) for s, k in sorted(hits)[:limit]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.place)):
        out.setdefault(r.query_id, []).append((r.key, round(r.score, 9)))
    return out


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if "/versions" not in d}


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_search_equals_a_scan_through_changes(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", block)
    monkeypatch.setattr(vector_index, "FILE_ROWS", 5)
    rng = random.Random(block)
    centers = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    near = lambda: [round(x + rng.gauss(0, 0.1), 2) for x in rng.choice(centers)]
    odd = [("null", None), ("empty", []), ("zero", [0.0] * 4), ("nan", [1.0, float("nan"), 0.0, 0.0]), ("inf", [1.0, float("inf"), 0.0, 0.0]), ("hole", [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), ("short", [1.0, 2.0]), ("short2", [2.0, 1.0])]
    rows = [(f"k{i:03d}", near()) for i in range(150)] + odd + [("k000", [1.0, 0.0, 0.0, 0.0])] * 2 + [("tie1", [1.0] * 4), ("tie2", [2.0] * 4)]
    queries = [(i, near()) for i in range(12)] + [(20, [1.0] * 4), (21, [1.0, 1.0]), (22, None), (23, [0.0] * 4), (24, [1.0, 2.0, 3.0])]
    asked = spark.createDataFrame(queries, "query_id int, q array<double>")
    table = lambda r: spark.createDataFrame(r, VECTORS)
    index = VectorIndex.create(spark, f"{tmp_path}/i", table(rows), cells=9)
    assert found(index.search(asked, 4, probes=2, exact=True)) == scan(rows, queries, 4)
    assert found(index.search(asked, 4, probes=9)) == scan(rows, queries, 4)
    before = files(f"{tmp_path}/i")
    new = [(f"k{i:03d}", near()) for i in range(0, 60, 3)] + [("k100", None), ("n1", near())]
    index.ingest(table(new))
    assert all(files(f"{tmp_path}/i").get(f) == at for f, at in before.items())
    index.remove(table([(f"k{i:03d}", None) for i in range(1, 40, 2)] + [("unknown", None)]))
    changed = {k for k, _ in new}
    rows = [r for r in rows if r[0] not in changed] + new
    rows = [r for r in rows if r[0] not in {f"k{i:03d}" for i in range(1, 40, 2)}]
    for first in (None, 1, 0):
        if first is not None:
            index.merge(first)
        assert found(index.search(asked, 4, probes=1, exact=True)) == scan(rows, queries, 4)
    assert len(VectorIndex(spark, f"{tmp_path}/i").segments()) == 1
    stale = VectorIndex(spark, f"{tmp_path}/i")
    commit = stale._commit
    monkeypatch.setattr(stale, "_commit", lambda *a: (index.merge(), commit(*a)))
    with pytest.raises(Conflict):
        stale.merge()


def test_searches_read_the_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(120, 16))
    rows = [(int(i), (centers[i % 120] + rng.normal(size=16) * 0.15).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = VectorIndex.create(spark, f"{tmp_path}/i", v)
    many = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(r.query_id, r.vec_id) for r in retrieval.vector_search(v, many, 5).collect()}
    got = {(r.query_id, r.key) for r in index.search(many, 5).collect()}
    assert len(exact & got) / len(exact) >= 0.9
    recall = index.measure(5, 100)
    assert recall == sorted(recall) and recall[vector_index.PROBES - 1] >= 0.9 and recall[-1] == 1 and index.probes(0.9) <= vector_index.PROBES
    want = found(index.search(asked, 5, probes=3))
    q = np.array([r.q for r in asked.collect()])
    probed = {int(c) for row in np.argsort(-(q @ index._centers()[1].T), axis=1)[:, :3] for c in row}
    root = f"{tmp_path}/i/entries/segment={index.segments()[0]}"
    gone = [d for d in os.listdir(root) if d.startswith("cell=") and int(d[5:]) not in probed]
    for d in gone:
        shutil.rmtree(f"{root}/{d}")
    assert len(gone) > 80 and found(index.search(asked, 5, probes=3)) == want


def test_recall_on_vectors_without_clusters(spark, tmp_path):
    """The table's vectors lie in all directions alike: probes are as many as the measurement asks for."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = VectorIndex.create(spark, f"{tmp_path}/i", v)
    index.measure(10)
    probes = index.probes(0.93)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(r.query_id, r.vec_id) for r in retrieval.vector_search(v, asked, 10).collect()}
    got = {(r.query_id, r.key) for r in index.search(asked, 10, recall=0.93).collect()}
    assert len(exact & got) / len(exact) >= 0.9 and probes < len(index._centers()[1])


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, q array<double>")
    index = VectorIndex.create(spark, f"{tmp_path}/i", none)
    assert index.search(asked, 3).count() == 0 and index.search(asked.limit(0), 3).count() == 0
    index.ingest(spark.createDataFrame([(7, [2.0, 4.0]), (8, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert [r.key for r in index.search(asked, 3, exact=True).orderBy("place").collect()] == [7, 8]
