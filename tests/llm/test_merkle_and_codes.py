import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import same_as_sql
from pyspark.sql import functions as F

from sparquill.llm import merkle, queries, vector_codes
from sparquill.llm.common import Workspace

SF = "/root/testdata/sf0.01"


def test_merkle_equals_sql(spark):
    assert same_as_sql(spark, queries.op12_merkle, queries.oracle_sql()["op12_merkle"], SF) == 1000


def test_codes_equal_sql(spark):
    assert same_as_sql(spark, queries.op13_vector_codes, queries.oracle_sql()["op13_vector_codes"], SF) == 500


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels_of(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([H(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def plain_manifest(docs):
    """By whole trees in memory."""
    trees = {}
    for r in docs:
        bad = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), plain_leaf(*r[:3], r[3] + 1, r[4]) if bad and r[3] is not None else None))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels_of([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    top = levels_of([built[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for i, (there, doc, leaf, bad) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            proof, folded = "", bad or leaf
            for place, rows in ((i, built[t][:-1]), (k, top[:-1])):
                for row in rows:
                    other = row[place ^ 1] if place ^ 1 < len(row) else ""
                    proof += other
                    folded = H(other, folded) if place & 1 else H(folded, other)
                    place >>= 1
            out.append((doc if there else None, leaf, built[t][-1][0], top[-1][0], H(proof), folded, folded == top[-1][0]))
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, path string, _at string"


@pytest.mark.parametrize(("bits", "top"), [(12, 16384), (1, 1 << 14), (1, 4), (2, 3), (2, 1)])
def test_merkle_of_odd_rows(spark, monkeypatch, bits, top):
    rng = random.Random(bits)
    docs = [(rng.choice([None, *range(400)]), rng.choice(["a", None]), rng.choice(["de", "é", "z", None, "", "en", "en", "en"]), rng.choice([None, 5]), rng.choice([None, "", "x", "ü\n" * 50, "y" * 9000])) for _ in range(150)]
    docs += docs[:20] + [(7, "one", "lone", 1, "t")]
    df = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], COLUMNS).repartition(5)
    monkeypatch.setattr(merkle, "BITS", bits)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(df, Workspace(spark, "t"), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": more}, changed.__and__(F.col("text").isNotNull()), bits=bits, top=top)
    want = plain_manifest(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert not all(r[-1] for r in want)


def test_empty_and_single_manifest(spark):
    df = spark.createDataFrame([(1, None, None, None, None, *"abcd")], COLUMNS)
    run = lambda d: merkle.manifest(d, Workspace(spark, "t"), ["doc_id", "text"], {}, F.lit(False)).collect()
    (r,) = run(df)
    assert r.leaf == r.subroot == r.root == r.folded_root == H("1:1-") and r.proof_sha256 == H("") and r.verified
    assert run(df.limit(0)) == []


def plain_codes(rows, parts, entries, rounds):
    kept = []
    for i, v, label in rows:
        if v is not None and len(v) and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i is None, i or 0, [int(np.floor(np.float64(x) * 4096)) for x in v], label))
    kept.sort(key=lambda r: r[:3])
    if not kept:
        return [], []
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    w = len(kept[0][2]) // parts
    cut = lambda q, p: q[p * w : (p + 1) * w]
    book = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min((dist(cut(r[2], p), e), j) for j, e in enumerate(book[p])) for p in range(parts)] for r in kept]
    for _ in range(rounds):
        got = near()
        for p in range(parts):
            for j in range(len(book[p])):
                own = [cut(r[2], p) for r, g in zip(kept, got, strict=True) if g[p][1] == j]
                if own:
                    book[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = near()
    error = [sum(d for d, _ in g) for g in got]
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[3]] = total.get(r[3], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return [(None if r[0] else r[1], "".join(f"{j:02x}" for _, j in g), e, total[r[3]], digest) for r, g, e in zip(kept, got, error, strict=True)], book


@pytest.mark.parametrize(("seed", "scale", "entries"), [(1, 0.5, 16), (2, 0.001, 16), (3, 9.0, 5), (4, 900.0, 16)])
def test_codes_of_odd_vectors(spark, seed, scale, entries):
    rng = np.random.default_rng(seed)
    nan, inf = float("nan"), float("inf")
    rows = [(int(rng.integers(0, 60)) if rng.random() > 0.1 else None, [float(np.float32(x)) for x in rng.normal(size=16) * scale], None if rng.random() < 0.2 else int(rng.integers(3))) for _ in range(120)]
    rows += rows[:15] + [(0, None, 1), (-5, [nan] * 16, 1), (-4, [0.1] * 15 + [inf], 1), (-3, [0.1] * 15 + [None], 2), (-2, [], 2), (-1, [0.5] * 7, 2), (300, [0.25] * 8, 0)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = vector_codes.compress(df, Workspace(spark, "t"), entries=entries)
    want, _ = plain_codes(rows, 8, entries, 6)
    assert len(want) == 135 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert vector_codes.compress(df.limit(0), Workspace(spark, "t")).collect() == []
    few = vector_codes.compress(df.where("vec_id < 8"), Workspace(spark, "t")).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(plain_codes([r for r in rows if r[0] is not None and r[0] < 8], 8, 16, 6)[0], key=repr)


def test_bounds_prune_and_never_prune_ties():
    rng = np.random.default_rng(5)
    q = rng.integers(-3, 4, (4000, 4))
    book = np.concatenate([rng.integers(-3, 4, (6, 4)), np.array([[0, 0, 0, 0]] * 2), rng.integers(40, 44, (8, 4))])
    gaps = ((book[:, None] - book[None]) ** 2).sum(-1)
    code, upper, lower = np.zeros(4000, np.int64), np.full(4000, 999), np.zeros((4000, 16), np.int64)
    exact = ((q[:, None] - book[None]) ** 2).sum(-1)
    _, first = vector_codes.assign(q, book, gaps, code, upper, lower)
    assert (code == exact.argmin(1)).all() and (upper >= np.sqrt(exact.min(1))).all() and (lower <= np.sqrt(exact)).all()
    moved = book.copy()
    moved[1] += 1
    step = vector_codes.ceil_sqrt(((moved - book) ** 2).sum(1))
    upper += step[code]
    lower = np.maximum(lower - step, 0)
    exact = ((q[:, None] - moved[None]) ** 2).sum(-1)
    _, again = vector_codes.assign(q, moved, ((moved[:, None] - moved[None]) ** 2).sum(-1), code, upper, lower)
    assert (code == exact.argmin(1)).all() and again < first / 2 < 4000 * 16 / 2


def test_whole_square_roots():
    d = np.array([0, 1, 2, 3, 4, 15, 16, 17, (1 << 29) ** 2 - 1, (1 << 29) ** 2, (1 << 29) ** 2 + 1, (1 << 58) - 1])
    import math

    assert vector_codes.floor_sqrt(d).tolist() == [math.isqrt(int(x)) for x in d]
    assert vector_codes.ceil_sqrt(d).tolist() == [math.isqrt(int(x) - 1) + 1 if x else 0 for x in d]
