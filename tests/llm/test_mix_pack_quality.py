import fractions
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_as_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from sparquill.llm import mixing, packing, quality, queries, token_counts
from sparquill.llm.common import Workspace


def test_mixing_equals_sql(spark):
    assert same_as_sql(spark, queries.op5_mixing, queries.oracle_sql()["op5_mixing"], "/root/testdata/sf0.01") > 500


def token_by_token(tree, total, epochs, weights):
    """Leaf budgets by pouring: at each parent, token after token goes to the child with room that is emptiest for its weight."""
    out = dict.fromkeys(tree, 0)
    room = lambda prefix: sum(v * epochs for leaf, v in tree.items() if leaf[: len(prefix)] == prefix and all(weights[d].get(x, 1.0) > 0 for d, x in enumerate(leaf)))

    def pour(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            out[prefix] = amount
            return
        kids = sorted({leaf[: depth + 1] for leaf in tree if leaf[:depth] == prefix})
        got, weight, most = dict.fromkeys(kids, 0), {k: weights[depth].get(k[-1], 1.0) for k in kids}, {k: room(k) for k in kids}
        for _ in range(amount):
            some = [k for k in kids if weight[k] > 0 and got[k] < most[k]]
            if not some:
                break
            got[min(some, key=lambda k: (fractions.Fraction(got[k] + 1) / fractions.Fraction(weight[k]), k))] += 1
        for k in kids:
            pour(k, got[k])

    pour((), total)
    return out


TREE = {("a", "x", "1"): 10, ("a", "x", "2"): 300, ("a", "y", "1"): 50, ("b", "x", "1"): 700, ("b", "z", "3"): 40, ("c", "z", "9"): 7, ("d", "z", "1"): 90}


@pytest.mark.parametrize("weights", [[{"a": 2.0, "b": 1.0, "c": 0.0}, {"x": 1.0, "y": 1.0}, {}], [{}, {"z": 0.0, "x": 3.0}, {"2": 0.0}], [{"a": 0.5, "d": 7.0}, {}, {"1": 0.0}], [{}, {}, {}]])
def test_shortages_go_to_siblings_first_and_no_token_is_lost(spark, weights):
    leaves = spark.createDataFrame([(*k, v) for k, v in TREE.items()], "capacity string, weight string, s string, tokens long")
    levels = ["capacity", "weight", "s"]
    most = sum(v * 2 for k, v in TREE.items() if all(weights[d].get(x, 1.0) > 0 for d, x in enumerate(k)))
    for total in (0, 1, 100, 901, 1501, 100_000):
        got = {tuple(r)[:3]: r.budget for r in mixing.budgets(leaves, levels, total, 2, dict(zip(levels, weights, strict=True))).collect()}
        want = token_by_token(TREE, total, 2, weights)
        assert sum(got.values()) == min(total, most)
        # which sibling gets a token that can't be divided is free on each of the levels
        assert all(abs(got[k] - want[k]) <= 3 for k in TREE), (total, got, want)
        assert all(got[k] == 0 for k in TREE if any(weights[d].get(x, 1.0) == 0 for d, x in enumerate(k)))


def test_mixing_with_zero_weights_equals_sql(spark, tmp_path):
    """A whole domain has a language of weight 0 alone; a sibling takes what it can't."""
    rows = [(i, "w " * (1 + i % 11), ["en", "xx", None, "de"][i % 4], ["s1", "s5", None, "s9"][i // 4 % 4]) for i in range(800)] + [(900 + i, "v " * 9, "xx", "s7") for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for weights, total in (({"lang": {"xx": 0.0, "de": 3.0}, "domain": {"forum": 5.0}}, 2000), ({"domain": {"web": 0.0}, "source": {"s5": 0.0}}, 2500)):
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        sizes = docs.select("doc_id", queries.domain(F.col("source")).alias("domain"), "lang", "source", mixing.words(F.col("text")).alias("n_tokens"))
        got = mixing.mix(sizes, queries.LEVELS, total, 2, weights)
        import duckdb

        want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(queries.mixing_sql(weights, 2, str(total))).fetchall()
        rows = [tuple(r) for r in got.select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want)) and abs(sum(r[4] * r[5] for r in rows) - total) < 60


def test_columns_of_any_name_pass_through_mixing(spark):
    names = ["rest", "full", "last", "cut_range", "cut_start", "key", "row", "l0", "_l0", "n", "id", "base", "copies", "range", "a.b"]
    d = spark.createDataFrame([(i, "x", 5 + i % 3, *names) for i in range(50)], "doc_id long, domain string, n_tokens long, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(d, ["domain"], 100, 1, {}).collect()
    assert got and all(tuple(r)[3:-1] == tuple(n for n in names if n != "copies") and r.copies == 1 for r in got)


def test_prefixes_of_seeded_epochs(spark):
    rows = [(i, "d", "l", "s", 10 + i % 7) for i in range(500)] + [(7, "d", "l", "s", 10), (None, "d", None, "s", 5), (900, "d", "l", "t", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    sizes = Workspace(spark, "t").stage(sizes, "s")
    total = 9000
    got = mixing.mix(sizes, ["domain", "lang", "source"], total, 3, {}).collect()
    again = mixing.mix(sizes.repartition(7), ["domain", "lang", "source"], total, 3, {}).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    plan = {(r.lang, r.source): r for r in mixing.budgets(sizes.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens")), ["domain", "lang", "source"], total, 3, {}).collect()}
    for leaf, p in plan.items():
        mine = [r for r in rows if (r[2], r[3]) == leaf]
        full, rest = (p.budget // p.tokens, p.budget % p.tokens) if p.tokens else (0, 0)
        key = lambda r: (hashlib.md5(f"mix:{full}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0], r[4])  # noqa: E731, B023
        at, want = 0, 0
        for r in sorted(mine, key=key):
            want += full * r[4] + (r[4] if rest > 0 and 2 * (rest - at) >= r[4] else 0)
            at += r[4]
        assert sum(r.n_tokens * r.copies for r in got if (r.lang, r.source) == leaf) == want
        assert abs(want - p.budget) <= 17
    assert mixing.mix(sizes.where(F.lit(False)), ["domain", "lang", "source"], 0, 3, {}).collect() == []


def plain_pack(sizes, lengths):
    """Best fit by looking at every bin."""
    bins, left = [], sum(sizes)
    out = []
    for n in sizes:
        fit = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
        if fit:
            _, b = min(fit)
        else:
            caps = [c for c in lengths if c >= n]
            cap = min(caps, key=lambda c: (packing.cost(c) / min(c, max(left, n)), c))
            b = len(bins)
            bins.append((cap, 0))
        room, used = bins[b]
        out.append((b, used))
        bins[b] = (room - n, used + n)
        left -= n
    return out, [min(c for c in lengths if c >= u) for _, u in bins]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sets(st.sampled_from([8, 16, 32, 48]), max_size=3))
def test_packing_equals_a_plain_version(sizes, more):
    lengths, sizes = sorted(more | {64}), sorted(sizes, reverse=True)
    bins, offsets, caps = packing.pack(sizes, lengths)
    assert (list(zip(bins, offsets, strict=True)), caps) == plain_pack(sizes, lengths)


def check_pieces(rows, sizes):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
        if r.bin_id is not None:
            by_bin.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.capacity))
    for d, n in sizes.items():
        assert sum(x[2] for x in by_doc[d]) == n
    for pieces in by_bin.values():
        at = 0
        for offset, n, cap in sorted(pieces):
            assert offset == at
            at += n
        assert cap == min(c for c in packing.LENGTHS if c >= at)
    return by_bin


def test_packing_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    sizes = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()}
    bins = check_pieces(queries.op9_packing(spark, sf).collect(), sizes)
    assert sum(sizes.values()) / sum(b[0][2] for b in bins.values()) > 0.95


def test_packing_in_shards_and_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 20)
    rows = [(i, (i * 37) % 9000, "x") for i in range(300)] + [(None, 5, "x"), (3, 111, "x"), (400, 100_000, "x"), (401, None, "x"), (402, 0, "x")]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens long, piece string")
    got = packing.pack_documents(d, shard_rows=50).collect()
    check_pieces(got, {i: n or 0 for i, n, _ in rows if i != 3})
    assert sum(r.n_tokens for r in got if r.doc_id == 3) == 111 + 111
    assert [r.bin_id for r in got if r.doc_id in (401, 402)] == [None, None]
    assert packing.pack_documents(d.limit(0)).collect() == []


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    index, value, at = np.array([1, 5, 7, 2, 3], np.int32), rng.normal(size=5).astype(np.float32), np.array([0, 3, 5])
    want = []
    for a, b in ((0, 3), (3, 5)):
        y = 0.3 + sum(m.weights[index[i]] * value[i] for i in range(a, b))
        y += sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        want.append(y)
    assert np.allclose(m.raw(index, value, at), want, atol=1e-4)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i], y) for i, y in labels if got[i].held_out]
    good = [r for r, y in held if y == 1]
    bad = [r for r, y in held if y == 0]
    assert len(held) > 600
    kept = sum(r.predicted for r in good) / len(good)
    dropped = sum(1 - r.predicted for r in bad) / len(bad)
    pairs = np.mean([[(a.score > b.score) + 0.5 * (a.score == b.score) for b in bad] for a in good])
    print(f"kept {kept:.4f}, dropped {dropped:.4f}, AUC {pairs:.4f}")
    assert kept > 0.97 and dropped > 0.85 and pairs > 0.97


def test_quality_of_odd_rows(spark):
    rows = [(1, None, None, "c"), (2, "", 0, "c"), (3, "word " * 30_000, 150_000, "c"), (4, "!!! ###", -5, "c"), (4, "!!! ###", -5, "c"), (None, "a", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    for y in (labels, labels.limit(0)):
        model = quality.train(docs, y, ["n_chars"])
        got = quality.score(docs, model, ["n_chars"]).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.score(docs, quality.fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0), quality.model_size(["n_chars"])), ["n_chars"]).collect())
    assert quality.score(docs.limit(0), model, ["n_chars"]).collect() == []
    i, v, at = quality.features(pa.array(["", None, "x"]), [])
    assert len(at) == 4 and len(i) == at[-1] == len(v)


def test_labels_of_held_out_rows_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, y, ["n_chars"]) for y in (labels, other))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def plain_stages(spark, sf, kept):
    """Each stage's input and output against plain Python."""
    from test_dedup_and_near import brute

    tokens = token_counts.MergeCounter(queries.vocabulary("byte_bpe_50k.json"))
    n_tokens = lambda rows: tokens.counts(pa.array([r.text for r in rows], pa.string())).tolist()
    same = lambda a, b: sorted(map(repr, a)) == sorted(map(repr, b))
    a, b = kept["quality"]
    model = quality.train(spark.createDataFrame(a, spark.read.parquet(f"{sf}/documents.parquet").schema), spark.read.parquet(f"{sf}/labels.parquet"), queries.METADATA)
    chars = np.array([np.nan if r.n_chars is None else r.n_chars for r in a], float)
    score = model.score(*quality.features(pa.array([r.text for r in a], pa.string()), [chars]))
    assert same(b, [r for r, s in zip(a, score, strict=True) if s >= queries.ACCEPT])
    a, b = kept["exact_dedup"]
    first = {}
    for r in sorted(a, key=lambda r: (r.doc_id is None, r.doc_id)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert same(b, first.values())
    a, b = kept["near_dedup"]
    want = brute([(r.doc_id, r.text) for r in a if r.doc_id is not None], 5, 80)
    assert same(b, [r for r in a if r.doc_id is None or want[r.doc_id][1] == r.doc_id])
    a, b = kept["mixing"]
    tree, place = {}, lambda r: (plain_domain(r.source), r.lang, r.source)
    rows = list(zip(a, n_tokens(a), strict=True))
    for r, n in rows:
        tree[place(r)] = tree.get(place(r), 0) + n
    budget = {tuple(x)[:3]: x.budget for x in mixing.budgets(spark.createDataFrame([(*k, v) for k, v in tree.items()], "domain string, lang string, source string, tokens long"), queries.LEVELS, sum(tree.values()), queries.MAX_EPOCHS, queries.WEIGHTS).collect()}
    want = []
    for leaf, tokens_there in tree.items():
        full, rest = divmod(budget[leaf], tokens_there) if tokens_there else (0, 0)
        at = 0
        for r, n in sorted((x for x in rows if place(x[0]) == leaf), key=lambda x: hashlib.md5(f"mix:{full}:{'null' if x[0].doc_id is None else x[0].doc_id}".encode()).hexdigest()):
            want += [r] * (full + (rest > 0 and 2 * (rest - at) >= n))
            at += n
    assert same(b, want) and abs(sum(n_tokens(b)) - sum(tree.values())) <= len(tree) * max(n for _, n in rows)
    a, b = kept["packing"]
    check_pieces(b, {})
    placed = {}
    for r in b:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for r, n in zip(a, n_tokens(a), strict=True):
        want[r.doc_id] = want.get(r.doc_id, 0) + n
    assert placed == want


def plain_domain(source):
    number = re.split(r"\D+", source or "")[-1]
    return {"0": "web", "1": "web", "2": "web", "3": "web", "4": "books", "5": "books", "6": "books"}.get(number[-1:], "forum" if number else "other")


def stages(spark, docs, sf):
    columns, ws, kept = docs.columns, Workspace(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = ws.stage(stage(spark, docs, sf), name)
        kept[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == columns
    return kept


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    kept = stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    plain_stages(spark, sf, kept)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, kept["packing"][1]))


def test_pipeline_of_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns with the names that stages use."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["score", "copies", "_id", "_copies", "row", "rest", "h", "n_tokens", "hits"]
    some = [tuple(r) for r in docs.limit(40).collect()]
    some += some[:5] + [(5001, None, None, None, None), (None, some[7][1] + " end", "en", "src1", 9), (None, "", None, "src2", 0), (5002, "", "de", None, 0), (5002, some[3][1], "en", "src3", 10), (5003, "word another thing here now " * 30_000, "en", "src1", 810_000)]
    wide = T.StructType([*docs.schema, *(T.StructField(n, T.StringType()) for n in names)])
    kept = stages(spark, spark.createDataFrame([(*r, *names) for r in some], wide), sf)
    assert all(len(b) > 0 for _, b in kept.values())
    assert all(r.hits == "hits" and r.copies == "copies" for r in kept["mixing"][1])
    a, b = kept["exact_dedup"]
    assert len(b) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in a})


@pytest.mark.parametrize("name", ["documents", "labels"])
def test_pipeline_of_empty_tables(spark, tmp_path, name):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        d = spark.read.parquet(f"{sf}/{t}.parquet")
        (d.limit(0) if t == name else d).write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (got == 0) == (name == "documents")
