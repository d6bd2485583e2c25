import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_as_sql
from pyspark.sql import functions as F

from sparquill.llm import exact_dedup, jaccard_groups, queries
from sparquill.llm.common import Workspace


def test_exact_dedup_equals_sql(spark):
    assert same_as_sql(spark, queries.op8_exact_dedup, queries.oracle_sql()["op8_exact_dedup"], "/root/testdata/sf0.01") == 1000


def test_exact_dedup_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    rows = [(5, "a  b"), (2, "a\tb"), (None, "a b"), (2, "a b"), (7, None), (8, ""), (9, " "), (1, "x"), (3, " x")]
    docs = spark.createDataFrame([(i, t, "h", "s") for i, t in rows], "doc_id long, text string, h string, sha string")
    got = exact_dedup.decisions(docs, Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if r.keep_id == 2) == [(2, 4, False)] * 3 + [(2, 4, True)]
    assert sorted((r.doc_id, r.keep_id) for r in got if r.keep_id in (7, 9, 1, 3)) == [(1, 1), (3, 3), (7, 7), (8, 7), (9, 9)]
    stay = exact_dedup.deduplicate(docs, Workspace(spark, "t"))
    assert sorted(r.doc_id for r in stay.collect()) == [1, 2, 3, 7, 9] and stay.columns == docs.columns
    assert exact_dedup.decisions(docs.limit(0), Workspace(spark, "t")).collect() == []
    assert exact_dedup.deduplicate(docs.limit(0), Workspace(spark, "t")).collect() == []


@pytest.mark.parametrize("limit", [128, 1024, 1 << 20])
def test_bound_of_the_filter_changes_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "LOCAL_ROWS", 50)
    monkeypatch.setattr(exact_dedup, "SLICE_BITS", 512)
    docs = spark.createDataFrame([(i, f"t{i % 400}") for i in range(500)], "doc_id long, text string")
    got = exact_dedup.decisions(docs, Workspace(spark, "t"), max_filter_bytes=limit).collect()
    assert sum(r.kept for r in got) == 400 and sum(r.group_size == 2 for r in got) == 200


def test_filter_holds_all_repeated_hashes_and_few_others(spark):
    rows = spark.range(0, 40_000, 1, 7).select(F.xxhash64(F.when(F.col("id") < 36_000, F.col("id")).otherwise(F.col("id") % 1000)).alias("h"), "id")
    got = exact_dedup.probe(rows, exact_dedup.repeated_filter(rows)).collect()
    flagged = {r.id for r in got if r.maybe}
    assert flagged >= set(range(1000)) | set(range(36_000, 40_000))
    assert len(flagged) - 5000 < 35_000 / 50


def test_bitmaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 3000, 200) for _ in range(6)]
    made = [list(exact_dedup.bitmaps(p, 4096, 4096)) for p in parts]
    want = None
    for order in (range(6), reversed(range(6)), (3, 1, 5, 0, 2, 4)):
        got = exact_dedup.merged(iter([(a, b) for i in order for _, a, b in made[i]]), 4096)
        want = got if want is None else want
        assert (got == want).all()
    values, count = np.unique(np.concatenate(parts), return_counts=True)
    at = exact_dedup._positions(values[count > 1], 4096)
    assert ((want[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all()


def test_names_of_columns_in_exact_dedup(spark):
    names = ["h", "_h", "sha", "_sha", "maybe", "group", "keep", "_maybe"]
    docs = spark.createDataFrame([(i, f"t{i % 3}", *names) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = exact_dedup.deduplicate(docs, Workspace(spark, "t")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2] and all(tuple(r)[2:] == tuple(names) for r in got)


def brute(rows, k, percent):
    """Component of each id, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = [(i, s) for i, ss in sets.items() for s in ss if s]
    by: dict = {}
    for x, (i, s) in enumerate(every):
        for token in s:
            by.setdefault(token, []).append(x)
    seen = set()
    for at in by.values():
        for n, x in enumerate(at):
            for y in at[n + 1 :]:
                if (x, y) not in seen:
                    seen.add((x, y))
                    (i, a), (j, b) = every[x], every[y]
                    o = len(a & b)
                    if 100 * o >= percent * (len(a) + len(b) - o):
                        p, q = find(i), find(j)
                        root[max(p, q)] = min(p, q)
    return {i: ({len(s) for s in ss}, find(i)) for i, ss in sets.items()}


def check(spark, rows, k, percent):
    docs = spark.createDataFrame([(i, t, 1, "n", [1]) for i, t in rows], "doc_id long, text string, rep int, comp string, keys array<int>")
    got = jaccard_groups.similar_components(docs, Workspace(spark, "t"), k, percent).collect()
    want = brute([r for r in rows if r[0] is not None], k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1], r
    return got


def test_near_join_equals_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, sf).collect()}
    want = brute(rows, 4, 85)
    assert all(got[i][0] in want[i][0] and got[i][1] == want[i][1] for i in want)


@pytest.mark.parametrize("copies", [0, 2, 50])
def test_near_join_of_a_family_in_many_blocks(spark, monkeypatch, copies):
    """A family whose members link with its first text, and only some with each other; many sets meet the other blocks, or none do."""
    for name, value in (("BLOCK_ROWS", 8), ("LARGE", 5), ("SCOUTS", 2), ("COPIES", copies), ("MATRIX_GROUP", 4)):
        monkeypatch.setattr(jaccard_groups, name, value)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 6])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    got = check(spark, rows, 5, 80)
    assert len({r.component_id for r in got}) > 1 and sum(r.component_id == 0 for r in got) > 40


@pytest.mark.parametrize("small", [False, True])
def test_near_join_of_edited_copies(spark, monkeypatch, small):
    """A chain of edits, a family around one text, a shared passage; also with tiny groups and few frequent tokens."""
    if small:
        for name, value in (("BLOCK_ROWS", 3), ("LARGE", 4), ("FREQUENT", 3), ("MATRIX_GROUP", 2), ("TRY_FIRST", 1), ("FILTER_BITS", (12, 12)), ("TOKEN_PAIRS", 5), ("SCOUTS", 1), ("COPIES", 9)):
            monkeypatch.setattr(jaccard_groups, name, value)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    base = [word() for _ in range(120)]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        add(w)
    w = [word() for _ in range(100)]
    for _ in range(15):
        w = list(w)
        w[rng.randrange(len(w))] = word()
        add(w)
    for _ in range(20):
        add([word() for _ in range(50)] + passage + [word() for _ in range(rng.randint(5, 60))])
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE  Two"), (104, " \n "), (105, "one two three"), (None, "one two"), (106, rows[3][1]), (106, rows[30][1]), (107, rows[7][1]), (107, rows[7][1]), (200, " ".join(base) * 300)]
    check(spark, rows, 4, 85)
    check(spark, rows, 5, 80)


def test_near_join_of_nothing(spark):
    assert check(spark, [], 5, 80) == []
    assert len(check(spark, [(1, None)], 5, 80)) == 1


@pytest.mark.parametrize("percent", [80, 85])
def test_tokens_needed_holds_for_all_sizes_of_a_group(spark, percent):
    need = lambda n, x: min(jaccard_groups.missable(n, percent) + 1 - n, jaccard_groups.missable(x, percent) + 1 - x) + -(-percent * (n + x) // (100 + percent))
    sizes = [(n, low, high) for n in range(1, 121) for low in range(n, n * 100 // percent + 1) for high in range(low, n * 100 // percent + 1)]
    got = spark.createDataFrame(sizes, "n long, low long, high long").withColumn("c", jaccard_groups.tokens_needed(F.col("n"), F.col("low"), F.col("high"), percent)).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert 1 <= r.c <= max(1, min(need(r.n, x) for x in range(r.low, r.high + 1))), r
        assert r.low < r.high or r.c == max(1, need(r.n, r.low))


@pytest.mark.parametrize(("percent", "n", "x"), [(85, 18, 19), (80, 13, 14), (80, 17, 19)])
def test_near_join_with_a_group_of_two_sizes(spark, percent, n, x):
    """q links with s by one first token; s and s2, a token larger, are one group."""
    words = [f"w{i}" for i in range(60)]
    hashes = np.concatenate(jaccard_groups.shingles(pa.array(words), 1))
    words = [words[i] for i in np.argsort(hashes)]
    o = -(-percent * (n + x) // (100 + percent))
    only_s, more, both, only_q = words[: x - o], words[x - o], words[x - o + 1 : x + 1], words[x + 1 : x + 1 + n - o]
    rows = [(1, " ".join(both + only_q)), (2, " ".join(only_s + both)), (3, " ".join([*only_s, more, *both]))]
    got = check(spark, rows, 1, percent)
    assert {r.component_id for r in got} == {1}
