"""Every registered query with SQL against DuckDB over whole tables of the smallest scale."""

import pytest
from conftest import same_as_sql

from sparquill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_title_similarity_equals_the_library(spark):
    from difflib import SequenceMatcher

    for r in catalogue.queries()["q_title_similarity"](spark, SF).collect():
        assert abs(r.ratio - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-6


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_documents_that_only_begin_alike_are_all_kept(spark, tmp_path):
    head = "A header that all the pages of one site begin with. "
    rows = [(1, head + "One"), (2, head + "two words"), (3, head.upper() + "ONE!"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["q_dedupe_best"](spark, str(tmp_path)).collect()
    assert sorted((r.first_seen, r.doc_id) for r in got) == [(1, 1), (2, 2), (4, 4)]


def test_best_documents_are_merged_and_are_evidence(spark, tmp_path):
    """Documents 1 to 13 have 12 to 0 words between the terms, so the best have the greatest ids."""
    docs = [(i, "alpha " + "x " * (13 - i) + "beta gamma") for i in range(1, 14)]
    docs += [(i, "alphb x x be ga") for i in (21, 22, 23)] + [(24, "alphb be ga part piece")]
    asked = [(1, "w1 w2 alpha w4 beta w6 w7 gamma"), (2, "w1 part alphb piece be w6 w7 ga")]
    vectors = [(50, [1.0, 0.0]), (13, [1.0, 0.1]), (1, [0.0, 1.0])]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", asked, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    text = dict(sorted(((i, 1 / (14 - i)) for i in range(1, 14)), key=lambda x: -x[1])[:10])
    near = {50: 1.0, 13: 1 / 1.01**0.5, 1: 0.0}
    total = {i: 0.45 * text.get(i, 0) + 0.55 * near.get(i, 0) + 0.05 * (text.get(i, 0) > 0 and near.get(i, 0) > 0) for i in text | near}
    mode = lambda i: "hybrid" if i in text and i in near else "text" if i in text else "vector"
    want = [(i, mode(i)) for i in sorted(total, key=lambda i: -total[i])[:5]]
    got = sorted((r for r in catalogue.queries()["q_hybrid"](spark, str(tmp_path)).collect() if r.query_id == 50), key=lambda r: r.place)
    assert [(r.id, r.retrieval_mode) for r in got] == want and all(abs(r.score - total[r.id]) < 1e-3 for r in got)
    assert {r.query_id: r.verdict for r in catalogue.queries()["q_evidence"](spark, str(tmp_path)).collect()} == {1: "reference_supported", 2: "generic_support"}
