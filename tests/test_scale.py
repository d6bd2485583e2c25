"""Steps whose cost grew faster than the input, or stayed in one task."""

from sparquill.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parts(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{path}/part.parquet")


def test_pages_of_answers_never_hold_a_whole_surface(spark, tmp_path):
    parts(spark, tmp_path, [(k, "bolt", "B" if k < 30 else None, "STEEL", 3, 1.0) for k in range(35)])
    got = catalogue.queries()["q_search_products"](spark, str(tmp_path))
    assert "explode(sequence" not in plan_of(got)
    # products without a name (6 of each 7 have one) are on their pages and give no record
    want = [("B" if k < 30 else None, (k if k < 30 else k - 30) // 10 * 10, f"bolt {k}") for k in range(35) if k % 7 != 6]
    assert sorted((tuple(r) for r in got.select("surface", "offset", "product_name").collect()), key=repr) == sorted(want, key=repr)


def test_dear_expressions_over_one_small_file_are_dealt_over_tasks(spark, tmp_path):
    parts(spark, tmp_path, [(k, "bolt nut", "B", "STEEL", 3, 1.0) for k in range(50)])
    for name in ("q_slugs", "q_card_lines"):
        got = catalogue.queries()[name](spark, str(tmp_path))
        above, below = plan_of(got).split("RepartitionByExpression")
        # nothing is computed before, not by a filter that was pushed down either
        assert "regexp" in above and "regexp" not in below
        assert got.count() == (50 if name == "q_slugs" else 40)


def test_texts_are_normalised_once_for_all_families(spark, tmp_path):
    rows = [(1, "Filtros y bombas de FRENO"), (2, "guía lateral, kit distribución"), (3, None), (4, "nada")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["q_taxonomy"](spark, str(tmp_path))
    assert plan_of(got).count("[^a-z0-9]+") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, "brake_system,filters"), (2, "accessories_misc,belts_tensioners,body_panels"), (3, ""), (4, "")]


def test_staged_items_are_merged_with_pairs_not_broadcast(spark):
    got = catalogue.queries()["q_rule_score"](spark, "/root/testdata/sf0.001")
    assert "strategy=merge" in plan_of(got)
    assert "BroadcastHashJoin [item_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_arrivals_of_a_stream_keep_the_parts_of_their_table(spark, tmp_path, monkeypatch):
    from sparquill.plans import view_queries

    monkeypatch.setattr(view_queries, "shared_folder", lambda spark: f"{tmp_path}/shared")
    # the event without an id comes with the last arrival only
    rows = [(k, k % 3, None) for k in range(40)] + [(None, 7, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["q_stream_dedupe"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(0, 0, 14), (1, 1, 13), (2, 2, 13), (7, None, 1)]
    assert all(len(list(tmp_path.glob(f"shared/stream-*/in/{part}/*.parquet"))) == 4 for part in "abc")
    # a batch for each arrival
    assert len(list(tmp_path.glob("shared/stream-*/out/_stream=stream/_batch=*"))) == 3


def test_sink_holds_no_keys_of_a_whole_split(spark, tmp_path, monkeypatch):
    from sparquill.streaming import incremental

    seen = []
    lacking = incremental._lacking
    monkeypatch.setattr(incremental, "_lacking", lambda *a: seen.append(lacking(*a)) or seen[-1])
    sink = incremental.idempotent_append(spark, f"{tmp_path}/out", ["a"], buckets=2)
    for number, rows in enumerate(([(1, "x"), (1, "x"), (None, "n")], [(1, "y"), (2, "z"), (2, "z"), (None, "m")])):
        sink(spark.createDataFrame(rows, "a long, b string"), number)
    assert sorted(map(repr, incremental.appended(spark, f"{tmp_path}/out").collect())) == ["Row(a=1, b='x')", "Row(a=2, b='z')", "Row(a=None, b='n')"]
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        # one deal by keys, which rows and known keys share; no partial results before it
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Join" not in plan
