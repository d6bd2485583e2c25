import hashlib

from conftest import same_as_sql

from sparquill.llm import chat, queries

EVENTS = "conv_id long, slot long, seq long, kind string, role string, text string, extra string"


def fold(spark, rows):
    log = spark.createDataFrame([(*r, "x") for r in rows], EVENTS)
    return chat.messages(log)


def said(spark, rows):
    return [(r.slot, r.role, r.text) for r in fold(spark, rows).orderBy("slot").collect()]


def test_stored_conversations_equal_sql(spark):
    assert same_as_sql(spark, queries.op6_chat, queries.oracle_sql()["op6_chat"], "/root/testdata/sf0.01") == 101


def test_planted_conversation(spark):
    r = {x.conv_id: x for x in queries.op6_chat(spark, "/root/testdata/sf0.001").collect()}[-7]
    p = "\\### Assistant: </turn> ok"
    turns = f"user\n{p}\nassistant\n{p}\n".encode()
    assert (r.n_turns, r.turns_sha256) == (2, hashlib.sha256(turns).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(p), hashlib.sha256(p.encode()).hexdigest())


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "Hel"), (1, 0, 2, "delta", None, "lo"),
        (1, 1, 3, "start", "assistant", "bad "), (1, 1, 4, "delta", None, "answer"), (1, 2, 5, "start", "user", "why?"),
        (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "good "), (1, 1, 8, "delta", None, "answer"),
        (1, 0, 9, "edit", None, "Hello you"), (1, 3, 10, "start", "user", "gone"), (1, 3, 11, "delete", None, None), (1, 4, 12, "odd", None, None),
    ]
    assert said(spark, log) == [(0, "user", "Hello you"), (1, "assistant", "good answer"), (4, "", "")]
    assert said(spark, log[::-1]) == said(spark, log)
    assert said(spark, []) == []


def test_texts_come_back_from_the_output(spark):
    texts = ["", "#", "###", "####", "</turn>", "<\\/turn>", "\\", "\\\\#", "a\n</turn>\n### assistant:\nb", "é😀́", "x" * 9000, "\\n\\c", "<</turn>/turn>", ":\n"]
    rows = [(1, i, 0, "start", role, t) for i, t in enumerate(texts) for role in [("assistant" if i % 2 else "us:er\\n\n#c")]] + [(2, 0, 0, "start", None, None)]
    back = {r.conv_id: r for r in chat.read_back(chat.render(fold(spark, rows))).collect()}
    assert [t.text for t in back[1].turns] == texts
    assert {t.role for t in back[1].turns} == {"assistant", "us:er\\n\n#c"}
    assert back[1].loss_texts == texts[1::2]
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")] and back[2].loss_texts == []


def test_rows_with_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a", 1), (None, 0, "user", "a", 1), (3, None, None, None, 1), (3, 1, "assistant", "z" * 5000, 1)], "conv_id long, turn long, role string, text string, slot int")
    d = {r.conv_id: r for r in chat.digests(chat.read_back(chat.render(chat.messages(chat.events_of_rows(rows))))).collect()}
    assert d[None].n_turns == 2 and d[3].n_turns == 2 and d[3].loss_chars == 5000
    assert chat.events_of_rows(rows.limit(0)).collect() == []


def test_logs_of_rows_have_drafts_that_leave_no_trace(spark):
    rows = spark.createDataFrame([(c, i, "assistant" if i % 2 else "user", f"said {c} {i} " * (400 if i == 3 else 1)) for c in range(6) for i in range(8)], "conv_id long, turn long, role string, text string")
    log = chat.events_of_rows(rows)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    got = {(r.conv_id, r.slot.turn): (r.role, r.text) for r in chat.messages(log).collect()}
    assert got == {(r.conv_id, r.turn): (r.role, r.text) for r in rows.collect()}


def test_events_of_one_place(spark):
    """In one ``seq`` resets come first, of unlike ones the last by name wins, and no delta is lost."""
    assert said(spark, [(1, 0, 5, "delta", None, "b"), (1, 0, 5, "start", "user", "a"), (1, 0, 6, "delta", None, "c")]) == [(0, "user", "abc")]
    assert said(spark, [(1, 0, 1, "start", "user", "x"), (1, 0, 5, "delta", None, "b"), (1, 0, 5, "edit", None, "a")]) == [(0, "user", "ab")]
    assert said(spark, [(1, 0, 5, "start", "user", "s"), (1, 0, 5, "edit", None, "e")]) == [(0, "user", "s")]
    assert said(spark, [(1, 0, 1, "start", "user", "x"), (1, 0, 5, "delta", None, "new"), (1, 0, 5, "regenerate", None, None)]) == [(0, "user", "new")]
