import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers
from pyspark.sql import functions as F

from sparquill.llm import queries, token_counts, token_output
from sparquill.llm.common import Workspace

ODD = [
    None, "", " ", "a", "aaaaaaaaaaaaaaaaa", "abababababab", "don't I'M we'll x's", "\n\n\n a\t\tb   c ", "\x1c\x1d x\x85y\xa0z w", "́a é é",
    "😀😀👩‍👩‍👧", "x" * 5000, "ab c" * 3000, "１２３ ٣٤ 5", "a<|endoftext|>b  <|endoftext|><|startoftext|>", "İ ŉ ß ΑΣ Σ", "   q", "!!!...??? ,,a", "".join(map(chr, range(0x20, 0x2000))),
]


def texts(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "kept", 5) for i, t in enumerate(rows)], "doc_id long, text string, part string, n_tokens int")


@pytest.fixture(scope="module")
def byte_library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library_on_odd_texts(spark, byte_library):
    got = {r.doc_id: r for r in token_counts.token_counts(texts(spark), public_tokenizers.path("byte_bpe_50k.json"), limit=3).collect()}
    for i, t in enumerate(ODD):
        n = len(byte_library.encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit, got[i].part) == (len((t or "").encode()), n, n > 3, "kept")


def test_counts_equal_the_library_on_all_documents(spark, byte_library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(byte_library.encode(r.text or "", add_special_tokens=False)) for r in docs}
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()} == want


def test_windows_of_long_texts(byte_library, monkeypatch):
    monkeypatch.setattr(token_counts, "WINDOW", 50)
    text = "word  another\n\nline of text's end   " * 40 + "y" * 500
    assert token_counts.MergeCounter(public_tokenizers.path("byte_bpe_50k.json")).counts(pa.array([text, None, text])).tolist() == [len(byte_library.encode(text)), 0, len(byte_library.encode(text))]


@pytest.mark.parametrize("cap", [5, 400_000])
@pytest.mark.parametrize("window", [1 << 22, 40])
def test_counts_equal_the_library_on_random_texts(byte_library, monkeypatch, window, cap):
    monkeypatch.setattr(token_counts, "WINDOW", window)
    monkeypatch.setattr(token_counts, "CACHE", cap)
    own = token_counts.MergeCounter(public_tokenizers.path("byte_bpe_50k.json"))
    signs = [*"''stmdrelvabXY019 .,-  \n\t\x1c\x85\xa0\xad", "ª", "²", "½", "×", "É", "é", "\u0301", "Σ", "你好", "\u2003", "\u3000", "\u200b", "😀", "𝟘", "٣", "'s", "'re", "'LL", "'ll", " 't", "<|endoftext|>"]
    pick = random.Random(7)
    for _ in range(40):
        some = ["".join(pick.choices(signs, k=pick.randrange(60))) for _ in range(50)]
        assert own.counts(pa.array(some)).tolist() == [len(byte_library.encode(t, add_special_tokens=False)) for t in some]


def test_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(texts(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def expected(rows):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = {}, 0
    for i, t in sorted(rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_output_round_trip(spark, encoding):
    ws = Workspace(spark, "t")
    token_output.write_tokens(texts(spark).withColumnRenamed("n_tokens", "ids"), ws.path("x"), public_tokenizers.path("word_bpe_49k.json"), parts=3, encoding=encoding)
    got = token_output.token_digests(token_output.read_tokens(spark, ws.path("x"))).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected(enumerate(ODD))


def test_output_of_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op10_token_output(spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected((r.doc_id, r.text) for r in docs)


def test_output_of_equal_ids_nulls_and_no_rows(spark):
    ws = Workspace(spark, "t")
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string")
    token_output.write_tokens(rows, ws.path("x"), public_tokenizers.path("word_bpe_49k.json"), parts=2)
    got = token_output.token_digests(token_output.read_tokens(spark, ws.path("x"))).orderBy("start").collect()
    assert [r.start for r in got] == [0, 2, 4, 6] and got[0].doc_id is None
    token_output.write_tokens(rows.where(F.lit(False)), ws.path("y"), public_tokenizers.path("word_bpe_49k.json"))
    assert token_output.token_digests(token_output.read_tokens(spark, ws.path("y"))).collect() == []


@pytest.mark.parametrize("cap", [0, 1, 5, 31])
def test_encoder_of_more_words_than_it_remembers(monkeypatch, cap):
    monkeypatch.setattr(token_output, "CACHE", cap)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, enc = tokenizers.Tokenizer.from_file(path), token_output.WordEncoder(path)
    steps = [["known before"], [" ".join(f"id{i}x{i * 7}" for i in range(31)), "known again, before"], ["known before", None, "a"], [" ".join(f"W{i}," for i in range(40))], ODD]
    for texts in steps:
        check_encoder(enc, lib, texts)


def check_encoder(enc, lib, texts):
    ids, at = enc.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("step", [1 << 22, 40])
def test_encoder_equals_the_library_on_random_texts(monkeypatch, step):
    """Signs whose class, case or composition matters, in any order; also with texts cut into windows."""
    monkeypatch.setattr(token_output, "STEP_BYTES", step)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, enc = tokenizers.Tokenizer.from_file(path), token_output.WordEncoder(path)
    signs = [*"''smtdrevlabXYZ019 .,-\n\t\x1c\x85\xa0\xad", "ª", "µ", "º", "²", "½", "×", "÷", "ß", "É", "ÿ", "Þ", "À", "é", "\u0301", "\u030a", "Ā", "İ", "Σ", "你", "\u2003", "\u200b", "😀", "'s", "'re", "'LL", "<|endoftext|>"]
    pick = random.Random(7)
    for _ in range(40):
        check_encoder(enc, lib, ["".join(pick.choices(signs, k=pick.randrange(60))) for _ in range(50)])
