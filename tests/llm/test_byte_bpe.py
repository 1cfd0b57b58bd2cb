"""Byte-level BPE against the public library."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from packetloom.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(byte_bpe.VOCABULARY)
CASES = [
    "", None, "a" * 2000, "  \t\n x  y z  ", "İstanbul İ ı", "don't I'LL we'd 12345 ٣٤٥ ½²", "🙂🙃 \U0001f9d1‍\U0001f4bb", "　　日本語", "\x00\x01\x85\x1c\x1d\x1e\x1f ok",
    "'s 's't", "﻿x", "x" * 70 + "Zürich" * 40, "\U0001e900\U00010400\U0001d7ce", "-" * 270, " " * 500 + "a", "\n" * 300, "same words same words", "same words same words",
]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_ids_and_bytes_are_the_librarys(spark, library):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for row in byte_bpe.encode(df, PATH).withColumn("back", byte_bpe.decode(F.col("ids"), PATH)).collect():
        text = CASES[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text), text
        assert bytes(row.back) == text.encode()


def test_the_size_of_the_literal_changes_nothing(spark, library):
    df = spark.createDataFrame([(1, "the cat and the other cat; the dog")], "doc_id long, text string")
    for head in (0, 1, 100):
        assert byte_bpe.encode(df, PATH, head=head).first().ids == library.encode_ordinary("the cat and the other cat; the dog")


def test_query_on_all_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[row.doc_id].encode()))


def test_columns_stay_and_empty_tables_are_empty(spark):
    df = spark.createDataFrame([(1, "a b", "kept", [7])], "doc_id long, text string, word string, ids array<int>")
    row = byte_bpe.encode(df, PATH).first()
    assert (row.doc_id, row.word, len(row.ids)) == (1, "kept", 2)
    assert byte_bpe.digests(df.where("false"), PATH).count() == 0


def test_unknown_ids_give_null(spark):
    df = spark.createDataFrame([([1, 70_000],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(byte_bpe.decode(F.col("ids"), PATH)).collect()] == [None, None, b""]


def test_rank_files(tmp_path):
    for name in (byte_bpe.VOCABULARY, "byte_bpe_multi_50k.tiktoken"):
        assert byte_bpe.unreachable(byte_bpe.read_ranks(public_tokenizers.path(name))) == []
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "few"))


def test_a_plan_has_each_table_once(spark):
    df = spark.createDataFrame([(1, "abcb")], "doc_id long, text string")
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"cb": 257, b"abcb": 258, b"bc": 259}
    coded = df.select(byte_bpe._encoder(df, ranks)(F.col("text")).alias("ids"))
    assert coded.first().ids == [258]
    assert coded._jdf.queryExecution().analyzed().toString().count("from_json(") == 2


def test_words_at_the_border_of_marks_as_bits(spark, library):
    texts = ["x" * n + "ab" * k for n in (57, 58, 59, 60, 61, 62, 63, 64) for k in (0, 1, 2)] + ["thequick" * 8 + "z" * n for n in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_bpe.encode(df, PATH, head=0).collect():
        assert row.ids == library.encode_ordinary(texts[row.doc_id]), row.text
