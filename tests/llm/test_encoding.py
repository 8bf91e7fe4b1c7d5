"""BPE encoding: exact round trips and safe splitting."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeel.llm import bpe

pytest.importorskip("tiktoken")
PATH, PATTERN = bpe.default_vocabulary()
CONTENT = open(PATH, "rb").read()  # noqa: SIM115
ENCODING = bpe._encoding(CONTENT, PATTERN)


def encoded(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, id string")
    return {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df, **kw).collect()}


def test_empty_null_special_and_repeated(spark):
    texts = ["", None, "<|endoftext|>", "Hello world", "Hello world", "  \n\t ", "naïve café — ß 漢字 🙂‍"]
    got = encoded(spark, texts)
    assert got[0] == got[1] == []
    assert got[2] == ENCODING.encode_ordinary("<|endoftext|>") and len(got[2]) > 1 and 50256 not in got[2]
    assert got[3] == got[4] == ENCODING.encode_ordinary("Hello world")
    assert got[6] == ENCODING.encode_ordinary(texts[6])


def test_round_trip(spark):
    texts = ["a b c", "", "x" * 1000, "Привет, мир!\r\nÑandú", "tab\tand  spaces   end "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(df)).collect()}
    assert back == dict(enumerate(texts))


def test_long_texts_split_like_whole_ones(spark):
    text = "It's one thing, 123 others; don't ask  why. " * 20_000 + "a" * 100_000 + "\n" * 1000
    assert encoded(spark, [text], block_chars=1000)[0] == ENCODING.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_pieces_never_change_the_ids(text, block):
    parts = bpe.pieces(text, block)
    assert "".join(parts) == text
    assert [i for p in parts for i in ENCODING.encode_ordinary(p)] == ENCODING.encode_ordinary(text)


def test_empty_table_and_broken_vocabulary(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(df).count() == 0
    monkeypatch.setattr(bpe, "MAX_RANK_FILE_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode_texts(df)
