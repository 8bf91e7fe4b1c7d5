"""Encoding of a corpus with a public byte-level BPE vocabulary.

Problem 7. The tiktoken library runs with a local rank file; long texts are
split beforehand where the splitting pattern must break anyway, and decoding
joins raw bytes. Tokenizers are never trained here.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank files are a few hundred KB; a larger one is refused, since it is broadcast.
MAX_RANK_FILE_BYTES = 64 << 20
#: A letter run after one space always starts a new pre-token there, so a text
#: may be cut before such a space without changing any id.
SAFE_BREAK = regex.compile(r"(?<=\S)(?= \p{L})")
_ENCODINGS: dict = {}


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of an installed public rank file and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """The token bytes and ids of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def _encoding(content: bytes, pattern: str):
    import tiktoken

    key = hash((content, pattern))
    if key not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=parse_ranks(content), special_tokens={})
    return _ENCODINGS[key]


def pieces(text: str, block_chars: int) -> list[str]:
    """`text` cut at safe breaks into pieces of about `block_chars`; a stretch without a safe break stays whole."""
    if len(text) <= block_chars:
        return [text]
    out, start = [], 0
    while len(text) - start > block_chars:
        found = SAFE_BREAK.search(text, start + block_chars)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


def encode_texts(df: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 16) -> DataFrame:
    """One row (id, ids array<int>) for each row of `df`.

    Null and empty texts give an empty list. Strings that spell a special
    token are plain text. A null id is kept; repeated rows come out as often as
    they came in; other columns are ignored; an empty table gives no rows. The
    plan is one scan with no shuffle: the vocabulary file (of checked size) is
    read on the driver and broadcast.
    """
    if rank_file is None or pattern is None:
        known = default_vocabulary()
        rank_file, pattern = rank_file or known[0], pattern or known[1]
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(_read(rank_file))
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        encoding = _encoding(content.value, pattern)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                if text:
                    for piece in pieces(text, block_chars):
                        flat += encoding.encode_ordinary(piece)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return chosen.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id, text) for each row of `df`: the bytes of all ids joined, then read as UTF-8.

    Ids are joined as bytes first, so that characters split over several ids
    come out whole. An empty or null list gives an empty text; an unknown id is
    an error.
    """
    if rank_file is None or pattern is None:
        known = default_vocabulary()
        rank_file, pattern = rank_file or known[0], pattern or known[1]
    content = df.sparkSession.sparkContext.broadcast(_read(rank_file))
    chosen = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    id_type = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        encoding = _encoding(content.value, pattern)
        for batch in batches:
            texts = [encoding.decode_bytes(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return chosen.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def token_count(ids: Column) -> Column:
    """Number of ids; 0 for null."""
    return F.coalesce(F.size(ids), F.lit(0))
