"""SimHash near-duplicates, canonical records and quality gates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Bits of a hash in which near-duplicates may differ, and the bands that then must hold an equal one.
NEAR_BITS, BANDS = 3, 4


def simhash_words(text: Column) -> Column:
    """Lower-case words without signs at their ends."""
    bare = F.transform(T.words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^a-z0-9à-öø-ÿ]+|[^a-z0-9à-öø-ÿ]+$", ""))
    return F.filter(bare, lambda w: w != "")


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, hi, lo): the halves of a 64-bit SimHash over three-word shingles, as unsigned numbers.

    Texts of fewer than three words give 0 and 0. Each bit is the majority of
    that bit over the md5 of all shingles; ties give 0. One row in, one row out:
    words are split on the JVM side, votes are counted on whole arrays of bits,
    and nothing is shuffled.
    """
    base = docs.select(F.col(id_col).alias("id"), simhash_words(F.col(text_col)).alias("words"))

    def run(batches):
        for batch in batches:
            halves = np.zeros((batch.num_rows, 2), np.int64)
            for n, words in enumerate(batch.column(1).to_pylist()):
                if words and len(words) >= 3:
                    digests = b"".join([hashlib.md5(f"{a} {b} {c}".encode()).digest()[:8] for a, b, c in zip(words, words[1:], words[2:])])
                    votes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) * 2 - len(digests) // 8
                    halves[n] = np.packbits(votes > 0).view(">u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["id", "hi", "lo"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, hi long, lo long")


def near_pairs(hashes: DataFrame, most_bits: int = NEAR_BITS) -> DataFrame:
    """Rows (a, b, bits): records whose hashes differ in at most `most_bits` bits, a < b; hashes of 0 take no part.

    Equal hashes are collapsed first: each record of a class is paired with the
    class's least id (bits 0), and only those representatives are banded, so a
    hash that a third of all records share costs one row. With BANDS bands of
    16 bits no pair within NEAR_BITS bits is missed.
    """
    if most_bits >= BANDS:
        raise ValueError(f"{most_bits} bits need more than {BANDS} bands")
    some = hashes.filter("not (hi = 0 and lo = 0)")
    classes = some.groupBy("hi", "lo").agg(F.min("id").alias("id"))
    copies = some.join(classes.withColumnRenamed("id", "rep"), ["hi", "lo"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("bits"))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftright(F.col(c), s).bitwiseAND(F.lit(0xFFFF)).alias("key")) for i, (c, s) in enumerate((("hi", 0), ("hi", 16), ("lo", 0), ("lo", 16)))])
    rows = classes.select("id", "hi", "lo", F.explode(bands).alias("x")).select("id", "hi", "lo", "x.band", "x.key")
    left, right = rows.toDF("a", "ha", "la", "band", "key"), rows.toDF("b", "hb", "lb", "band", "key")
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) + F.bit_count(F.col("la").bitwiseXOR(F.col("lb")))
    pairs = left.join(right, ["band", "key"]).filter("a < b").select("a", "b", distance.alias("bits")).filter(F.col("bits") <= most_bits).distinct()
    return pairs.unionByName(copies)


def nearest_duplicate(pairs: DataFrame) -> DataFrame:
    """Rows (id, near_id, bits): for each record of `near_pairs` rows its partner of least distance, then least id."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("near_id"), "bits").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("near_id"), "bits"))
    return both.groupBy("id").agg(F.min(F.struct("bits", "near_id")).alias("m")).select("id", F.col("m.near_id").alias("near_id"), F.col("m.bits").alias("bits"))


def canonical(groups: DataFrame, group_col: str, seen_col: str, key_col: str) -> DataFrame:
    """`groups` with canonical: in each group the record seen first, then the one of the smaller key; unknown times come last."""
    first = Window.partitionBy(group_col).orderBy(F.col(seen_col).asc_nulls_last(), F.col(key_col).asc())
    return groups.withColumn("canonical", F.row_number().over(first) == 1)


def gates(docs: DataFrame, text_col: str, host: Column | None = None) -> DataFrame:
    """`docs` with status: the first gate that a record fails (empty, unsafe, thin), else passed."""
    text = F.col(text_col)
    unsafe = T.is_unsafe_text(text) | (T.is_unsafe_host(host) if host is not None else F.lit(False))
    status = F.when(T.word_count(text) < T.VALID_WORDS, "empty").when(unsafe, "unsafe").when(T.word_count(text) < T.INDEX_WORDS, "thin").otherwise("passed")
    return docs.withColumn("status", status)
