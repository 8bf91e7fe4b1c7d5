"""Near-duplicate records by banded MinHash and odd sketches.

Problem 5. MinHash samples of a record's word shingles are cut into bands for
candidate search and folded into a parity bitmap, the odd sketch. The number of
ones in the XOR of two bitmaps estimates how many samples differ; candidates
whose estimate comes near the threshold are then held against their whole
shingle sets.

Records of one text form a class, of which one is compared. Within a band
bucket each record is held against the bucket's least record first, its pivot;
only records that are not close to their pivot are held against the rest. Two
records close to one pivot are similar by the triangle inequality of the
Jaccard distance, so a bucket of n small edits of one text costs n comparisons.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..runtime import cut

WORD = re.compile(r"[^\W_]+")
#: Keys of records that are broadcast at most, about a hundred bytes each.
MAX_SENT_ROWS = 200_000
#: Words kept with their hashes in one worker at most.
WORD_CACHE = 1 << 20
_words: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the maximal runs of letters and digits of the lower-cased text."""
    if len(_words) > WORD_CACHE:
        _words.clear()
    out = []
    for word in WORD.findall(text.lower()):
        h = _words.get(word)
        if h is None:
            h = _words[word] = xxhash.xxh64_intdigest(word)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of all runs of `size` words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(count, np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


class Sketcher:
    """MinHash samples, band keys and odd sketch of a shingle set."""

    def __init__(self, bands: int, rows: int, samples: int, bits: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.samples = samples
        k = max(bands * rows, samples)
        self.a = (rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        return (self.a * shingles[None, :] + self.b).min(axis=1)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        part = minima[: self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, i])
        return h.view(np.int64)

    def odd_sketch(self, minima: np.ndarray) -> np.ndarray:
        m = self.samples
        at = (_mix(minima[:m].astype(np.uint64) + self.salt[:m]) >> np.uint64(32)) % np.uint64(self.bits)
        parity = (np.bincount(at.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return np.packbits(parity).view(np.int64)


def expected_ones(similarity: float, samples: int, bits: int) -> float:
    """Expected ones in the XOR of the odd sketches of two sets of this similarity."""
    return bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits))


def estimate(ones: Column, samples: int, bits: int) -> Column:
    """The similarity at which so many ones are expected; 0 where the bitmap says nothing more."""
    inside = F.lit(1.0) - ones * (2.0 / bits)
    return F.when(inside > 0, F.greatest(F.lit(0.0), 1 + F.log(inside) * (bits / (4.0 * samples)))).otherwise(F.lit(0.0))


def _ones(a: str, b: str, words: int) -> Column:
    total = F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0]))
    for i in range(1, words):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _texts_of(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (*chosen, text) for each of `chosen` (id, digest, ...), however often it is delivered."""
    texts = df.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    more = [c for c in chosen.columns if c not in ("id", "digest")]
    return texts.join(chosen, ["id", "digest"]).groupBy("id", "digest").agg(*[F.first(c).alias(c) for c in more], F.first("text").alias("text"))


def _sketched(texts: DataFrame, sketcher: tuple[int, int, int, int], shingle: int, min_words: int) -> DataFrame:
    """Rows (id, digest, r, keys, sketch) of `texts` (id, digest, text) that are long enough."""
    schema = f"id {texts.schema['id'].dataType.simpleString()}, digest string, keys array<long>, sketch array<long>"

    def run(batches):
        made = Sketcher(*sketcher)
        for batch in batches:
            at, keys, sketches = [], [], []
            for n, text in enumerate(batch.column(2).to_pylist()):
                words = word_hashes(text)
                if len(words) >= max(min_words, shingle):
                    minima = made.minima(shingle_hashes(words, shingle))
                    at.append(n)
                    keys.append(made.band_keys(minima))
                    sketches.append(made.odd_sketch(minima))
            if at:
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), _lists(keys, pa.int64()), _lists(sketches, pa.int64())], names=["id", "digest", "keys", "sketch"])

    return texts.select("id", "digest", "text").mapInArrow(run, schema).withColumn("r", F.xxhash64("id"))


def _shingled(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row (r, shingles) for each of `chosen` (r, id, digest): the whole set of its text."""

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(word_hashes(text), shingle).view(np.int32) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets, pa.int32())], names=["r", "shingles"])

    return _texts_of(df, chosen, id_col, text_col).select("r", "text").mapInArrow(run, "r long, shingles array<int>")


def _linked(df: DataFrame, id_col: str, text_col: str, order_col: str | None, threshold: float, shingle: int, min_words: int, bands: int, rows: int, samples: int, bits: int, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records (id, r, digest, copies, rep), compared links (r1, r2, similarity) of representatives, those (m, r, similarity) of pivots and what is close to them)."""
    order = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    deliveries = df.select(F.col(id_col).alias("id"), order.alias("at"), F.md5(F.col(text_col)).alias("digest")).filter("id is not null")
    last = deliveries.groupBy("id").agg(F.max(F.struct("at", "digest")).alias("last")).select("id", F.col("last.digest").alias("digest"))
    ids = cut(last.filter("digest is not null"))
    classes = ids.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    texts = _texts_of(df, classes.select("id", "digest"), id_col, text_col)
    chosen = cut(_sketched(texts, (bands, rows, samples, bits), shingle, min_words))

    banded = chosen.select("r", F.explode("keys").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("r").alias("m"), F.count("*").alias("n")).filter("n > 1").select("key", "m")
    members = cut(banded.join(pivots, "key"))
    active = cut(members.select("r").distinct())
    # Few records meet another; where they are so few they are sent to the texts, else both are shuffled.
    few = active.count() <= MAX_SENT_ROWS
    sent = F.broadcast if few else lambda side: side
    sketches = cut(chosen.join(sent(active), "r").select("r", "id", "digest", "sketch"))
    sets = cut(_shingled(df, sent(sketches.select("r", "id", "digest")), id_col, text_col, shingle))
    sketches = sketches.select("r", "sketch")
    most = math.ceil(expected_ones(threshold - slack, samples, bits))

    def compared(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sketches.toDF("r1", "s1"), "r1").join(sketches.toDF("r2", "s2"), "r2")
        close = met.filter(_ones("s1", "s2", bits // 64) <= most).select("r1", "r2")
        both = close.join(sets.toDF("r1", "h1"), "r1").join(sets.toDF("r2", "h2"), "r2")
        common = F.size(F.array_intersect("h1", "h2"))
        return both.select("r1", "r2", (common / (F.size("h1") + F.size("h2") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)

    star = members.filter("r <> m").select(F.col("m").alias("r1"), F.col("r").alias("r2")).distinct()
    first = cut(compared(star))
    # Half the distance allowed: any two records so close to one pivot are similar enough.
    near = first.filter(F.col("similarity") >= (1 + threshold) / 2).toDF("m", "r", "similarity")
    apart = members.filter("r <> m").join(near.select("m", "r"), ["m", "r"], "left_anti").select("key", F.col("r").alias("x"))
    others = apart.join(members.filter("r <> m").select("key", F.col("r").alias("y")), "key").filter("x <> y")
    rest = others.select(F.least("x", "y").alias("r1"), F.greatest("x", "y").alias("r2")).distinct()
    second = cut(compared(rest))
    known = ids.join(classes.select("digest", F.col("id").alias("rep"), "copies"), "digest")
    known = known.join(chosen.select(F.col("id").alias("rep"), "r"), "rep")
    return known, first.unionByName(second).distinct(), near


def near_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "content_text",
    order_col: str | None = "created_at",
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int = 1,
    bands: int = 24,
    rows: int = 5,
    samples: int = 256,
    bits: int = 512,
    slack: float = 0.2,
    shown_copies: int = 8,
) -> DataFrame:
    """Pairs (id_a, id_b, similarity), id_a < id_b, of records whose shingle sets have at least this Jaccard similarity.

    Null, empty and short texts (fewer than `min_words` or `shingle` words) and
    null ids take no part; an empty table gives no rows; other columns are
    ignored. Of an id delivered several times the last by `order_col` counts.
    Records of one text form a class, represented by its least ids. A member
    comes out with the `shown_copies` least ids of its class (the membership),
    and a link of two texts with as many of either; so a text held by a third
    of all rows gives so many rows a copy at every size, and no link between
    different texts is lost. With 1 there is one representative; `near_duplicate_classes`
    gives one row a record.

    A pair of similarity s shares a band with probability 1-(1-s^rows)^bands.
    `slack` is how far below `threshold` an odd-sketch estimate may lie for the
    exact check; it should be three standard deviations of the estimate or more.
    The similarity is exact for compared pairs; for two records that are close
    to one pivot it is the least that their similarities to it allow.
    """
    known, linked, near = _linked(df, id_col, text_col, order_col, threshold, shingle, min_words, bands, rows, samples, bits, slack)
    left, right = near.toDF("m", "r1", "x"), near.toDF("m", "r2", "y")
    implied = left.join(right, "m").filter("r1 < r2").select("r1", "r2", (F.col("x") + F.col("y") - 1).alias("similarity"))
    pairs = linked.unionByName(implied).groupBy("r1", "r2").agg(F.max("similarity").alias("similarity"))
    # Of each class the least ids; the limit on the rank is applied before the shuffle.
    few = cut(known.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= shown_copies).select("rep", "r", F.col("id").alias("few")))
    between = pairs.join(few.select(F.col("r").alias("r1"), F.col("few").alias("x")), "r1").join(few.select(F.col("r").alias("r2"), F.col("few").alias("y")), "r2").select("x", "y", "similarity")
    several = known.filter("copies > 1").select("rep", "id").join(few.select("rep", "few"), "rep").filter("id <> few")
    inside = several.select(F.least("id", "few").alias("x"), F.greatest("id", "few").alias("y")).distinct().withColumn("similarity", F.lit(1.0))
    every = between.unionByName(inside)
    return every.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"), "similarity")


def near_duplicate_classes(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "content_text",
    order_col: str | None = "created_at",
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int = 1,
    bands: int = 24,
    rows: int = 5,
    samples: int = 256,
    bits: int = 512,
    slack: float = 0.2,
) -> DataFrame:
    """One row (id, class_id) for each record with a text long enough: the least id of those it is linked to, over any number of links.

    Classes are the connected components of the pairs of `near_duplicates`,
    whose docstring says what nulls, repeated ids and short texts give. Pairs
    that two records' nearness to one pivot implies are not made, since both
    are linked to the pivot; n small edits of one text cost n rows.
    """
    known, linked, _ = _linked(df, id_col, text_col, order_col, threshold, shingle, min_words, bands, rows, samples, bits, slack)
    parts = components(linked.select(F.col("r1").alias("src"), F.col("r2").alias("dst"))).withColumnRenamed("node", "r")
    placed = cut(known.join(parts, "r", "left").withColumn("component", F.coalesce("component", "r")))
    least = placed.groupBy("component").agg(F.min("id").alias("class_id"))
    return placed.join(least, "component").select(F.col("id").alias(id_col), "class_id")


def _lists(arrays: list, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy arrays; None is null."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in arrays], out=ends[1:])
    values = [x for x in arrays if x is not None]
    empty = pa.array([x is None for x in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind), mask=empty if len(values) < len(arrays) else None)
