"""Odd-sketch near-duplicates against brute force."""

import random
import re
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeel.llm import oddsketch

SCHEMA = "id string, content_text string, created_at timestamp, digest string, copies int, r string, key string"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def df(spark, data):
    return spark.createDataFrame([(i, t, at, "x", 1, "y", "z") for i, t, at in data], SCHEMA)


def shingles(text, k):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}, len(words)


def brute(texts, k, threshold, least):
    sets = {i: s for i, t in texts.items() for s, n in [shingles(t, k)] if n >= max(least, k)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(rng, words, share):
    out = []
    for word in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"new{rng.randrange(10**6)}" if x < 2 * share / 3 else word)
        if x > 1 - share / 3:
            out.append(f"add{rng.randrange(10**6)}")
    return out


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for family in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        texts[f"{family:02d}-0"] = " ".join(words)
        for copy in range(1, 4):
            texts[f"{family:02d}-{copy}"] = " ".join(edited(rng, words, 0.01 * copy))
    want = {p for p in brute(texts, 3, 0.5, 40)}
    far = {p for p in brute(texts, 3, 0.45, 40)} - {p for p in brute(texts, 3, 0.55, 40)}
    got = {(r["id_a"], r["id_b"]) for r in oddsketch.near_duplicates(df(spark, [(i, t, T0) for i, t in texts.items()]), threshold=0.5, shingle=3, min_words=40, bands=90).collect()}
    assert got - far == want - far and len(want) >= 30


def test_default_is_five_words_at_eight_tenths(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10000)}" for _ in range(300)]
    texts = {"a": " ".join(words), "b": " ".join([*words[:-4], "x"]), "c": " ".join(words[150:] + words[:150]), "d": " ".join(words[:150])}
    got = {(r["id_a"], r["id_b"]) for r in oddsketch.near_duplicates(df(spark, [(i, t, T0) for i, t in texts.items()])).collect()}
    assert got == brute(texts, 5, 0.8, 1) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_deliveries_nulls_and_short_texts(spark):
    long = " ".join(f"w{i}" for i in range(80))
    data = [("a", "old text of few words", T0), ("a", long, T1), ("b", long.upper() + "!", T0), ("b", long.upper() + "!", T0), ("c", None, T0), ("d", "", T0), ("e", "too short", T0), (None, long, T0), ("f", long, T0), ("f", "gone now", T1)]
    got = oddsketch.near_duplicates(df(spark, data), threshold=0.5, shingle=3, min_words=40).collect()
    assert [(r["id_a"], r["id_b"], r["similarity"]) for r in got] == [("a", "b", 1.0)]


def test_copies_come_out_with_the_least_of_their_class(spark):
    long = " ".join(f"w{i}" for i in range(80))
    near = long + " x y"
    data = [(f"c{i}", long, T0) for i in range(5)] + [("n", near, T0)]
    every = {(r["id_a"], r["id_b"]) for r in oddsketch.near_duplicates(df(spark, data), threshold=0.5, shingle=3).collect()}
    assert len(every) == 10 + 5
    star = {(r["id_a"], r["id_b"]) for r in oddsketch.near_duplicates(df(spark, data), threshold=0.5, shingle=3, shown_copies=1).collect()}
    assert star == {("c0", f"c{i}") for i in range(1, 5)} | {("c0", "n")}


def test_edits_of_one_text_cost_linear_rows(spark):
    # Twenty thousand texts that differ in one word each: one class, and no more links than texts in each of the few pivots' stars.
    words = [f"w{i}" for i in range(120)]
    data = spark.range(20_000).selectExpr("cast(id as string) AS id", "timestamp '2024-01-01' AS created_at", f"replace('{' '.join(words)}', concat(' w', 1 + id % 118, ' '), concat(' e', id, ' ')) AS content_text")
    known, linked, near = oddsketch._linked(data, "id", "content_text", "created_at", 0.5, 3, 40, 20, 5, 256, 512, 0.2)
    assert known.count() == 20_000 and linked.count() < 20 * 20_000
    got = oddsketch.near_duplicate_classes(data, threshold=0.5, shingle=3, min_words=40, bands=20)
    assert [tuple(r) for r in got.groupBy("class_id").count().collect()] == [("0", 20_000)]


def test_classes_are_components_of_the_pairs(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    # A chain: each text shares enough with the next only.
    texts = {f"t{k}": " ".join(words[k * 20 : k * 20 + 100]) for k in range(6)} | {"u": " ".join(reversed(words)), "v": " ".join(reversed(words))}
    data = df(spark, [(i, t, T0) for i, t in texts.items()] + [("short", "a b", T0), ("none", None, T0)])
    got = {r["id"]: r["class_id"] for r in oddsketch.near_duplicate_classes(data, threshold=0.5, shingle=3, min_words=40, bands=90).collect()}
    assert got == {f"t{k}": "t0" for k in range(6)} | {"u": "u", "v": "u"}


def test_empty_table_and_one_very_long_text(spark):
    assert oddsketch.near_duplicates(df(spark, [])).count() == 0 and oddsketch.near_duplicate_classes(df(spark, [])).count() == 0
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    got = oddsketch.near_duplicates(df(spark, [("a", long, T0), ("b", long + " z", T0)])).collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [("a", "b")]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.5, 0.99))
def test_sketch_estimates_similarity(seed, share):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 32, int(400 * share), dtype=np.uint64).astype(np.uint32)
    own = [rng.integers(0, 1 << 32, 400 - len(common), dtype=np.uint64).astype(np.uint32) for _ in range(2)]
    a, b = (np.unique(np.concatenate([common, x])) for x in own)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sketcher = oddsketch.Sketcher(4, 4, 256, 512)
    sa, sb = (sketcher.odd_sketch(sketcher.minima(x)) for x in (a, b))
    ones = int(np.unpackbits((sa ^ sb).view(np.uint8)).sum())
    # Within five standard deviations of what is expected at the true similarity.
    assert abs(ones - oddsketch.expected_ones(true, 256, 512)) < 75


def test_equal_sets_share_every_band_and_sketch():
    sketcher = oddsketch.Sketcher(8, 3, 64, 128)
    x = np.arange(50, dtype=np.uint32)
    assert (sketcher.band_keys(sketcher.minima(x)) == sketcher.band_keys(sketcher.minima(x[::-1].copy()))).all()
    assert (sketcher.odd_sketch(sketcher.minima(x)) == sketcher.odd_sketch(sketcher.minima(x))).all()
