"""Live scores, filling and seeds."""

import pytest
from pyspark.sql import functions as F

from lorekeel.operators import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


TERMS = ["cve-2024-1", "rust"]


def test_lexical_relevance(spark):
    terms = F.array(*[F.lit(t) for t in TERMS])
    score = lambda title, body, t=terms: one(spark, live.lexical_relevance(t, F.lit(title), F.lit(body)))
    assert score("CVE 2024 1 in Rust", "") == pytest.approx(1.0) and score("", "nothing") == 0.0 and 0 < score("", "rust") < score("rust", "") < 1
    assert score("x", "y", F.array().cast("array<string>")) == 0.5


def test_live_score_is_zero_without_a_match_and_within_bounds(spark):
    terms = F.array(F.lit("rust"))
    score = lambda lexical, url="https://docs.rs/x", n=4: one(spark, live.live_score(terms, F.lit(lexical), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(url), F.lit(n)))
    assert score(0.0) == 0.0 and score(1.0) == 1.0 and score(1.0, "https://www.reddit.com/r", 1) == pytest.approx(0.45) and 0 < score(0.5, "https://x.example/", 1) < score(1.0, "https://x.example/", 1)


def test_sparse_fill(spark):
    schema = "query_id int, url string, score double"
    results = spark.createDataFrame([(1, "https://a.example/?utm_source=x", 0.9)], schema)
    store = spark.createDataFrame([(1, "https://a.example/", 9.0), (1, "https://b.example/", 3.0), (1, "https://c.example/", 2.0), (1, "https://d.example/", 1.0), (2, "https://e.example/", 1.0)], schema)
    got = {(r["query_id"], r["url"]): (round(r["score"], 6), r["rank"]) for r in live.sparse_fill(results, store, 3, F.lit(True)).collect()}
    assert got == {(1, "https://a.example/?utm_source=x"): (0.9, 1), (1, "https://b.example/"): (0.49, 2), (1, "https://c.example/"): (0.395, 3), (2, "https://e.example/"): (0.4, 1)}


@pytest.mark.parametrize(("a", "b", "want"), [("secure", "security", True), ("rust", "rusty", True), ("chain", "ai", True), ("sec", "sed", False), ("cat", "dog", False)])
def test_topics_match(spark, a, b, want):
    assert one(spark, live.topics_match(F.lit(a), F.lit(b))) is want


def test_floors(spark):
    rows = lambda *rs: spark.createDataFrame([(f"u{n}", r) for n, r in enumerate(rs)], "url string, relevance double")
    assert {r["url"] for r in live.two_tier_floor(rows(0.9, 0.6, 0.3)).collect()} == {"u0", "u1"}
    assert [r["url"] for r in live.two_tier_floor(rows(0.3, 0.5, 0.1), most=1).collect()] == ["u1"]
    assert live.two_tier_floor(rows(0.1)).count() == 0


def test_topic_and_pipeline_scores(spark):
    topics = F.array(F.lit("rust"), F.lit("async"))
    assert one(spark, live.topic_relevance(F.lit("https://x.example/RUST"), topics, F.lit("About async"), F.lit(None).cast("string"))) == pytest.approx(0.5)
    assert one(spark, live.topic_relevance(F.lit("u"), F.array().cast("array<string>"))) == 0.5
    assert one(spark, live.pipeline_score(F.lit(0.2), F.lit(0.8), F.lit(0.5), F.lit(1.0), F.lit("primary_official"))) == pytest.approx(0.6)
