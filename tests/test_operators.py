"""Fusion, ranking, search, duplicates, graphs, logs and streams on small inputs."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeel.operators import dedup, fusion, graph, lexical, logs, rank, vector
from lorekeel.operators.router import route
from lorekeel.streaming import streams

HITS = "query_id int, list_no int, engine string, rank int, weight double, url string, title string, snippet string"


def hits(spark, rows):
    return spark.createDataFrame([(1, n, e, r, w, u, f"{e}-{u}", "") for n, e, r, w, u in rows], HITS)


def test_rrf_adds_contributions_and_takes_the_first_list(spark):
    rows = [(0, "a", 2, 1.0, "https://x.example/p?utm_source=q"), (1, "b", 1, 2.0, "https://X.example/p"), (1, "b", 2, 2.0, "https://y.example/")]
    got = {r["url"]: r for r in fusion.reciprocal_rank_fusion(hits(spark, rows)).collect()}
    x = got["https://x.example/p?utm_source=q"]
    assert x["score"] == pytest.approx(1 / 62 + 2 / 61) and x["engine_count"] == 2 and x["engines"] == ["a", "b"] and x["title"].startswith("a-")
    assert got["https://y.example/"]["score"] == pytest.approx(2 / 62)


def test_negative_weights_count_nothing_and_k_is_one_at_least(spark):
    assert fusion.reciprocal_rank_fusion(hits(spark, [(0, "a", 1, -1.0, "https://x.example/")])).first()["score"] == 0
    assert fusion.reciprocal_rank_fusion(hits(spark, [(0, "a", 1, 1.0, "https://x.example/")]), k=0).first()["score"] == 0.5


def test_normalised_scores_lie_between_and_equal_ones_are_one(spark):
    rng = random.Random(1)
    rows = [(0, "a", n + 1, rng.random(), f"https://x{n}.example/") for n in range(30)]
    scores = [r["score"] for r in fusion.normalised(fusion.reciprocal_rank_fusion(hits(spark, rows))).collect()]
    assert max(scores) == pytest.approx(1.0) and min(scores) == pytest.approx(0.4)
    same = fusion.normalised(fusion.reciprocal_rank_fusion(hits(spark, rows[:1])))
    assert same.first()["score"] == 1.0


def test_concepts_keep_all_engines_and_join_home_pages(spark):
    rows = [(0, "a", 1, 1.0, "https://tokio.rs/"), (0, "a", 2, 1.0, "https://tokio.rs/tokio/tutorial"), (1, "b", 1, 1.0, "https://tokio.rs/blog/x"), (1, "b", 2, 1.0, "https://tokio.rs/tokio/other"), (1, "b", 3, 1.0, "https://docs.rs/tokio")]
    got = {r["concept"]: r for r in fusion.aggregate_concepts(fusion.reciprocal_rank_fusion(hits(spark, rows)), F.array(F.lit("tutorial"))).collect()}
    assert set(got) == {"tokio.rs/tokio", "tokio.rs/blog", "docs.rs/tokio"} and sum(r["engine_count"] for r in got.values()) == 5
    assert got["tokio.rs/tokio"]["url"] == "https://tokio.rs/tokio/tutorial" and got["tokio.rs/tokio"]["engine_count"] == 3


def test_hybrid_puts_what_both_lists_hold_first(spark):
    lists = "query_id int, id string, rank int"
    lex, vec = spark.createDataFrame([(1, "B", 1), (1, "A", 2)], lists), spark.createDataFrame([(1, "B", 2), (1, "C", 1)], lists)
    boost = spark.createDataFrame([("A", 0.5), ("Z", 0.1)], "id string, score double")
    got = sorted(fusion.hybrid(lex, vec, boost).collect(), key=lambda r: -r["score"])
    assert {r["id"] for r in got} == {"A", "B", "C"} and {r["id"]: r["signals"] for r in got}["A"] == ["bm25", "graph"]
    plain = sorted(fusion.hybrid(lex, vec).collect(), key=lambda r: -r["score"])
    assert plain[0]["id"] == "B"


def test_reliability_bounds(spark):
    df = spark.createDataFrame([(0, 0.0), (4, 0.0), (4, 12000.0), (100, 1e9)], "h int, ms double")
    assert [round(r[0], 3) for r in df.select(fusion.reliability(F.col("h"), F.col("ms"))).collect()] == [0.5, 1.0, 0.7, 0.7]


def test_bm25_prefers_rare_terms_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(["common word", "common word", "common rare", None, "common word"])], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "rare common"), (2, "word"), (3, "absent"), (4, "")], "query_id int, query string")
    got = lexical.top(lexical.bm25(docs, queries, "doc_id", "text"), 10).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got if r["query_id"] == 1] == [2, 0, 1, 4] and [r["id"] for r in got if r["query_id"] == 2] == [0, 1, 4]
    both = lexical.bm25(docs, queries, "doc_id", "text", all_words=True).collect()
    assert {(r["query_id"], r["id"]) for r in both} == {(1, 2), (2, 0), (2, 1), (2, 4)}


def test_order_of_rows_and_partitions_changes_nothing(spark):
    docs = spark.createDataFrame([(n, f"w{n % 3} w{n % 5} w{n % 7}") for n in range(60)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w4")], "query_id int, query string")
    score = lambda df: [tuple(r) for r in lexical.top(lexical.bm25(df, queries, "doc_id", "text"), 10).select("id", "rank").orderBy("rank").collect()]
    assert score(docs) == score(docs.orderBy(F.desc("doc_id")).repartition(7))


def test_cosine_of_zero_other_length_and_nan(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [float("nan"), 1.0]), ("e", None), ("f", [2.0, 0.0])], "id string, v array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    got = vector.top_similar(vectors, queries, 9, "id", "v").orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [("a", 1.0), ("f", 1.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        vector.one_dimension(vectors, "v")


@pytest.mark.parametrize(("host", "want"), [("nasa.gov", 0.35), ("mit.edu", 0.30), ("www.nature.com", 0.28), ("bbc.co.uk", 0.22), ("seriouseats.com", 0.16), ("a.org", 0.08), ("a.example", 0.0), ("cdc.gov", 0.35), ("notnature.com", 0.0)])
def test_institutional_priors(spark, host, want):
    assert spark.range(1).select(rank.institutional_prior(F.lit(host)).alias("x")).first()["x"] == want


RESULTS = "query_id int, url string, domain string, bm25 double, freshness double, quality double, graph double, vector double, authority double, machine double, has_example boolean"


def test_ranker_excludes_missing_signals_and_penalises_a_domain(spark):
    rows = [(1, "u1", "a", 1.0, 1.0, 0.9, None, None, 0.0, None, False), (1, "u2", "a", 1.0, 1.0, 0.9, None, None, 0.0, None, False), (1, "u3", "b", 0.9, 1.0, 0.9, None, None, 0.0, None, False), (1, "u4", "c", 0.0, 0.0, None, None, None, 0.0, None, False)]
    got = {r["url"]: r for r in rank.rank(spark.createDataFrame(rows, RESULTS), use_vector=False).collect()}
    first = (0.5 + 0.15 + 0.09) / 0.85
    assert got["u1"]["score"] == pytest.approx(first) and got["u2"]["score"] == pytest.approx(first * 0.85)
    assert [got[u]["rank"] for u in ("u1", "u3", "u2", "u4")] == [1, 2, 3, 4] and got["u4"]["score"] == 0.001
    assert got["u1"]["tier"] == "high" and all(0.001 <= r["score"] <= 1 for r in got.values())


def test_tiers_and_freshness(spark):
    df = spark.createDataFrame([(0.7, 0.5), (0.7, 0.1), (0.1, 0.1), (None, None)], "v double, q double")
    assert [r[0] for r in df.select(rank.quality_tier(F.col("v"), F.col("q"))).collect()] == ["high", "marginal", "rejected", "high"]
    now = F.lit("2025-01-01").cast("timestamp")
    days = lambda s, **k: spark.range(1).select(rank.freshness(F.lit(s).cast("timestamp"), now, **k).alias("x")).first()["x"]
    assert days("2026-01-01") == 1.0 and days("2024-07-05") == pytest.approx(2.718281828**-1) and days("2024-07-05", mode="half_life") == pytest.approx(0.5)


def test_simhash_of_edits_and_short_texts(spark):
    rng = random.Random(2)
    words = [f"word{rng.randrange(500)}" for _ in range(400)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:200], "changed", *words[201:]])), (3, " ".join(reversed(words))), (4, "too short"), (5, None), (6, " ".join(words) + "!"), (7, "")]
    hashes = dedup.simhash(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    got = {r["id"]: (r["hi"], r["lo"]) for r in hashes.collect()}
    assert got[4] == got[5] == got[7] == (0, 0) and got[1] == got[6]
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(got[a], got[b], strict=True))
    assert apart(1, 2) < 12 < apart(1, 3)
    assert {(r["a"], r["b"], r["bits"]) for r in dedup.near_pairs(hashes).collect() if r["bits"] == 0} == {(1, 6, 0)}


def test_near_pairs_miss_none_within_three_bits(spark):
    rng = random.Random(3)
    base = [rng.randrange(1 << 64) for _ in range(40)]
    values = [v ^ sum(1 << b for b in rng.sample(range(64), n)) for v in base for n in (0, 1, 3, 4)]
    rows = [(n, v >> 32, v & 0xFFFFFFFF) for n, v in enumerate(values)]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(values[i] ^ values[j]).count("1") <= 3}
    got = {(r["a"], r["b"]) for r in dedup.near_pairs(spark.createDataFrame(rows, "id int, hi long, lo long")).collect()}
    assert got == want


def test_canonical_is_seen_first(spark):
    rows = spark.createDataFrame([("g", "b", datetime(2024, 1, 1)), ("g", "a", datetime(2024, 1, 1)), ("g", "c", None), ("h", "z", None)], "g string, u string, t timestamp")
    assert {r["u"] for r in dedup.canonical(rows, "g", "t", "u").filter("canonical").collect()} == {"a", "z"}


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")]


def edges(spark, rows, *more):
    return spark.createDataFrame(rows, "src string, dst string" + "".join(f", {m}" for m in more))


@pytest.mark.parametrize(("direction", "depth", "want"), [("out", 2, {"b": 0, "c": 1, "d": 2}), ("in", 5, {"b": 0, "a": 1, "x": 2}), ("both", 1, {"b": 0, "a": 1, "c": 1}), ("out", 0, {"b": 0})])
def test_bfs(spark, direction, depth, want):
    got = graph.bfs(edges(spark, EDGES), spark.createDataFrame([("b",)], "node string"), depth, direction)
    assert {r["node"]: r["depth"] for r in got.collect()} == want


def test_bfs_ends_on_cycles_and_keeps_unknown_starts(spark):
    loop = edges(spark, [("a", "b"), ("b", "a")])
    assert graph.bfs(loop, spark.createDataFrame([("a",)], "node string"), 9).count() == 2
    assert [tuple(r) for r in graph.bfs(loop, spark.createDataFrame([("q",)], "node string"), 3).collect()] == [("q", 0)]


def test_pagerank_of_a_chain_and_options(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "node string")
    got = {r["node"]: r["score"] for r in graph.pagerank(nodes, edges(spark, EDGES)).collect()}
    base = 0.15 / 5
    assert got["x"] == pytest.approx(base) and got["a"] == pytest.approx(base * 1.85) and got["d"] > got["c"] > got["b"] > got["a"]
    whole = graph.pagerank(nodes, edges(spark, EDGES), iterations=60, dangling=True)
    assert whole.agg(F.sum("score")).first()[0] == pytest.approx(1 - 0.85**61, abs=1e-6)
    warm = graph.pagerank(nodes, edges(spark, EDGES), warm=graph.pagerank(nodes, edges(spark, EDGES)))
    assert {r["node"]: round(r["score"], 9) for r in warm.collect()} == {n: round(s, 9) for n, s in got.items()}
    assert graph.pagerank(nodes.limit(0), edges(spark, [])).count() == 0


def test_pagerank_keeps_nodes_whose_links_come_from_elsewhere(spark):
    nodes = spark.createDataFrame([(n,) for n in "abc"], "node string")
    links = edges(spark, [("q", "a"), (None, "a"), ("a", "b"), ("a", "r"), ("b", None)])
    want = {"a": pytest.approx(0.05), "b": pytest.approx(0.05 * (1 + 0.85 / 2)), "c": pytest.approx(0.05)}
    assert {r["node"]: r["score"] for r in graph.pagerank(nodes, links).collect()} == want
    warm = spark.createDataFrame([("a", 0.7), ("b", 0.1), ("c", 0.2), ("z", 0.3)], "node string, score double")
    assert {r["node"]: r["score"] for r in graph.pagerank(nodes, links, warm=warm).collect()} == want | {"c": 0.2}
    assert graph.pagerank(nodes, links, dangling=True).count() == 3


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_weighted_pagerank_where_weights_add_up_to_nothing(spark, ansi):
    nodes = spark.createDataFrame([(n,) for n in "abcdefgx"], "node string")
    rows = [("a", "b", 0.0), ("b", "c", 1.0), ("d", "e", 1.0), ("d", "f", -1.0), ("x", "g", 2.0), ("x", "g", 1.0), ("x", "d", 0.0)]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = {r["node"]: r["score"] for r in graph.pagerank(nodes, edges(spark, rows, "weight double"), iterations=10, weight="weight").collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    base = 0.15 / 8
    assert math.isnan(got["b"]) and math.isnan(got["c"]) and got["e"] == math.inf and got["f"] == -math.inf
    assert got["g"] == pytest.approx(base * 1.85) and all(got[n] == pytest.approx(base) for n in "adx") and len(got) == 8


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("y", "z"), ("z", "z")]
    got = {r["node"]: r["component"] for r in graph.components(edges(spark, chain)).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(41)) and got["y"] == got["z"] == "y"


def test_strong_components_levels_and_cycles(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")]
    got = {r["node"]: r["component"] for r in graph.strong_components(edges(spark, rows)).collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] and len({got["a"], got["c"], got["e"]}) == 3
    with pytest.raises(ValueError):
        graph.topological_levels(edges(spark, rows))
    assert {r["node"]: r["level"] for r in graph.topological_levels(edges(spark, EDGES)).collect()} == {"x": 0, "a": 1, "b": 2, "c": 3, "d": 4}


def test_shortest_paths(spark):
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0), ("c", "a", 1.0), ("q", "r", 1.0)]
    got = {r["node"]: (r["distance"], r["path"]) for r in graph.shortest_paths(edges(spark, rows, "weight double"), "a").collect()}
    assert got == {"a": (0.0, ["a"]), "b": (1.0, ["a", "b"]), "c": (2.0, ["a", "b", "c"])}


def test_suggestions_come_once_with_their_best_score(spark):
    log = spark.createDataFrame([(q,) for q in ["Rust async", "rust async!", "rust", "python", "python", "python", ""]], "q string")
    got = logs.suggestions(logs.query_ngrams(log, "q"), logs.query_frequency(log, "q"), "Ru", 10).collect()
    assert [r["text"] for r in got][:2] == ["rust", "rust async"] and len({r["text"] for r in got}) == len(got)
    assert logs.suggestions(logs.query_ngrams(log, "q"), logs.query_frequency(log, "q"), " !", 10).count() == 0


def test_recrawl_policies(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1), 1), ("b", datetime(2024, 1, 1), 5), ("c", None, 0)], "u string, last_fetched timestamp, fetches int")
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    due = lambda policy: {r["u"] for r in logs.recrawl_due(rows, at, policy).filter("due").collect()}
    assert due("never") == set() and due("fixed") == {"a", "b", "c"} and due("adaptive") == {"a", "c"}


def test_eviction_keeps_the_newest_within_budget(spark):
    rows = spark.createDataFrame([(n, datetime(2024, 1, 1 + n), "x" * 10) for n in range(5)] + [(9, None, None)], "id int, t timestamp, body string")
    got = {r["id"]: r["evict"] for r in logs.eviction(rows, 25, "id", "t", "body").collect()}
    assert got == {4: False, 3: False, 2: True, 1: True, 0: True, 9: True}


def test_upsert_and_endpoints(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seen int, note string")
    new = spark.createDataFrame([("a", 5, "z"), ("c", 6, "w")], "id string, seen int, note string").withColumn("first", F.col("seen"))
    got = {r["id"]: (r["note"], r["first"]) for r in logs.upsert(old.withColumn("first", F.col("seen")), new, "id", "seen", {"first": "min"}).collect()}
    assert got == {"a": ("z", 1), "b": ("y", 1), "c": ("w", 6)}
    ends = logs.with_endpoints(old, spark.createDataFrame([("a", "q"), ("q", None)], "s string, t string"), "id", ("s", "t"))
    assert sorted(r["id"] for r in ends.collect()) == ["a", "b", "q"]


@pytest.mark.parametrize(("q", "intent"), [("Is CVE-2024-3094 bad?", "vulnerability"), ("how to fix E0502", "rust_error"), ("how to sort", "code_explanation"), ("API reference of x", "api_docs"), ("RFC 9110", "specification"), ("garden news", "general"), (None, None)])
def test_router(spark, q, intent):
    row = spark.createDataFrame([(q,)], "q string").select(route(F.col("q")).alias("r")).first()["r"]
    assert (row and row["intent"]) == intent


def test_stream_batches_are_written_once_each(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(n, n % 2) for n in range(30)], "id int, k int").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        streams.ingest(streams.file_stream(spark, source, schema, files_a_batch=1), lambda b: b.filter("k = 0"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 30, 2)) and got.select("batch").distinct().count() == 3


def test_rake_keywords_of_all_languages(spark, monkeypatch):
    from lorekeel.plans import retrieval

    long = "Die Bibliothek am Hafen öffnet im Winter später, und der Fahrplan der Fähre hängt dort neben der alten Tür am Eingang."
    docs = spark.createDataFrame([(n, long, lang) for n, lang in enumerate(["en", "EN", "de", "", None])] + [(9, "short", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(retrieval, "texts", lambda *_: docs)
    assert {r["doc_id"] for r in retrieval.rake_keywords(spark, "").collect()} == set(range(5))
