"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

RRF_K = 60


def contribution(rank: Column, weight: Column, k: int = RRF_K) -> Column:
    """max(weight, 0) / (max(k, 1) + rank), rank from 1."""
    return F.greatest(weight, F.lit(0.0)) / (F.lit(max(k, 1)) + rank)


def reciprocal_rank_fusion(hits: DataFrame, key: Column | None = None, k: int = RRF_K, terms: Column | None = None, alpha: float = 0.25) -> DataFrame:
    """Rows (query_id, url, title, snippet, score, engine_count, engines) of hits (query_id, list_no, engine, rank, weight, url, title, snippet).

    Hits fuse by canonical URL (or `key`). The first of them by list, then rank,
    gives URL, title and snippet. engine_count counts every hit. With `terms`
    each contribution grows by `alpha` times the share of terms it matches.
    """
    part = contribution(F.col("rank"), F.col("weight"), k)
    if terms is not None:
        share = T.keyword_matches(terms, F.col("title"), F.col("snippet")) / F.size(terms)
        part = part * F.when(F.size(terms) > 0, 1 + max(0.0, min(alpha, 2.0)) * share).otherwise(F.lit(1.0))
    keyed = hits.withColumn("_key", U.canonical(F.col("url")) if key is None else key).withColumn("_part", part)
    fused = keyed.groupBy("query_id", "_key").agg(
        F.sum("_part").alias("score"),
        F.count("*").alias("engine_count"),
        F.min(F.struct("list_no", "rank", "url", "title", "snippet")).alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank", "engine"))), lambda h: h["engine"]).alias("engines"),
    )
    return fused.select("query_id", F.col("_first.url").alias("url"), F.col("_first.title").alias("title"), F.col("_first.snippet").alias("snippet"), "score", "engine_count", "engines")


def min_max(score: Column, per: list[str], low: float = 0.0, high: float = 1.0) -> Column:
    """Score scaled to low..high within its group; `high` where all are equal."""
    w = Window.partitionBy(*per)
    span = F.max(score).over(w) - F.min(score).over(w)
    return F.when(span < 2.220446049250313e-16, F.lit(high)).otherwise(low + (high - low) * (score - F.min(score).over(w)) / span)


def normalised(fused: DataFrame) -> DataFrame:
    """Fused scores scaled to 0.4..1 within each query."""
    return fused.withColumn("score", min_max(F.col("score"), ["query_id"], 0.4, 1.0))


def aggregate_concepts(fused: DataFrame, terms: Column | None = None) -> DataFrame:
    """Fused hits grouped by domain and first path segment, a home page joining its host's strongest group.

    Scores and engine counts add up; the member that matches most terms (then
    of the smallest URL) stands for the group.
    """
    matches = T.keyword_matches(terms, F.col("title"), F.col("snippet")) if terms is not None else F.lit(0)
    best = F.min(F.struct((-F.col("m")).alias("o"), "url", "title", "snippet")).alias("rep")
    keyed = fused.withColumn("m", matches).withColumn("group", U.aggregation_key(F.col("url")))
    groups = keyed.groupBy("query_id", "group").agg(F.sum("score").alias("score"), F.sum("engine_count").alias("engine_count"), F.flatten(F.collect_list("engines")).alias("engines"), best)
    groups = groups.withColumn("host", F.substring_index("group", "/", 1)).withColumn("home", ~F.col("group").contains("/"))
    order = Window.partitionBy("query_id", "host").orderBy("home", F.desc("score"), "group")
    target = F.first("group").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    merged = groups.withColumn("target", F.when(F.col("home"), target).otherwise(F.col("group"))).groupBy("query_id", "target").agg(
        F.sum("score").alias("score"), F.sum("engine_count").alias("engine_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("engines")))).alias("engines"), F.min("rep").alias("rep")
    )
    return merged.select("query_id", F.col("target").alias("concept"), F.col("rep.url").alias("url"), F.col("rep.title").alias("title"), F.col("rep.snippet").alias("snippet"), "score", "engine_count", "engines")


def reliability(hits: Column, latency_ms: Column) -> Column:
    """Weight of an engine from how much and how fast it answers, within 0.5..1."""
    volume = F.when(hits == 0, 0.5).otherwise(0.5 + 0.5 * F.least(hits, F.lit(4)) / 4.0)
    speed = F.greatest(F.lit(0.7), F.least(F.lit(1.0), 1 - 0.3 * latency_ms / 12000.0))
    return F.greatest(F.lit(0.5), F.least(F.lit(1.0), volume * speed))


def positional_relevance(rank: Column, total: Column) -> Column:
    """1 for the first of `total` hits, falling towards 0; rank from 1."""
    return F.when(total > 0, 1 - (rank - 1) / total).otherwise(F.lit(0.0))


def store_live_fusion(store: DataFrame, live: DataFrame, k: int = RRF_K) -> DataFrame:
    """Store hits (weight 1) and live hits (weight 3) fused and scaled; live-only ones gain 10 to 20 %.

    Both are (query_id, rank, engine, engine_count, url, title, snippet).
    """
    columns = ["query_id", "rank", "engine", "url", "title", "snippet", "engine_count"]
    both = store.select(*columns).withColumn("list_no", F.lit(0)).withColumn("weight", F.lit(1.0)).unionByName(live.select(*columns).withColumn("list_no", F.lit(1)).withColumn("weight", F.lit(3.0)))
    origin = both.withColumn("_key", U.canonical(F.col("url"))).groupBy("query_id", "_key").agg(F.max(F.when(F.col("list_no") == 0, 1).otherwise(0)).alias("stored"), F.max(F.when(F.col("list_no") == 1, F.col("engine_count"))).alias("live_engines"))
    fused = reciprocal_rank_fusion(both, k=k).withColumn("_key", U.canonical(F.col("url"))).join(origin, ["query_id", "_key"])
    gain = F.when(F.col("stored") == 0, 1.10 + F.least(0.05 * (F.col("live_engines") - 1), F.lit(0.10))).otherwise(F.lit(1.0))
    return normalised(fused.withColumn("score", F.col("score") * gain)).select("query_id", "url", "title", "snippet", "score", "engine_count", "stored")


def hybrid(bm25: DataFrame, vector: DataFrame, graph: DataFrame | None = None, freshness: DataFrame | None = None, k: int = RRF_K, graph_boost: float = 0.05, fresh_boost: float = 0.03) -> DataFrame:
    """Rows (query_id, id, score, signals): ranks of two lists fused, with boosts for candidates that a graph score or freshness row names.

    bm25 and vector are (query_id, id, rank), graph (id, score), freshness (id).
    """
    lists = bm25.select("query_id", "id", "rank", F.lit("bm25").alias("signal")).unionByName(vector.select("query_id", "id", "rank", F.lit("vector").alias("signal")))
    out = lists.groupBy("query_id", "id").agg(F.sum(contribution(F.col("rank"), F.lit(1.0), k)).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"))
    if graph is not None:
        top_score = graph.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
        boosts = graph.crossJoin(F.broadcast(top_score)).select("id", (graph_boost * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.col("top")))).alias("g"))
        out = out.join(boosts, "id", "left").select("query_id", "id", (F.col("score") + F.coalesce("g", F.lit(0.0))).alias("score"), F.when(F.col("g").isNotNull(), F.concat("signals", F.array(F.lit("graph")))).otherwise(F.col("signals")).alias("signals"))
    if freshness is not None:
        out = out.join(freshness.select("id", F.lit(fresh_boost).alias("f")).distinct(), "id", "left").select("query_id", "id", (F.col("score") + F.coalesce("f", F.lit(0.0))).alias("score"), F.when(F.col("f").isNotNull(), F.concat("signals", F.array(F.lit("freshness")))).otherwise(F.col("signals")).alias("signals"))
    return out
