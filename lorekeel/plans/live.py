"""Queries of live scoring, filling and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readability as R
from ..functions import text as T
from ..operators import lexical, live, rank
from ..runtime import table, texts
from .registry import query
from .retrieval import AS_OF, asked

_TERMS = ["museum", "timetable", "e-mail"]
_LIST = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"
_SQUASH = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, {_SQUASH.format("title")} AS h, {_SQUASH.format("text")} AS b FROM documents),
f AS (SELECT doc_id, list_transform(['museum', 'timetable', 'email'], lambda k: 5.0 * (length(h) - length(replace(h, k, ''))) / length(k) + (length(b) - length(replace(b, k, ''))) / length(k)) AS fs FROM d)
SELECT doc_id, round(least(1.0, list_sum(list_transform(fs, lambda f: f * 2.2 / (f + 1.2))) / (3 * 5.0 * 2.2 / 6.2)), 6) AS relevance FROM f""")
def live_lexical(spark: SparkSession, folder: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in _TERMS])
    return texts(spark, folder, "documents").select("doc_id", F.round(live.lexical_relevance(terms, F.col("title"), F.col("text")), 6).alias("relevance"))


@query()
def live_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Live scores of the fifty best documents of each query, as if an engine had given them."""
    docs = texts(spark, folder, "documents")
    best = lexical.top(lexical.bm25(docs, asked(spark), "doc_id", "text"), 50)
    rows = best.join(docs.select(F.col("doc_id").alias("id"), "title", "text", "url", "fetched_at", R.readability("text").alias("r")), "id").join(F.broadcast(asked(spark)), "query_id")
    terms = T.keywords(F.col("query"))
    rows = rows.withColumn("lexical", live.lexical_relevance(terms, F.col("title"), F.col("text"))).withColumn("quality", R.quality(F.col("r.ease"), F.col("r.grade")))
    fresh = F.coalesce(rank.freshness(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp")), F.lit(1.0))
    score = live.live_score(terms, F.col("lexical"), 1.0 / F.col("rank"), F.col("quality"), fresh, F.col("url"), F.lit(2))
    return rows.select("query_id", F.col("id").alias("doc_id"), F.round(score, 6).alias("score"))


@query(f"""
WITH n AS (SELECT doc_id, lower(url) AS u, lower(concat_ws(' ', title, text)) AS h FROM documents WHERE url IS NOT NULL)
SELECT doc_id, round(0.4 * len(list_filter({_LIST}, lambda t: contains(u, t))) / 3 + 0.6 * len(list_filter({_LIST}, lambda t: contains(h, t))) / 3, 6) AS relevance FROM n""")
def topic_relevance(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "documents").filter("url is not null")
    return rows.select("doc_id", F.round(live.topic_relevance(F.col("url"), F.array(*[F.lit(t) for t in _TERMS]), F.col("title"), F.col("text")), 6).alias("relevance"))


_SEEDS = """
n AS (SELECT id, min(url) AS url, min(domain) AS domain FROM url_nodes GROUP BY id), a AS (SELECT target_id AS id, array_to_string(list_sort(list(DISTINCT anchor_text) FILTER (WHERE anchor_text IS NOT NULL)), ' ') AS anchors, count(*) AS inbound FROM link_edges GROUP BY target_id),
h AS (SELECT url, lower(concat_ws(' ', url, domain, anchors)) AS hay, coalesce(inbound, 0) AS inbound FROM n LEFT JOIN a USING (id)),
s AS (SELECT url, (CASE WHEN contains(hay, 'museum') THEN 1 ELSE 0 END + CASE WHEN contains(hay, 'journal') THEN 1 ELSE 0 END) / 2.0 AS share, inbound::DOUBLE / (SELECT count(*) FROM link_edges) AS authority FROM h),
seeds AS (SELECT url, 0.7 * share + 0.3 * authority AS relevance FROM s WHERE share > 0)"""


@query(f"WITH {_SEEDS} SELECT url, round(relevance, 6) AS relevance FROM seeds")
def graph_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return _seeds(spark, folder).select("url", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_SEEDS}, b AS (SELECT max(relevance) AS best FROM seeds), r AS (SELECT url, relevance, row_number() OVER (ORDER BY round(relevance, 9) DESC, url) AS p FROM seeds) SELECT url, round(relevance, 6) AS relevance FROM r, b WHERE (best >= 0.55 AND relevance >= 0.55) OR (best < 0.55 AND relevance >= 0.25 AND p <= 5)")
def seed_floor(spark: SparkSession, folder: str) -> DataFrame:
    return live.two_tier_floor(_seeds(spark, folder)).select("url", F.round("relevance", 6).alias("relevance"))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "url_nodes").groupBy(F.col("id").alias("node")).agg(F.min("url").alias("url"), F.min("domain").alias("domain"))
    edges = table(spark, folder, "link_edges").select(F.col("target_id").alias("dst"), "anchor_text")
    return live.graph_seeds(nodes, edges, ["museum", "journal"])
