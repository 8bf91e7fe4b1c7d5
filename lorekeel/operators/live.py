"""Scores of fused live hits, gates, sparse filling and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .lexical import B, K1
from .rank import code_intent, institutional_prior, intent_boost, precision, source_tier

TITLE_WEIGHT = 5.0
#: Relevance floors: seeds of the first are preferred, else those of the second are taken.
HIGH_FLOOR, LOW_FLOOR, MOST_SEEDS = 0.55, 0.25, 5


def _clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def squashed(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def occurrences(hay: Column, needle: Column) -> Column:
    """How often a squashed needle stands in a squashed text, without overlap; 0 for an empty needle."""
    size = F.length(needle)
    return F.when(size > 0, (F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / size).otherwise(F.lit(0.0))


def lexical_relevance(terms: Column, title: Column, body: Column) -> Column:
    """BM25F of a title and snippet alone, as a share of what every keyword once in the title would give; 0.5 without keywords."""
    length = F.greatest(F.size(T.tokens(title)) + F.size(T.tokens(body)), F.lit(1)).cast("double")
    # The mean length is that of the text itself, so the length norm is 1; idf is one constant and cancels out.
    saturated = lambda f: f * (K1 + 1) / (f + K1 * (1 - B + B * length / length))
    heads, tails = squashed(title), squashed(body)
    total = F.aggregate(terms, F.lit(0.0), lambda s, k: s + saturated(TITLE_WEIGHT * occurrences(heads, squashed(k)) + occurrences(tails, squashed(k))))
    ceiling = F.size(terms) * saturated(F.lit(TITLE_WEIGHT))
    return F.when(F.size(terms) == 0, F.lit(0.5)).otherwise(_clamp(total / ceiling))


def live_score(terms: Column, lexical: Column, consensus: Column, quality: Column, freshness: Column, url: Column, engines: Column) -> Column:
    """Score of a live hit; one that no keyword matches gets 0."""
    tier = source_tier(url)
    authority = _clamp(institutional_prior(U.host(url)) / 0.35)
    bonus = F.least(F.greatest(engines - 1, F.lit(0)) / 3.0, F.lit(1.0)) * 0.10
    with_terms = _clamp(_clamp(lexical) * (0.5 + 0.5 * _clamp(consensus)) * (0.8 + 0.2 * quality) * (0.9 + 0.1 * freshness) + 0.05 * authority + bonus)
    without = _clamp(0.60 * consensus + 0.20 * quality + 0.15 * freshness + 0.05 * authority + bonus)
    wanted = code_intent(F.array_join(terms, " "))
    boosted = lambda s: _clamp(intent_boost(s, tier, wanted) * precision(tier))
    return F.when(F.size(terms) == 0, boosted(without)).when(lexical <= 0, F.lit(0.0)).otherwise(boosted(with_terms))


def sparse_fill(results: DataFrame, store: DataFrame, limit: int, matches: Column) -> DataFrame:
    """`results` (query_id, url, score), filled up to `limit` rows a query with unseen store hits that match, scored 0.30 to 0.49 and ranked.

    Where all unseen hits score alike they get 0.40. Ties go to the smaller URL.
    """
    key = U.canonical(F.col("url"))
    seen = results.select("query_id", key.alias("_k")).distinct()
    unseen = store.filter(matches).withColumn("_k", key).join(seen, ["query_id", "_k"], "left_anti")
    every = Window.partitionBy("query_id")
    span = F.max("score").over(every) - F.min("score").over(every)
    scaled = F.when(span < 1e-9, F.lit(0.40)).otherwise(_clamp(0.30 + 0.19 * (F.col("score") - F.min("score").over(every)) / span, 0.20, 0.49))
    place = F.row_number().over(every.orderBy(F.round("score", 9).desc(), F.col("url")))
    have = results.groupBy("query_id").agg(F.count("*").alias("_n"))
    fill = unseen.select("query_id", "url", scaled.alias("fill"), place.alias("_p")).join(have, "query_id", "left").filter(F.col("_p") <= limit - F.coalesce("_n", F.lit(0)))
    both = results.select("query_id", "url", "score").unionByName(fill.select("query_id", "url", F.col("fill").alias("score")))
    return both.withColumn("rank", F.row_number().over(every.orderBy(F.round("score", 9).desc(), F.col("url"))))


def topic_relevance(url: Column, topics: Column, *fields: Column) -> Column:
    """0.4 of the share of topics in the URL and 0.6 of that in the fields; 0.5 without topics."""
    low, hay = F.lower(url), F.lower(F.concat_ws(" ", *fields))
    share = lambda c: F.size(F.filter(topics, lambda t: c.contains(t))) / F.size(topics)
    return F.when(F.size(topics) == 0, F.lit(0.5)).otherwise(0.4 * share(low) + 0.6 * share(hay))


def topics_match(keyword: Column, topic: Column) -> Column:
    """Whether one holds the other, or both begin with the same four characters."""
    return keyword.contains(topic) | topic.contains(keyword) | ((F.length(keyword) >= 4) & (F.length(topic) >= 4) & (F.substring(keyword, 1, 4) == F.substring(topic, 1, 4)))


def graph_seeds(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (url, relevance) of nodes whose URL, domain or anchor texts hold a term: 0.7 of the share of terms and 0.3 of the share of all links that lead there."""
    total = edges.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    anchors = edges.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("anchor_text")), " ").alias("anchors"), F.count("*").alias("inbound"))
    rows = nodes.join(anchors, "node", "left").crossJoin(F.broadcast(total))
    hay = F.lower(F.concat_ws(" ", "url", "domain", "anchors"))
    share = sum((F.when(hay.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / max(1, len(terms))
    scored = rows.select("url", share.alias("share"), (F.coalesce("inbound", F.lit(0)) / F.col("total")).alias("authority")).filter("share > 0")
    return scored.select("url", _clamp(0.7 * F.col("share") + 0.3 * F.col("authority")).alias("relevance"))


def two_tier_floor(seeds: DataFrame, high: float = HIGH_FLOOR, low: float = LOW_FLOOR, most: int = MOST_SEEDS) -> DataFrame:
    """Seeds of relevance `high` and more; where there are none, the `most` best of `low` and more."""
    best = seeds.agg(F.max("relevance").alias("_best"))
    good = seeds.crossJoin(F.broadcast(best)).filter((F.col("relevance") >= high) & (F.col("_best") >= high)).drop("_best")
    rest = seeds.crossJoin(F.broadcast(best)).filter((F.col("_best") < high) & (F.col("relevance") >= low)).drop("_best")
    return good.unionByName(rest.orderBy(F.round("relevance", 9).desc(), "url").limit(most))


def pipeline_score(bm25: Column, vector: Column, score: Column, graph: Column, tier: Column) -> Column:
    """The larger of BM25 and vector score, by fused score, graph score and source precision."""
    return F.greatest(bm25, vector) * (0.5 + 0.5 * score / F.greatest(score, F.lit(1.0))) * (0.6 + 0.4 * graph) * precision(tier)
