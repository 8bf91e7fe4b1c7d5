"""Queries of logs, stores and crawl history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from ..runtime import table
from .registry import query

AS_OF = "2026-01-01 00:00:00"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9à-öø-ÿ\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_LOG = f"l AS (SELECT {_NORM.format('anchor_text')} AS q FROM link_edges WHERE anchor_text IS NOT NULL), w AS (SELECT q, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS ws FROM l)"
_GRAMS = f"""{_LOG}, g AS (
 SELECT unnest(ws) AS ngram, 1 AS ngram_len FROM w UNION ALL SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM w WHERE len(ws) >= 2
 UNION ALL SELECT unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 FROM w WHERE len(ws) >= 3),
grams AS (SELECT ngram, ngram_len, count(*) AS count FROM g GROUP BY ALL)"""


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Anchor texts stand in for logged queries."""
    return table(spark, folder, "link_edges").filter("anchor_text is not null")


@query(f"WITH {_GRAMS} SELECT ngram, ngram_len, count FROM grams")
def query_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return logs.query_ngrams(_log(spark, folder), "anchor_text")


@query(f"""
WITH {_GRAMS}, f AS (SELECT q AS query, count(*) AS n FROM l WHERE q <> '' GROUP BY q),
a AS (SELECT ngram AS text, 1.5 * ln(count) + 0.1 * (3 - ngram_len) AS score, 'ngram' AS source FROM grams WHERE starts_with(ngram, 'the') AND count >= 2
 UNION ALL SELECT query, 0.8 * ln(n), 'log' FROM f WHERE starts_with(query, 'the') UNION ALL SELECT query, 0.5 * ln(n), 'popular' FROM f),
b AS (SELECT text, max(struct_pack(score := score, source := source)) AS m FROM a GROUP BY text)
SELECT text, round(m.score, 6) AS score, m.source AS source FROM b ORDER BY round(m.score, 9) DESC, text LIMIT 20""")
def suggest_prefix(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    found = logs.suggestions(logs.query_ngrams(log, "anchor_text"), logs.query_frequency(log, "anchor_text"), "the", 20)
    return found.select("text", F.round("score", 6).alias("score"), "source")


@query("SELECT source AS category, count(*) AS n FROM documents WHERE coalesce(trim(source), '') <> '' GROUP BY ALL ORDER BY n DESC, category LIMIT 10")
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return logs.top_categories(table(spark, folder, "documents"), "source", 10)


@query(f"""
WITH h AS (SELECT url_node_id, max(fetched_at) AS last, count(DISTINCT id) AS n FROM page_content GROUP BY ALL),
i AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE least(pow(2, least(n - 1, 4)), 30)::INT END AS days FROM h)
SELECT url_node_id, days AS interval_days, last IS NULL OR floor(epoch(TIMESTAMPTZ '{AS_OF}+00')) - floor(epoch(last)) > days * 86400 AS due FROM i""")
def recrawl_due(spark: SparkSession, folder: str) -> DataFrame:
    history = table(spark, folder, "page_content").groupBy("url_node_id").agg(F.max("fetched_at").alias("last_fetched"), F.countDistinct("id").alias("fetches"))
    return logs.recrawl_due(history, F.lit(AS_OF).cast("timestamp")).select("url_node_id", F.col("interval_days").cast("int").alias("interval_days"), "due")


@query("SELECT (coalesce(sum(strlen(content_text)), 0) + coalesce(sum(strlen(content_html)), 0))::BIGINT AS bytes, count(*) AS pages FROM page_content")
def storage_size(spark: SparkSession, folder: str) -> DataFrame:
    return logs.storage_size(table(spark, folder, "page_content"), "content_text", "content_html")


@query("""
WITH r AS (SELECT id, max(fetched_at) AS ft, max(strlen(content_text)) AS bytes FROM page_content GROUP BY id),
k AS (SELECT id, bytes, sum(bytes) OVER (ORDER BY ft DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM r)
SELECT id, bytes::BIGINT AS bytes, kept > 500000 AS evict FROM k""")
def eviction_plan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "page_content").groupBy("id").agg(F.max("fetched_at").alias("at"), F.max_by("content_text", F.octet_length("content_text")).alias("t"))
    return logs.eviction(rows, 500000, "id", "at", "t")


@query(f"""
WITH n AS (SELECT (epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(discovered_at))) / 86400.0 AS d FROM url_nodes)
SELECT round(min(d), 1) AS newest_days, round(max(d), 1) AS oldest_days, round(avg(d), 1) AS mean_days FROM n""")
def index_age(spark: SparkSession, folder: str) -> DataFrame:
    return logs.index_age(table(spark, folder, "url_nodes"), F.lit(AS_OF).cast("timestamp"))


@query("""
WITH r AS (SELECT id, min(epoch_us(discovered_at)) AS first_seen, arg_max(struct_pack(depth := depth, crawled := crawled), struct_pack(t := epoch_us(discovered_at), d := depth, c := crawled)) AS l FROM url_nodes GROUP BY id)
SELECT id, first_seen, l.depth AS depth, l.crawled AS crawled FROM r""")
def upsert_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Node rows put over each other by discovery; the first discovery stays."""
    rows = table(spark, folder, "url_nodes").select("id", F.unix_micros("discovered_at").alias("seen"), "depth", "crawled")
    ordered = rows.withColumn("o", F.struct("seen", "depth", "crawled")).withColumn("first_seen", F.col("seen"))
    found = logs.upsert(ordered.limit(0), ordered, "id", "o", {"first_seen": "min"})
    return found.select("id", "first_seen", "depth", "crawled")


@query("""
WITH e AS (SELECT source_id AS id FROM link_edges UNION SELECT target_id FROM link_edges), n AS (SELECT DISTINCT id FROM url_nodes WHERE crawled)
SELECT id, id IN (SELECT id FROM n) AS known FROM (SELECT id FROM n UNION SELECT id FROM e)""")
def placeholder_nodes(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "url_nodes").filter("crawled").select("id").distinct().withColumn("known", F.lit(True))
    every = logs.with_endpoints(known, table(spark, folder, "link_edges"), "id", ("source_id", "target_id"))
    return every.select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query("""
WITH j AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS key, lower(status) = 'done' AS ok, epoch_us(updated_at) AS ut FROM crawl_jobs WHERE status IS NOT NULL)
SELECT key, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures, max(ut) AS last_at, arg_max(ok, struct_pack(a := ut, b := ok)) AS last_ok FROM j GROUP BY key""")
def health_rollup(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions import urls as U

    jobs = table(spark, folder, "crawl_jobs").filter("status is not null").select(U.domain(F.col("url")).alias("key"), "status", F.unix_micros("updated_at").alias("at"))
    return logs.health(jobs, "key", F.lower("status") == "done", "at")


@query("""
SELECT count(*) AS runs, count(*) FILTER (WHERE lower(status) = 'done') AS done, count(*) FILTER (WHERE lower(status) = 'failed') AS failed, count(DISTINCT regexp_replace(error, '[0-9]+', '#', 'g')) AS error_kinds FROM (SELECT DISTINCT * FROM crawl_jobs)""")
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_jobs").distinct().agg(F.count("*").alias("runs"), F.count_if(F.lower("status") == "done").alias("done"), F.count_if(F.lower("status") == "failed").alias("failed"), F.countDistinct(F.regexp_replace("error", "[0-9]+", "#")).alias("error_kinds"))
