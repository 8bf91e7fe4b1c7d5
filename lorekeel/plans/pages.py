"""Queries of page extraction and of the sources around pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, texts
from ..sources import pages, readers
from .registry import query


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "page_content").filter("content_html is not null").groupBy("id").agg(F.max("content_html").alias("h"), F.max("url_node_id").alias("n"))
    urls = table(spark, folder, "url_nodes").groupBy(F.col("id").alias("n")).agg(F.min("url").alias("u"))
    return pages.extract_pages(rows.join(urls, "n", "left"), "id", "h", "u")


@query()
def extract_page(spark: SparkSession, folder: str) -> DataFrame:
    found = _records(spark, folder)
    return found.select("id", "page.title", "page.lang", "page.site_name", "page.excerpt", "page.word_count", "page.valid", "page.paywall", F.size("page.headings").alias("headings"), F.size("page.callouts").alias("callouts"), F.size("page.internal_links").alias("internal"), F.size("page.external_links").alias("external"), F.length("page.markdown").alias("markdown_chars"), F.length("page.clean_html").alias("clean_chars"))


@query("""
WITH r AS (SELECT id, max(content_html) AS h FROM page_content WHERE content_html IS NOT NULL GROUP BY id)
SELECT id, count(*) AS links FROM (SELECT id, unnest(list_distinct(regexp_extract_all(regexp_replace(h, '<script[^>]*>.*?</script>', '', 'gs'), '<a href="(/[^"]*)"', 1))) AS l FROM r) GROUP BY id""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("id", F.explode("page.internal_links").alias("l")).groupBy("id").agg(F.count("*").alias("links"))


@query("""
WITH r AS (SELECT id, max(content_html) AS h FROM page_content WHERE content_html IS NOT NULL GROUP BY id)
SELECT id, regexp_extract(h, '<html lang="([a-z]+)"', 1) AS lang FROM r""")
def page_language(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("id", F.coalesce("page.lang", F.lit("")).alias("lang"))


@query()
def relevant_sentences(spark: SparkSession, folder: str) -> DataFrame:
    terms = F.array(F.lit("interest rates"), F.lit("timetable"))
    return texts(spark, folder, "documents").filter("text is not null").select("doc_id", pages.relevant_text(F.col("text"), terms).alias("relevant"))


@query()
def content_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["text/html; charset=UTF-8", "application/ld+json", "application/rss+xml", "text/markdown", "image/png", "application/pdf", "application/x-unknown", None]
    rows = spark.createDataFrame([(k,) for k in kinds], "content_type string")
    return rows.select("content_type", readers.content_kind(F.col("content_type")).alias("kind"), readers.charset(F.col("content_type")).alias("charset"))


@query("SELECT regexp_replace(lower(domain), '^www\\.', '') AS site, count(DISTINCT id) AS pages, count(DISTINCT source) AS sources FROM url_nodes GROUP BY ALL")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "url_nodes").groupBy(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("site")).agg(F.countDistinct("id").alias("pages"), F.countDistinct("source").alias("sources"))


@query()
def seed_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return readers.catalogue(spark)


@query()
def model_view(spark: SparkSession, folder: str) -> DataFrame:
    return readers.language_model_view(texts(spark, folder, "documents"), "doc_id", "title", "url")
