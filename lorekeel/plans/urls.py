"""Queries of URL functions over all addresses of nodes and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..runtime import table
from .registry import query

_ALL = "u AS (SELECT url FROM url_nodes WHERE url IS NOT NULL UNION SELECT url FROM documents WHERE url IS NOT NULL)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ORIGIN = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
_QUERY = "string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&')"


def _rebuilt(drop: str) -> str:
    kept = f"array_to_string(list_filter({_QUERY}, lambda x: x <> '' AND NOT ({drop})), '&')"
    return f"{_ORIGIN} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"


def all_urls(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "url_nodes").select("url").unionByName(table(spark, folder, "documents").select("url"))
    return both.filter("url is not null").distinct()


@query(f"WITH {_ALL} SELECT url, {_rebuilt('list_contains([' + ', '.join(repr(t) for t in U.TRACKING) + "], lower(split_part(x, '=', 1)))")} AS canonical FROM u")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return all_urls(spark, folder).select("url", U.canonical(F.col("url")).alias("canonical"))


@query(f"WITH {_ALL} SELECT url, {_rebuilt("starts_with(lower(split_part(x, '=', 1)), 'utm_') OR lower(split_part(x, '=', 1)) IN ('fbclid', 'gclid', 'ref', 'source')")} AS sanitised FROM u")
def url_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    return all_urls(spark, folder).select("url", U.sanitised(F.col("url")).alias("sanitised"))


@query(f"""
WITH {_ALL}, k AS (SELECT regexp_replace({_HOST}, '^www\\.', '') AS d, split_part(ltrim({_PATH}, '/'), '/', 1) AS seg FROM u)
SELECT CASE WHEN seg = '' THEN d ELSE d || '/' || seg END AS key, count(*) AS n FROM k GROUP BY ALL""")
def url_agg_key(spark: SparkSession, folder: str) -> DataFrame:
    return all_urls(spark, folder).groupBy(U.aggregation_key(F.col("url")).alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {_ALL} SELECT url, substring(sha256(url), 1, 32) AS id FROM u")
def url_id(spark: SparkSession, folder: str) -> DataFrame:
    return all_urls(spark, folder).select("url", U.url_id(F.col("url")).alias("id"))


@query(f"""
WITH {_ALL}, h AS (SELECT url, regexp_replace({_HOST}, '^www\\.', '') AS domain, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS seg FROM u), p AS (SELECT *, string_split(domain, '.') AS l FROM h)
SELECT url, domain, array_to_string(l[-2:], '.') AS root, l[-1] AS suffix, len(seg)::INT AS depth FROM p""")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = all_urls(spark, folder).withColumn("domain", U.domain(F.col("url")))
    return rows.select("url", "domain", U.root_domain(F.col("domain")).alias("root"), U.public_suffix(F.col("domain")).alias("suffix"), U.path_depth(F.col("url")).alias("depth"))


@query(f"WITH {_ALL} SELECT url, regexp_replace(regexp_replace(rtrim(regexp_replace(lower(trim(url)), '#.*$', ''), '/'), '^(http://[^/?#]*):80($|[/?#])', '\\1\\2'), '^(https://[^/?#]*):443($|[/?#])', '\\1\\2') AS key FROM u")
def url_cache_key(spark: SparkSession, folder: str) -> DataFrame:
    return all_urls(spark, folder).select("url", U.cache_key(F.col("url")).alias("key"))


@query(f"""
WITH {_ALL}, s AS (SELECT url, regexp_replace({_HOST}, '^www\\.', '') AS d, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS seg FROM u)
SELECT url, CASE WHEN len(seg) = 0 THEN d ELSE trim(regexp_replace(regexp_replace(seg[-1], '\\.[A-Za-z0-9]{{1,5}}$', ''), '[-_+\\s]+', ' ', 'g')) END AS title FROM s""")
def url_titles(spark: SparkSession, folder: str) -> DataFrame:
    return all_urls(spark, folder).select("url", U.title_from_url(F.col("url")).alias("title"))


_LOCAL = ["http://10.1.2.3/a", "http://127.0.0.1:80/", "https://172.20.1.1/x", "https://172.32.1.1/x", "ftp://example.com/a", "http://localhost/a", "https://8.8.8.8/", "mailto:a@example.com", "http://169.254.1.1/"]


@query(f"""
WITH {_ALL}, v AS (SELECT url FROM u UNION SELECT * FROM (VALUES {", ".join(f"('{u}')" for u in _LOCAL)})), h AS (SELECT url, {_HOST} AS h FROM v)
SELECT url, coalesce(regexp_matches(lower(url), '^https?://') AND h <> '' AND h <> 'localhost' AND NOT h LIKE '%.localhost'
 AND NOT (regexp_matches(h, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AND regexp_matches(h, '^(0\\.|10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|255\\.255\\.255\\.255$)')), false) AS safe FROM h""")
def url_safe(spark: SparkSession, folder: str) -> DataFrame:
    urls = all_urls(spark, folder).union(spark.createDataFrame([(u,) for u in _LOCAL], "url string")).distinct()
    return urls.select("url", U.is_safe(F.col("url")).alias("safe"))


@query()
def redirect_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of search-engine redirects that wrap all addresses in both known forms."""
    urls = all_urls(spark, folder)
    plain = F.concat(F.lit("//lite.example.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    coded = F.concat(F.lit("https://www.search.example.com/ck/a?p=1&u=a1"), F.translate(F.rtrim(F.base64(F.col("url").cast("binary")), F.lit("=")), "+/", "-_"))
    absolute = F.concat(F.lit("https:"), plain)
    return urls.select("url", U.redirect_target(absolute).alias("plain"), U.redirect_target(coded).alias("coded"))
