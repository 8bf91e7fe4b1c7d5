"""Sources and sinks: tables, JSON exports, JSON lines, policy and index files, feeds of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

EXPORT_SCHEMA = """
version int, exported_at string,
url_nodes array<struct<url:string,domain:string,source:string,depth:int,priority:float,lastmod:string,changefreq:string,discovered_at:string,crawled:boolean,excerpt:string,embedding:array<float>>>,
link_edges array<struct<`from`:string,`to`:string,anchor_text:string>>,
page_content array<struct<url:string,content_text:string,content_markdown:string,content_html:string,excerpt:string,content_hash:string,word_count:int,reading_time_seconds:int,fetched_at:string,created_at:string>>,
crawl_jobs array<struct<url:string,status:string,attempts:int,error:string,created_at:string,updated_at:string>>
"""
CACHE_SCHEMA = "url string, last_fetched timestamp, fetches int, content_hash string, simhash bigint"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A URL cache of JSON lines, its key normalised; of equal keys the last fetched."""
    rows = spark.read.schema(CACHE_SCHEMA).json(path).withColumn("url", U.cache_key(F.col("url")))
    last = rows.groupBy("url").agg(F.max(F.struct("last_fetched", "fetches", "content_hash", "simhash")).alias("r"))
    return last.select("url", "r.*")


def write_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a versioned JSON export: url_nodes, link_edges, page_content, crawl_jobs.

    Only version 1 and one vector length are accepted. Ids come from the URLs,
    and every end of an edge gets a node. Rows of equal URL are one, the last by
    position.
    """
    whole = spark.read.schema(EXPORT_SCHEMA).option("multiLine", True).json(path)
    bad = whole.filter("version is null or version <> 1").count()
    if bad:
        raise ValueError(f"{bad} exports are not of version 1")
    nodes = whole.select(F.explode("url_nodes").alias("n")).select("n.*").filter("url is not null")
    sizes = nodes.filter("embedding is not null").select(F.size("embedding").alias("s")).distinct().limit(2).count()
    if sizes > 1:
        raise ValueError("vectors of different lengths")
    edges = whole.select(F.explode("link_edges").alias("e")).select(F.col("e.from").alias("from"), F.col("e.to").alias("to"), "e.anchor_text").filter("from is not null and to is not null")
    known = nodes.withColumn("id", U.url_id(F.col("url"))).withColumn("domain", F.coalesce("domain", U.domain(F.col("url")))).dropDuplicates(["id"])
    ends = edges.select(F.col("from").alias("url")).unionByName(edges.select(F.col("to").alias("url"))).distinct()
    stubs = ends.select("url", U.url_id(F.col("url")).alias("id"), U.domain(F.col("url")).alias("domain"), F.lit("link").alias("source"), F.lit(False).alias("crawled")).join(known, "id", "left_anti")
    content = whole.select(F.explode("page_content").alias("c")).select("c.*").withColumn("url_node_id", U.url_id(F.col("url"))).withColumn("id", F.substring(F.sha2(F.concat_ws("\n", "url", "content_text"), 256), 1, 32))
    return {
        "url_nodes": known.unionByName(stubs, allowMissingColumns=True),
        "link_edges": edges.select(U.url_id(F.col("from")).alias("source_id"), U.url_id(F.col("to")).alias("target_id"), "anchor_text"),
        "page_content": content.dropDuplicates(["id"]),
        "crawl_jobs": whole.select(F.explode("crawl_jobs").alias("j")).select("j.*").dropDuplicates(["url"]),
    }


def reconcile(expected: dict[str, int], tables: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """For each table whose row count differs, what was expected and what is there."""
    found = {name: tables[name].count() for name in expected}
    return {name: (n, found[name]) for name, n in expected.items() if found[name] != n}


def content_kind(content_type: Column) -> Column:
    """html, json, xml, text or binary from a content type; html where unknown."""
    mime = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when((mime == "application/json") | mime.endswith("+json"), "json")
        .when(mime.isin("text/html", "application/xhtml+xml", ""), "html")
        .when(mime.isin("application/xml", "text/xml") | mime.endswith("+xml"), "xml")
        .when(mime.startswith("text/"), "text")
        .when(mime.rlike("^(image|audio|video|font)/|^application/(pdf|zip|gzip|octet-stream)"), "binary")
        .otherwise("html")
    )


def charset(content_type: Column) -> Column:
    found = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*\"?([A-Za-z0-9_-]+)", 1))
    return F.when(found != "", found)


def plain_record(body: Column, kind: Column) -> Column:
    """struct(title, excerpt, markdown) of a body that is no page: JSON's title or the first line, 300 characters, a fenced block."""
    named = F.get_json_object(body, "$.title")
    line = F.substring(F.trim(F.substring_index(F.ltrim(body), "\n", 1)), 1, 120)
    fence = F.when(kind.isin("json", "xml"), kind).otherwise("")
    return F.struct(F.coalesce(F.when(kind == "json", named), line).alias("title"), F.substring(T.normalised_space(body), 1, 300).alias("excerpt"), F.concat(F.lit("```"), fence, F.lit("\n"), body, F.lit("\n```")).alias("markdown"))


def _numbered(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    lines = files.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(body_col, "﻿", ""), r"\r?\n")).alias("n", "line"))
    return lines.withColumn("line", F.trim("line"))


def robots(files: DataFrame, id_col: str, body_col: str, agent: str = "lorekeel") -> DataFrame:
    """Rows (id, sitemaps, delay_ms, rules) of robots.txt bodies.

    rules are the allow and disallow lines of the groups for `agent`, else for
    all agents; delay_ms is the least crawl delay of either.
    """
    from pyspark.sql import Window

    keyed = _numbered(files, id_col, body_col).filter("line <> '' and line not like '#%' and line like '%:%'")
    keyed = keyed.select("id", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), r"\s+#.*$", "")).alias("value"))
    before = Window.partitionBy("id").orderBy("n")
    # Agent lines that follow each other open one group.
    keyed = keyed.withColumn("starts", (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(before), F.lit("")) != "user-agent"))
    keyed = keyed.withColumn("group", F.sum(F.col("starts").cast("int")).over(before))
    agents = keyed.filter("key = 'user-agent'").groupBy("id", "group").agg(F.max(F.when(F.lower("value").contains(agent.lower()), 2).when(F.col("value") == "*", 1).otherwise(0)).alias("fit"))
    best = agents.groupBy("id").agg(F.max("fit").alias("best"))
    ruled = keyed.join(agents, ["id", "group"]).join(best, "id").filter("fit > 0")
    rules = ruled.filter("fit = best and key in ('allow', 'disallow') and value <> ''").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key", "value"))).alias("r"))
    delay = ruled.filter("key = 'crawl-delay'").groupBy("id").agg(F.min((F.col("value").try_cast("double") * 1000).cast("long")).alias("delay_ms"))
    maps = keyed.filter("key = 'sitemap'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("m"))
    out = files.select(F.col(id_col).alias("id")).distinct().join(maps, "id", "left").join(delay, "id", "left").join(rules, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", F.coalesce(F.transform("m", lambda m: m["value"]), none).alias("sitemaps"), "delay_ms", F.coalesce(F.transform("r", lambda r: F.struct(r["key"].alias("kind"), r["value"].alias("path"))), F.array().cast("array<struct<kind:string,path:string>>")).alias("rules"))


def allowed(path: Column, rules: Column) -> Column:
    """Whether robots rules let a path be read: the longest matching rule counts, allow before disallow, * and $ as wild cards."""
    pattern = lambda r: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(r["path"], r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*"))
    fits = F.filter(rules, lambda r: F.regexp_like(path, pattern(r)))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), (r["kind"] == "allow").cast("int").alias("ok"))))
    return F.coalesce(best["ok"] == 1, F.lit(True))


def llms_index(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Rows (id, site_name, summary, section, name, url, description, position) of llms.txt bodies."""
    from pyspark.sql import Window

    lines = _numbered(files, id_col, body_col)
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 100000)))
    lines = lines.withColumn("section", F.last(heading, ignorenulls=True).over(before))
    link = r"^- \[([^\]]+)\]\(([^)]+)\)\s*(?::\s*(.*))?$"
    entries = lines.filter(F.col("line").rlike(link)).select("id", "n", F.coalesce("section", F.lit("")).alias("section"), F.trim(F.regexp_extract("line", link, 1)).alias("name"), F.trim(F.regexp_extract("line", link, 2)).alias("url"), F.regexp_extract("line", link, 3).alias("d"))
    heads = lines.groupBy("id").agg(F.min(F.when(F.col("line").startswith("# "), F.struct("n", F.trim(F.substring("line", 3, 100000)).alias("v")))).alias("h"), F.array_sort(F.collect_list(F.when(F.col("line").startswith("> "), F.struct("n", F.trim(F.substring("line", 3, 100000)).alias("v"))))).alias("s"))
    heads = heads.select("id", F.col("h.v").alias("site_name"), F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda s: s["v"]), " ")).alias("summary"))
    return heads.join(entries, "id", "left").select("id", "site_name", "summary", "section", "name", "url", F.when(F.col("d") != "", F.col("d")).alias("description"), F.row_number().over(Window.partitionBy("id").orderBy("n")).alias("position"))


def sitemap(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Rows (id, kind, url, lastmod, changefreq, priority) of sitemap bodies; kind is page, or index for a nested sitemap.

    Priority is 0.5 where none is given.
    """
    blocks = F.regexp_extract_all(F.col(body_col), F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>.*?</(?:url|sitemap)\s*>"), 0)
    rows = files.select(F.col(id_col).alias("id"), F.explode(blocks).alias("b"))
    part = lambda tag: F.when(F.regexp_extract("b", rf"(?is)<{tag}\b[^>]*>\s*(.*?)\s*</{tag}\s*>", 1) != "", F.regexp_replace(F.regexp_extract("b", rf"(?is)<{tag}\b[^>]*>\s*(.*?)\s*</{tag}\s*>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    return rows.select("id", F.when(F.lower("b").startswith("<sitemap"), "index").otherwise("page").alias("kind"), F.replace(part("loc"), F.lit("&amp;"), F.lit("&")).alias("url"), F.try_to_timestamp(part("lastmod")).alias("lastmod"), part("changefreq").alias("changefreq"), F.coalesce(part("priority").try_cast("double"), F.lit(0.5)).alias("priority")).filter("url is not null")


def listing(files: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Rows (id, position, title, text, url, score) of listing JSON: an object, or an array of objects, with data.children."""
    item = "struct<data:struct<title:string,selftext:string,body:string,url:string,score:bigint>>"
    page = f"struct<data:struct<children:array<{item}>>>"
    body = F.trim(F.col(body_col))
    pages = F.when(body.startswith("["), F.from_json(body, f"array<{page}>")).otherwise(F.array(F.from_json(body, page)))
    items = F.flatten(F.transform(F.filter(pages, lambda p: p.isNotNull()), lambda p: F.coalesce(p["data"]["children"], F.array().cast(f"array<{item}>"))))
    rows = files.select(F.col(id_col).alias("id"), F.posexplode(items).alias("position", "x"))
    return rows.select("id", "position", "x.data.title", F.coalesce("x.data.selftext", "x.data.body").alias("text"), "x.data.url", "x.data.score")


#: Curated starting points by topic, with their tier and crawl order.
CATALOGUE = [
    ("rust", "https://doc.rust-lang.org/", "official", 1), ("python", "https://docs.python.org/3/", "official", 1), ("javascript", "https://developer.mozilla.org/", "official", 1), ("go", "https://go.dev/doc/", "official", 1),
    ("science", "https://arxiv.org/", "reference", 1), ("science", "https://www.nature.com/", "reference", 2), ("health", "https://www.who.int/", "official", 1), ("health", "https://www.nih.gov/", "official", 2),
    ("security", "https://nvd.nist.gov/", "official", 1), ("standards", "https://www.ietf.org/", "official", 1), ("standards", "https://www.w3.org/", "official", 2), ("encyclopedia", "https://en.wikipedia.org/", "encyclopedia", 1),
]


def catalogue(spark: SparkSession, topic: str | None = None) -> DataFrame:
    """Rows (topic, url, tier, ordinal) of the curated catalogue by tier precision, then ordinal."""
    rows = spark.createDataFrame(CATALOGUE, "topic string, url string, tier string, ordinal int")
    order = F.when(F.col("tier") == "official", 1.0).when(F.col("tier") == "reference", 0.7).otherwise(0.55)
    return (rows.filter(F.col("topic") == topic) if topic else rows).orderBy(order.desc(), "ordinal", "url")


def language_model_view(results: DataFrame, *columns: str) -> DataFrame:
    """One JSON string a row of the named columns; nulls are left out."""
    return results.select(F.to_json(F.struct(*columns)).alias("record"))
