"""Page records and source files."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeel.runtime import cut, shared_dir
from lorekeel.sources import pages, readers

PAGE = """<!doctype html><html lang="en"><head><title>T &amp; U</title><meta property="og:title" content="O"><meta name="author" content="Bea"><meta property="article:published_time" content="2024-01-02"><meta property="og:broken">
<link rel="icon" href="/i.png"><script>var t = "</p><nav>";</script><script type="application/ld+json">{"@type": "NewsArticle", "author": {"name": "Ann"}, "isAccessibleForFree": false}</script></head><body><nav><a href="/menu">Menu</a></nav>
<main><h1 id="top">How does it work?</h1><p>It works because every part does what it should, and no part does more. <b>Truly<p>Second paragraph with <a href="//z.example/q">a link</a>, <a href="#x">none</a> and <a href="/r">another</a>.
<h2>Steps to take</h2><ol><li>First<li>Second</ol><pre><code class="language-mermaid">graph TD
  alpha --> beta
  beta --> gamma</code></pre><table><caption>C</caption><tr><th>A<th>B<tr><td>1<td>2</table><blockquote>Note: mind the gap</blockquote><img src="flow.png" alt="workflow diagram"><div class="newsletter">Subscribe now</div></main><footer>Foot</footer></body></html>"""


def test_page_record():
    r = pages.extract(PAGE, "https://a.example/x/y")
    assert r["title"] == "T & U" and r["author"] == "Ann" and r["published"] == "2024-01-02" and r["lang"] == "en" and r["schema_type"] == "NewsArticle" and r["paywall"] and r["valid"]
    assert "Menu" not in r["text"] and "Foot" not in r["text"] and "Subscribe" not in r["text"] and r["text"].startswith("How does it work?")
    assert r["internal_links"] == ["https://a.example/menu", "https://a.example/r"] and r["external_links"] == ["https://z.example/q"]
    assert r["headings"][0] == {"level": 1, "text": "How does it work?", "anchor": "top"} and [s["title"] for s in r["steps"]] == ["First", "Second"]
    assert r["faqs"][0]["answer"].startswith("It works because") and r["code"][0]["language"] == "mermaid" and [d["kind"] for d in r["diagrams"]] == ["mermaid", "image"]
    assert r["tables"] == [{"caption": "C", "headers": ["A", "B"], "rows": [["1", "2"]]}] and r["callouts"][0]["kind"] == "note" and r["favicon"] == "/i.png"
    assert "## Steps to take" in r["markdown"] and "| A | B |" in r["markdown"] and "<table>" in r["clean_html"] and "<script" not in r["clean_html"]


def test_all_images_of_a_page_are_kept():
    r = pages.extract("<main>" + "".join(f'<img src="/{n}.png">' for n in range(120)) + "</main>", "https://a.example/")
    assert [i["url"] for i in r["images"]] == [f"/{n}.png" for n in range(120)]


@pytest.mark.parametrize("markup", [None, "", "plain", "<p", "<<>>", "</div></p>", "<script>never closed", "<b>" * 3000 + "x", "&#xZZ; &bogus;"])
def test_broken_pages_give_records(markup):
    r = pages.extract(markup, None)
    assert r["valid"] in (True, False) and isinstance(r["text"], str)


def test_extract_pages_keeps_every_row(spark):
    df = spark.createDataFrame([("a", PAGE, "https://a.example/"), ("b", None, None), ("b", "", "x")], "id string, html string, url string")
    got = pages.extract_pages(df, "id", "html", "url")
    assert got.count() == 3 and got.filter("page.valid").count() == 1


def test_relevant_text(spark):
    row = spark.createDataFrame([("One about cats. Two about dogs! Three.",)], "t string").select(pages.relevant_text(F.col("t"), F.array(F.lit("DOGS"))).alias("x"), pages.relevant_text(F.col("t"), F.array(F.lit("birds"))).alias("y")).first()
    assert row["x"] == "Two about dogs!" and row["y"].startswith("One about")


def test_robots(spark):
    body = "# c\nUser-agent: other\nDisallow: /o\n\nUser-agent: *\nUser-agent: x\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 1.5\nSitemap: https://a.example/s.xml\n"
    files = spark.createDataFrame([("a", body), ("b", ""), ("c", None)], "id string, body string")
    got = {r["id"]: r for r in readers.robots(files, "id", "body").collect()}
    assert got["a"]["sitemaps"] == ["https://a.example/s.xml"] and got["a"]["delay_ms"] == 1500 and [r["path"] for r in got["a"]["rules"]] == ["/private", "/private/open", "/*.pdf$"] and got["b"]["rules"] == got["c"]["rules"] == []
    paths = ["/", "/private/x", "/private/open/x", "/a.pdf", "/a.pdfx", "/o"]
    rules = readers.robots(files, "id", "body").filter("id = 'a'").select("rules")
    checked = spark.createDataFrame([(p,) for p in paths], "p string").crossJoin(rules).select("p", readers.allowed(F.col("p"), F.col("rules")).alias("ok"))
    assert {r["p"]: r["ok"] for r in checked.collect()} == {"/": True, "/private/x": False, "/private/open/x": True, "/a.pdf": False, "/a.pdfx": True, "/o": True}


def test_llms_index(spark):
    body = "﻿# Site\n> One\n> two\nprose\n## Docs\n- [A](https://a.example/a): about a\n- [B](https://a.example/b)\n- broken\n## More\n- [C](c)\n"
    got = readers.llms_index(spark.createDataFrame([("x", body)], "id string, body string"), "id", "body").orderBy("position").collect()
    assert [(r["site_name"], r["summary"], r["section"], r["name"], r["description"]) for r in got] == [("Site", "One two", "Docs", "A", "about a"), ("Site", "One two", "Docs", "B", None), ("Site", "One two", "More", "C", None)]


def test_sitemaps(spark):
    body = "<urlset><url><loc>https://a.example/?x=1&amp;y=2</loc><lastmod>2024-01-02</lastmod><priority>0.9</priority></url><url><loc><![CDATA[https://a.example/b]]></loc></url></urlset>"
    nested = "<sitemapindex><sitemap><loc>https://a.example/s2.xml</loc></sitemap></sitemapindex>"
    got = readers.sitemap(spark.createDataFrame([("x", body), ("y", nested), ("z", "")], "id string, body string"), "id", "body").orderBy("url").collect()
    assert [(r["kind"], r["url"], r["priority"]) for r in got] == [("page", "https://a.example/?x=1&y=2", 0.9), ("page", "https://a.example/b", 0.5), ("index", "https://a.example/s2.xml", 0.5)]


def test_listing(spark):
    page = {"data": {"children": [{"data": {"title": "T", "selftext": "S", "score": 3}}, {"data": {"body": "B"}}]}}
    rows = [("a", json.dumps(page)), ("b", json.dumps([page, page])), ("c", "{}"), ("d", "broken"), ("e", None)]
    got = readers.listing(spark.createDataFrame(rows, "id string, body string"), "id", "body")
    assert {(r["id"], r["count"]) for r in got.groupBy("id").count().collect()} == {("a", 2), ("b", 4)} and got.filter("position = 1").first()["text"] == "B"


def export(tmp_path, **change):
    body = {"version": 1, "url_nodes": [{"url": "https://a.example/", "embedding": [1.0, 2.0]}, {"url": "https://a.example/"}], "link_edges": [{"from": "https://a.example/", "to": "https://b.example/x"}], "page_content": [{"url": "https://a.example/", "content_text": "t"}], "crawl_jobs": [{"url": "u"}]} | change
    path = tmp_path / "export.json"
    path.write_text(json.dumps(body, indent=1))
    return str(path)


def test_exports(spark, tmp_path):
    tables = readers.read_export(spark, export(tmp_path))
    assert {r["url"] for r in tables["url_nodes"].collect()} == {"https://a.example/", "https://b.example/x"}
    assert readers.reconcile({"url_nodes": 2, "link_edges": 1, "page_content": 1, "crawl_jobs": 3}, tables) == {"crawl_jobs": (3, 1)}
    ids = {r["id"] for r in tables["url_nodes"].collect()}
    assert {tables["link_edges"].first()["source_id"], tables["link_edges"].first()["target_id"]} == ids


@pytest.mark.parametrize("change", [{"version": 2}, {"url_nodes": [{"url": "a", "embedding": [1.0]}, {"url": "b", "embedding": [1.0, 2.0]}]}])
def test_bad_exports_are_refused(spark, tmp_path, change):
    with pytest.raises(ValueError):
        readers.read_export(spark, export(tmp_path, **change))


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("https://A.example/x/", 1, "h1"), ("https://a.example/x#y", 2, "h2")], "url string, fetches int, content_hash string").withColumn("last_fetched", F.timestamp_seconds(F.col("fetches"))).withColumn("simhash", F.lit(5).cast("long"))
    readers.write_cache(rows, path)
    got = readers.read_cache(spark, path).collect()
    assert [(r["url"], r["fetches"]) for r in got] == [("https://a.example/x", 2)]


def test_content_kinds(spark):
    df = spark.createDataFrame([("text/html; charset=\"UTF-8\"",), ("application/ld+json",), ("image/png",), (None,), ("text/csv",), ("application/atom+xml",)], "t string")
    assert [r[0] for r in df.select(readers.content_kind(F.col("t"))).collect()] == ["html", "json", "binary", "html", "text", "xml"]
    assert df.select(readers.charset(F.col("t")).alias("c")).first()["c"] == "utf-8"
    record = spark.createDataFrame([('{"title": "X", "a": 1}', "json"), ("first line\nsecond", "text")], "b string, k string").select(readers.plain_record(F.col("b"), F.col("k")).alias("r")).collect()
    assert [r["r"]["title"] for r in record] == ["X", "first line"] and record[0]["r"]["markdown"].startswith("```json\n")


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert shared_dir(spark) and df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().toString()
