"""Queries of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..runtime import table
from .registry import query

_START = "(SELECT min(source_id) FROM link_edges)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "link_edges")
    return rows.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight", "anchor_text", "edge_type")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "url_nodes").groupBy("id").agg(F.min(F.regexp_replace(F.lower("domain"), r"^www\.", "")).alias("domain"))
    return rows.withColumnRenamed("id", "node")


def _bfs_sql(links: str, depth: int) -> str:
    levels = ["l0 AS (SELECT min(source_id) AS node FROM link_edges)", "s0 AS (SELECT node, 0 AS depth FROM l0)"]
    for i in range(1, depth + 1):
        levels.append(f"l{i} AS (SELECT DISTINCT e.b AS node FROM l{i - 1} JOIN e ON e.a = l{i - 1}.node WHERE e.b NOT IN (SELECT node FROM s{i - 1}))")
        levels.append(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT node, {i} FROM l{i})")
    return f"WITH e AS ({links}), {', '.join(levels)} SELECT node, depth FROM s{depth}"


_OUT = "SELECT DISTINCT source_id AS a, target_id AS b FROM link_edges"
_IN = "SELECT DISTINCT target_id AS a, source_id AS b FROM link_edges"


def _bfs(spark: SparkSession, folder: str, direction: str, depth: int) -> DataFrame:
    links = edges(spark, folder)
    return graph.bfs(links, links.agg(F.min("src").alias("node")), depth, direction)


@query(_bfs_sql(_OUT, 3))
def bfs_out(spark: SparkSession, folder: str) -> DataFrame:
    return _bfs(spark, folder, "out", 3)


@query(_bfs_sql(_IN, 3))
def bfs_in(spark: SparkSession, folder: str) -> DataFrame:
    return _bfs(spark, folder, "in", 3)


@query(_bfs_sql(f"{_OUT} UNION {_IN}", 2))
def bfs_both(spark: SparkSession, folder: str) -> DataFrame:
    return _bfs(spark, folder, "both", 2)


@query("""
WITH e AS (SELECT source_id AS node, 1 AS o, 0 AS i FROM link_edges UNION ALL SELECT target_id, 0, 1 FROM link_edges)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM e GROUP BY node""")
def link_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(edges(spark, folder))


@query("SELECT target_id AS node, round(1 / (60 + 100.0 / count(*)), 8) AS signal FROM link_edges GROUP BY ALL")
def indegree_signal(spark: SparkSession, folder: str) -> DataFrame:
    into = edges(spark, folder).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return into.select("node", F.round(graph.in_degree_signal(F.col("n")), 8).alias("signal"))


_NODES = "nodes AS (SELECT id AS node, min(regexp_replace(lower(domain), '^www\\.', '')) AS domain FROM url_nodes GROUP BY id)"


@query(f"""
WITH {_NODES}, p AS (SELECT domain, count(*) AS pages FROM nodes GROUP BY domain),
o AS (SELECT domain, count(*) AS n FROM link_edges JOIN nodes ON node = source_id GROUP BY domain), i AS (SELECT domain, count(*) AS n FROM link_edges JOIN nodes ON node = target_id GROUP BY domain)
SELECT domain, pages, coalesce(o.n, 0) AS out_links, coalesce(i.n, 0) AS in_links FROM p LEFT JOIN o USING (domain) LEFT JOIN i USING (domain)""")
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return graph.summary(nodes(spark, folder), edges(spark, folder))


@query("""
SELECT target_id AS node, coalesce(array_to_string(list_sort(list(DISTINCT trim(anchor_text)) FILTER (WHERE trim(anchor_text) <> '')), ' '), '') AS anchors, count(*) AS inbound FROM link_edges GROUP BY target_id""")
def anchor_texts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.anchor_texts(edges(spark, folder))


def _pagerank_sql(share: str, rounds: int) -> str:
    base = "(SELECT 0.15 / count(*) FROM nodes)"
    steps = [_NODES, f"m AS (SELECT source_id AS src, target_id AS dst, {share} AS w FROM link_edges GROUP BY ALL)", "l AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM m)", f"r0 AS (SELECT node, {base}::DOUBLE AS score FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT node, {base} + 0.85 * coalesce(f.s, 0) AS score FROM nodes LEFT JOIN (SELECT dst, sum(score * p) AS s FROM r{i - 1} JOIN l ON src = node GROUP BY dst) f ON f.dst = node)")
    return f"WITH {', '.join(steps)} SELECT node, round(score, 9) AS score FROM r{rounds}"


@query(_pagerank_sql("count(*)::DOUBLE", 20))
def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pagerank(nodes(spark, folder), edges(spark, folder)).select("node", F.round("score", 9).alias("score"))


@query(_pagerank_sql("sum(coalesce(weight, 1.0))", 10))
def pagerank_weighted(spark: SparkSession, folder: str) -> DataFrame:
    links = edges(spark, folder).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return graph.pagerank(nodes(spark, folder), links, iterations=10, weight="weight").select("node", F.round("score", 9).alias("score"))


@query()
def pagerank_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """A warm start from scores over the hyperlinks alone, then all edges."""
    links = edges(spark, folder)
    before = graph.pagerank(nodes(spark, folder), links.filter("edge_type = 'hyperlink'"), iterations=10)
    return graph.pagerank(nodes(spark, folder), links, iterations=10, warm=before).select("node", F.round("score", 9).alias("score"))


@query(_bfs_sql(_OUT, 2).replace("SELECT node, depth FROM", "SELECT node FROM"))
def pagerank_affected(spark: SparkSession, folder: str) -> DataFrame:
    links = edges(spark, folder)
    return graph.affected(links, links.agg(F.min("src").alias("node")), 2)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM link_edges UNION SELECT DISTINCT target_id, source_id FROM link_edges),
w(node, r) AS (SELECT a, a FROM e UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.node) SELECT node, min(r) AS component FROM w GROUP BY node""")
def components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(edges(spark, folder))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM link_edges), n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
w(s, t) AS (SELECT node, node FROM n UNION SELECT w.s, e.b FROM w JOIN e ON e.a = w.t)
SELECT x.s AS node, max(x.t) AS component FROM w x JOIN w y ON x.s = y.t AND x.t = y.s GROUP BY x.s""")
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.strong_components(edges(spark, folder))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 + 1000000000 AS a, l_partkey AS b FROM lineitem UNION SELECT DISTINCT s_nationkey - 1000, s_suppkey * 2 + 1000000000 FROM supplier UNION SELECT n_regionkey - 2000, n_nationkey - 1000 FROM nation),
n AS (SELECT a AS node FROM e UNION SELECT b FROM e), w(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.node)
SELECT node, max(level) AS level FROM w GROUP BY node""")
def topological_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of region, nation, supplier and part, each keyed in its own range."""
    part = table(spark, folder, "lineitem").select((F.col("l_suppkey") * 2 + 1000000000).alias("src"), F.col("l_partkey").alias("dst"))
    supplier = table(spark, folder, "supplier").select((F.col("s_nationkey") - 1000).cast("long").alias("src"), (F.col("s_suppkey") * 2 + 1000000000).alias("dst"))
    nation = table(spark, folder, "nation").select((F.col("n_regionkey") - 2000).cast("long").alias("src"), (F.col("n_nationkey") - 1000).cast("long").alias("dst"))
    return graph.topological_levels(part.unionByName(supplier).unionByName(nation).distinct()).select("node", "level")


def _paths_sql(rounds: int) -> str:
    steps = ["e AS (SELECT source_id AS a, target_id AS b, min(weight) AS w FROM link_edges WHERE weight IS NOT NULL GROUP BY ALL)", "d0 AS (SELECT min(source_id) AS node, 0.0::DOUBLE AS dist FROM link_edges)"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT * FROM d{i - 1} UNION ALL SELECT e.b, d{i - 1}.dist + e.w FROM d{i - 1} JOIN e ON e.a = d{i - 1}.node) GROUP BY node)")
    return f"WITH {', '.join(steps)} SELECT node, round(dist, 6) AS distance FROM d{rounds}"


@query(_paths_sql(40))
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    links = edges(spark, folder).filter("weight is not null")
    start = links.agg(F.min("src")).first()[0]
    return graph.shortest_paths(links, start).select("node", F.round("distance", 6).alias("distance"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS item, l_linenumber AS n FROM lineitem)
SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM p a JOIN p b ON a.g = b.g AND b.n > a.n AND b.n - a.n <= 2 AND a.item <> b.item GROUP BY ALL""")
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    return graph.cooccurrence(rows, "l_orderkey", "l_partkey", "l_linenumber", 2)
