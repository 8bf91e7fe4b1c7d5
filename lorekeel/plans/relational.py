"""Relational queries: joins, aggregates, windows, set operations.

Catalyst plans them from SQL that both engines read alike; a name in braces is
a table of the data folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import table
from .registry import query


def both(name: str, text: str) -> None:
    """Register a query whose text serves both engines."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))

    @query(re.sub(r"\{(\w+)\}", r"\1", text), name=name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, folder, t) for t in tables})


both("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
both("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""")
both("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name""")
both("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
both("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
both("join_three_way", "SELECT e.edge_type, a.depth AS from_depth, b.depth AS to_depth, count(*) AS n FROM {link_edges} e JOIN (SELECT id, min(depth) AS depth FROM {url_nodes} GROUP BY id) a ON e.source_id = a.id JOIN (SELECT id, min(depth) AS depth FROM {url_nodes} GROUP BY id) b ON e.target_id = b.id GROUP BY e.edge_type, a.depth, b.depth")
both("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
both("join_full", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) c ON s_nationkey = c_nationkey")
both("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
both("join_anti", "SELECT id FROM (SELECT DISTINCT id FROM {url_nodes}) n WHERE NOT EXISTS (SELECT 1 FROM {link_edges} WHERE target_id = n.id)")
both("join_theta", "SELECT r_name, n_name FROM {region} JOIN {nation} ON r_regionkey <> n_regionkey AND length(r_name) < length(n_name)")
both("join_newest", "SELECT n.id, max(p.fetched_at) IS NOT NULL AS has_page, count(DISTINCT p.id) AS versions FROM (SELECT DISTINCT id FROM {url_nodes}) n LEFT JOIN {page_content} p ON p.url_node_id = n.id GROUP BY n.id")
both("join_correlated_count", "SELECT s_suppkey, (SELECT count(*) FROM {lineitem} WHERE l_suppkey = s_suppkey) AS items FROM {supplier}")
both("setop_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("setop_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) u GROUP BY k")
both("setop_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
both("setop_intersect", "SELECT p_partkey AS k FROM {part} INTERSECT SELECT l_partkey FROM {lineitem}")
both("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
both("agg_grouping_sets", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
both("agg_having", "SELECT l_suppkey, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 10")
both("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type")
both("agg_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM {events} GROUP BY user_id")
both("window_ntile", "SELECT c_custkey, ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS decile FROM {customer}")
both("window_lag", "SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS change, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM {orders}")
both("window_running", "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM {lineitem}")
both("window_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {part}")
both("window_top_per_group", "SELECT c_nationkey, c_custkey, r FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) t WHERE r <= 3")
both("window_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p FROM {part}")
both("window_last_value", "SELECT event_id, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM {events}")
both("null_functions", "SELECT doc_id, coalesce(title, url, '') AS name, nullif(lang, '') AS lang, CASE WHEN language IS NULL THEN 0 ELSE length(language) END AS n FROM {documents}")
both("recursive_levels", "WITH RECURSIVE r(n, p) AS (SELECT 1, 1 UNION ALL SELECT n + 1, p * 2 FROM r WHERE n < 12) SELECT n, p FROM r")


@query("SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def agg_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.99), 6).alias("p99"), F.round(F.percentile("value", 0.5), 6).alias("median"))


@query("SELECT event_id, user_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND p.ts < e.ts)::VARCHAR IS NOT NULL AS after_error, coalesce((SELECT arg_max(p.event_id, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND p.ts < e.ts), -1) AS error_id FROM events e WHERE event_type = 'click'")
def join_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each click with its user's last error before it: one pass over a window, no range join."""
    rows = table(spark, folder, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    earlier = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).over(earlier)
    return rows.withColumn("e", last).filter("event_type = 'click'").select("event_id", "user_id", F.col("e").isNotNull().alias("after_error"), F.coalesce("e.event_id", F.lit(-1)).cast("long").alias("error_id"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size < 10) AS small, count(*) FILTER (WHERE p_size BETWEEN 10 AND 29) AS middle, count(*) FILTER (WHERE p_size >= 30) AS large FROM part GROUP BY p_brand")
def agg_pivot(spark: SparkSession, folder: str) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    rows = table(spark, folder, "part").withColumn("_size", size).groupBy("p_brand").pivot("_size", ["small", "middle", "large"])
    return rows.agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
