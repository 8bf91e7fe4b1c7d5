"""Every core query against its SQL on the smallest tables."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

from lorekeel.plans import registry

TABLES = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return str(value) if isinstance(value, date | datetime) else value


def close(a, b):
    if isinstance(a, bool) or isinstance(b, bool) or not (isinstance(a, int | float) and isinstance(b, int | float)):
        return a == b
    return abs(a - b) <= 1e-5 * max(1.0, abs(a))


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_spark_agrees_with_sql(spark, tables, name):
    df = registry.queries()[name](spark, str(TABLES))
    result = tables.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = ordered([tuple(plain(v) for v in row) for row in result.fetchall()])
    got = ordered([tuple(plain(row[c]) for c in columns) for row in df.collect()])
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    df = registry.queries()[name](spark, str(TABLES))
    assert df.columns and df.count() > 0


def test_weighted_pagerank_agrees_with_sql_where_a_source_has_no_weight(spark, tmp_path):
    ids = [*"abcdefgx", "g", None]
    links = [("a", "b", 0.0), ("b", "c", 1.0), ("d", "e", 1.0), ("d", "f", -1.0), ("x", "g", None), ("x", "d", 0.0), ("x", None, 3.0), (None, "x", 1.0), ("q", "x", 0.0)]
    con = duckdb.connect()
    spark.createDataFrame([(i, "www.x.example") for i in ids], "id string, domain string").write.parquet(f"{tmp_path}/url_nodes.parquet")
    spark.createDataFrame([(*link, "", "hyperlink") for link in links], "source_id string, target_id string, weight double, anchor_text string, edge_type string").write.parquet(f"{tmp_path}/link_edges.parquet")
    for name in ("url_nodes", "link_edges"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = dict(con.execute(registry.oracle_sql()["pagerank_weighted"]).fetchall())
    got = {r["node"]: r["score"] for r in registry.queries()["pagerank_weighted"](spark, str(tmp_path)).collect()}
    assert math.isnan(want["b"]) and math.isinf(want["e"]) and want["g"] > want["x"]
    assert got == pytest.approx(want, abs=1e-9, nan_ok=True)
