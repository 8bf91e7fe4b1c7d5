"""Streaming queries run over the files that are there; batch SQL gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, table
from ..streaming import streams
from .registry import query


def _work(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp()


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return streams.file_stream(spark, folder, schema, "events.parquet")


def _run(spark: SparkSession, make: Callable[[], DataFrame], mode: str) -> DataFrame:
    """The rows that a stream over all files leaves, written as Parquet: its last batch in complete mode, every batch in append mode."""
    work = _work(spark)
    df = make()
    out = f"{work}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    streams.run_available(df, f"{work}/checkpoint", mode, each=keep)
    return spark.read.schema(df.schema).parquet(out) if mode == "complete" else spark.read.parquet(out).select(*df.columns)


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.unix_micros(c).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, lambda: streams.counters(_events(spark, folder), "event_type", "user_id"), "complete")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _micros(_run(spark, lambda: streams.windowed_counts(streams.event_time(_events(spark, folder), "ts"), "ts", "1 hour", keys=("event_type",)), "complete"), "start")


@query("SELECT epoch_us(time_bucket(INTERVAL '30 minutes', ts) - o * INTERVAL '30 minutes') AS start, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) v(o) GROUP BY ALL")
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _micros(_run(spark, lambda: streams.windowed_counts(streams.event_time(_events(spark, folder), "ts"), "ts", "1 hour", "30 minutes"), "complete"), "start")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 3600000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _micros(_run(spark, lambda: streams.session_counts(streams.event_time(_events(spark, folder), "ts"), "ts", "user_id", "1 hour"), "complete"), "start", "end")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, lambda: streams.distinct_events(streams.event_time(_events(spark, folder), "ts", "3650 days"), "event_id").select("event_id"), "append")


@query()
def stream_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, lambda: streams.streak_fold(_events(spark, folder), "user_id", F.col("event_type") != "error"), "update")


@query("SELECT event_id, user_id FROM events WHERE value > 10")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    work = _work(spark)
    streams.ingest(_events(spark, folder), lambda batch: batch.filter("value > 10").select("event_id", "user_id"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out").select("event_id", "user_id")
