"""Structured Streaming: counters, event-time windows, sessions, deduplication and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_a_batch: int = 16) -> DataFrame:
    """A stream of Parquet files; so many files make one micro-batch at most."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def event_time(df: DataFrame, time_col: str, lateness: str = "10 minutes") -> DataFrame:
    """`df` with its time column as a timestamp under a watermark; columns without a zone are cast first."""
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)


def windowed_counts(df: DataFrame, time_col: str, length: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (start, *keys, n) of tumbling, or with `slide` sliding windows."""
    window = F.window(time_col, length, slide or length)
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(df: DataFrame, time_col: str, key: str, gap: str) -> DataFrame:
    """Rows (key, start, end, n): runs of events of one key no further than `gap` apart."""
    return df.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(df: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def counters(df: DataFrame, *keys: str) -> DataFrame:
    """Running counts by key, for output mode update or complete."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def streak_fold(df: DataFrame, key: str, ok: Column, limit: int = 2) -> DataFrame:
    """Rows (key, failures, discarded): failures in a row for each key, which is discarded after more than `limit`."""
    key_type = df.schema[key].dataType
    out = T.StructType([T.StructField(key, key_type), T.StructField("failures", T.LongType()), T.StructField("discarded", T.BooleanType())])
    state_schema = T.StructType([T.StructField("failures", T.LongType()), T.StructField("discarded", T.BooleanType())])

    def fold(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, discarded = state.get if state.exists else (0, False)
        for part in parts:
            for good in part["_ok"]:
                failures = 0 if good else failures + 1
                discarded = discarded or failures > limit
        state.update((failures, discarded))
        yield pd.DataFrame({key: [keys[0]], "failures": [failures], "discarded": [discarded]})

    marked = df.select(key, ok.alias("_ok"))
    return marked.groupBy(key).applyInPandasWithState(fold, out, state_schema, "update", "NoTimeout")


def run_available(df: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None] | None = None, table: str | None = None, path: str | None = None) -> None:
    """Run a stream over what is there and stop: into a memory table, a Parquet folder, or `each` micro-batch.

    Batches carry their number, so that a batch repeated after a failure can be
    written over its first attempt.
    """
    writer: DataStreamWriter = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        writer = writer.foreachBatch(each)
    elif table is not None:
        writer = writer.format("memory").queryName(table)
    else:
        writer = writer.format("parquet").option("path", path)
    running = writer.start()
    running.awaitTermination()


def ingest(df: DataFrame, gate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Each micro-batch gated and written to a folder of its own number, rewritten whole if the batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        gate(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(df, checkpoint, "append", each=write)
