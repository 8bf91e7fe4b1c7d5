"""Exact vector search over arrays of floats, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors broadcast at most; larger query sets are scored in blocks.
MAX_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0, null where the lengths differ."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0)))


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """Rows (query_id, id, similarity, rank) of the k most similar vectors of each query, by a scan of all vectors.

    Vectors of another length, null ones and those with NaN are skipped; ties go to the
    smaller id. The query side is broadcast after its number is checked; each
    batch of vectors meets it in one matrix product and passes on its k best.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q")).filter("q is not null")
    found = asked.limit(MAX_QUERIES + 1).collect()
    if len(found) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; score them in blocks")
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(row["q"]) for row in found}:
        own = [row for row in found if len(row["q"]) == size]
        by_size[size] = ([row["query_id"] for row in own], np.array([row["q"] for row in own], np.float64))
    held = vectors.sparkSession.sparkContext.broadcast(by_size)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and v is not null").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    query_type = asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", rows.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow_type = to_arrow_type(query_type)

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size, (names, q) in held.value.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                x = np.asarray(batch.column(1).take(pa.array(at)).flatten()).reshape(len(at), size)
                scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sims = np.where(scale > 0, q @ x.T / scale, 0.0)
                # Of each batch the k best and whatever ties with the last of them.
                edge = np.partition(sims, len(at) - k, axis=1)[:, [len(at) - k]] - 2e-9 if len(at) > k else -np.inf
                who, which = np.nonzero(sims >= edge)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in who], arrow_type), batch.column(0).take(pa.array(at[which])), pa.array(sims[who, which])], names=["query_id", "id", "similarity"])

    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), F.col("id").asc())
    return rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def one_dimension(vectors: DataFrame, vector_col: str) -> int | None:
    """The common length of all vectors; an error if they differ, None if there are none."""
    row = vectors.filter(F.col(vector_col).isNotNull()).agg(F.min(F.size(vector_col)).alias("a"), F.max(F.size(vector_col)).alias("b")).first()
    if row["a"] != row["b"]:
        raise ValueError(f"vectors of {row['a']} to {row['b']} numbers")
    return row["a"]
