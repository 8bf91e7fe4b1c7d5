"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, texts
from . import bpe, imi, langid, leakage, mainbody, oddsketch, residue, sitelines, truncation


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.mislabelled(langid.languages(texts(spark, folder, "documents"), table(spark, folder, "language_samples")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.boilerplate_lines(texts(spark, folder, "page_content"), table(spark, folder, "url_nodes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return imi.neighbour_pairs(imi.nearest_vectors(table(spark, folder, "url_nodes")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(texts(spark, folder, "page_content")).select("id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = oddsketch.near_duplicates(texts(spark, folder, "page_content"), threshold=0.5, shingle=3, min_words=40, bands=90, rows=5)
    return pairs.select("id_a", "id_b")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = sitelines.repeated_lines(texts(spark, folder, "page_content"), table(spark, folder, "url_nodes"), min_texts=2, min_dates=2)
    return lines.select("id", "line_no")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(texts(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaked_items(texts(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.filter("kind = 'passage'").select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(texts(spark, folder, "documents")).filter("cut").select("doc_id")


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_by_source(truncation.truncated(texts(spark, folder, "documents"), keep=("source",)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: call for name, call in globals().items() if name[0] == "p" and name[1].isdigit()}
