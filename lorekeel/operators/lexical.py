"""Lexical index and BM25 scoring as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut

K1, B = 1.2, 0.75
#: Distinct query terms that are broadcast at most.
MAX_TERMS = 100_000


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5) + 1); 0 for an empty corpus."""
    return F.when(n_docs > 0, F.log((n_docs - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    """Term frequency by BM25, with length norm 1 where the mean length is unknown."""
    norm = F.when(mean > 0, 1 - B + B * length / mean).otherwise(F.lit(1.0))
    return tf * (K1 + 1) / (tf + K1 * norm)


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (id, term, tf, length) of all documents, of the terms in `wanted` (column term) if given.

    Term frequencies are summed within a partition before the shuffle. Up to
    MAX_TERMS wanted terms (their number is checked) are broadcast, so that
    only rows of those terms are shuffled; more are joined by a shuffle.
    """
    parts = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("tokens"))
    # The length comes first, so that no row carries the token list; the explode is an outer one, since for a
    # plain one the optimizer tests the list once more, and below the scan's spreading.
    sized = parts.select("id", F.size("tokens").alias("length"), "tokens")
    rows = sized.select("id", "length", F.explode_outer("tokens").alias("term")).filter("term is not null")
    if wanted is not None:
        terms = wanted.select("term").distinct()
        few = terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS
        rows = rows.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    return rows.groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """One row (n_docs, mean_length)."""
    return docs.select(F.size(T.tokens(F.col(text_col))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_length"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (query_id, term, n_terms), each term of a query once."""
    found = queries.select(F.col(id_col).alias("query_id"), F.array_distinct(T.tokens(F.col(text_col))).alias("terms"))
    return found.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str = "query_id", query_text: str = "query", all_words: bool = False) -> DataFrame:
    """Rows (query_id, id, score, matched) of all queries in one job; with `all_words` only documents that hold every term."""
    terms = query_terms(queries, query_id, query_text)
    found = cut(postings(docs, doc_id, doc_text, terms))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(df, "term").join(terms, "term").crossJoin(F.broadcast(corpus_statistics(docs, doc_text)))
    part = idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("mean_length"))
    out = scored.groupBy("query_id", "id", "n_terms").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return (out.filter("matched = n_terms") if all_words else out).select("query_id", "id", "score", "matched")


def bm25f(docs: DataFrame, queries: DataFrame, doc_id: str, title_col: str, body_col: str, query_id: str = "query_id", query_text: str = "query", title_weight: float = 5.0, body_weight: float = 1.0) -> DataFrame:
    """Rows (query_id, id, score): idf over both fields, each field's saturated frequency by its weight."""
    terms = query_terms(queries, query_id, query_text)
    fields = [postings(docs, doc_id, c, terms).withColumn("field", F.lit(w)) for c, w in ((title_col, title_weight), (body_col, body_weight))]
    means = [corpus_statistics(docs, c).select(F.lit(w).alias("field"), "n_docs", "mean_length") for c, w in ((title_col, title_weight), (body_col, body_weight))]
    found = cut(fields[0].unionByName(fields[1]))
    df = found.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(df, "term").join(terms, "term").join(F.broadcast(means[0].unionByName(means[1])), "field")
    part = F.col("field") * idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("mean_length"))
    return scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", per: str | None = "query_id", tie: str = "id") -> DataFrame:
    """The k best rows, of each query if `per` is given, with their rank from 1; ties go to the smaller id."""
    order = [F.round(score, 9).desc(), F.col(tie).asc()]
    if per is None:
        return scored.orderBy(*order).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= k)


def sparse_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (id, weights map<string, double>) for each document: BM25 weights of its terms."""
    found = postings(docs, id_col, text_col)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("mean_length"))
    rows = found.join(df, "term").crossJoin(F.broadcast(corpus_statistics(docs, text_col))).withColumn("weight", weight)
    return rows.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "weight")))).alias("weights"))


def top_words(docs: DataFrame, text_col: str, k: int, least: int = 3) -> DataFrame:
    """The k most frequent words (word, n) of `least` characters or more that are no stop words."""
    rows = docs.select(F.explode_outer(T.tokens(F.col(text_col))).alias("word"))
    kept = rows.filter((F.length("word") >= least) & ~F.col("word").isin(T.STOP_WORDS))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def rake(docs: DataFrame, id_col: str, text_col: str, k: int = 15, least_bytes: int = 100) -> DataFrame:
    """Rows (id, phrase, score, rank): phrases between stop words and signs, by the sum over their words of degree by frequency.

    Texts of fewer than `least_bytes` bytes give none; ties go by phrase.
    """
    long = docs.filter(F.octet_length(text_col) >= least_bytes)
    marked = F.regexp_replace(F.lower(text_col), r"[^a-z0-9à-öø-ÿ\s'-]+", " | ")
    parts = F.filter(F.split(marked, r"\s+"), lambda w: w != "")
    stopped = F.transform(parts, lambda w: F.when(w.isin(T.STOP_WORDS) | (w == "|"), F.lit("|")).otherwise(w))
    phrases = F.filter(F.transform(F.split(F.array_join(stopped, " "), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    # Dealt out once by id; everything after that keeps to this partitioning.
    rows = long.select(F.col(id_col).alias("id"), F.array_distinct(phrases).alias("phrases")).repartition("id").select("id", F.explode("phrases").alias("phrase"))
    words = rows.select("id", "phrase", F.explode(F.split("phrase", " ")).alias("word"), F.size(F.split("phrase", " ")).alias("n"))
    per = Window.partitionBy("id", "word")
    scored = words.withColumn("s", F.sum("n").over(per) / F.count("*").over(per))
    totals = scored.groupBy("id", "phrase").agg(F.sum("s").alias("score"))
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "phrase"))).filter(F.col("rank") <= k)
