"""Query logs, categories, stored bytes and crawl history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_NGRAM = 3


def normalised_query(query: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^a-z0-9à-öø-ÿ\s]", ""), r"\s+", " "))


def query_ngrams(log: DataFrame, query_col: str, most: int = MAX_NGRAM) -> DataFrame:
    """Rows (ngram, ngram_len, count) of one to `most` neighbouring words of all logged queries."""
    parts = T.words(normalised_query(F.col(query_col)))
    rows = None
    for n in range(1, most + 1):
        part = log.select(F.explode_outer(T.shingles(parts, n)).alias("ngram"), F.lit(n).alias("ngram_len")).filter("ngram is not null")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("ngram", "ngram_len").agg(F.count("*").alias("count"))


def query_frequency(log: DataFrame, query_col: str) -> DataFrame:
    """Rows (query, n) of normalised queries."""
    return log.select(normalised_query(F.col(query_col)).alias("query")).filter("query <> ''").groupBy("query").agg(F.count("*").alias("n"))


def suggestions(ngrams: DataFrame, frequency: DataFrame, prefix: str, k: int = 10, least_count: int = 2) -> DataFrame:
    """The k best completions (text, score, source) of a prefix: n-grams, then logged queries, then popular ones for short prefixes.

    A text that several sources give comes once, with its best score.
    """
    p = " ".join("".join(c for c in prefix.lower() if c.isalnum() or c.isspace()).split())
    if not p:
        return ngrams.limit(0).select(F.col("ngram").alias("text"), F.lit(0.0).alias("score"), F.lit("").alias("source"))
    grams = ngrams.filter(F.col("ngram").startswith(p) & (F.col("count") >= least_count) & F.lit(len(p) >= 2))
    a = grams.select(F.col("ngram").alias("text"), (1.5 * F.log("count") + 0.1 * (MAX_NGRAM - F.col("ngram_len"))).alias("score"), F.lit("ngram").alias("source"))
    b = frequency.filter(F.col("query").startswith(p)).select(F.col("query").alias("text"), (0.8 * F.log("n")).alias("score"), F.lit("log").alias("source"))
    rows = a.unionByName(b)
    if len(p) <= 3:
        rows = rows.unionByName(frequency.select(F.col("query").alias("text"), (0.5 * F.log("n")).alias("score"), F.lit("popular").alias("source")))
    best = rows.groupBy("text").agg(F.max(F.struct("score", "source")).alias("m")).select("text", F.col("m.score").alias("score"), F.col("m.source").alias("source"))
    return best.orderBy(F.round("score", 9).desc(), "text").limit(k)


def top_categories(rows: DataFrame, category_col: str, k: int) -> DataFrame:
    """The k most frequent non-empty categories (category, n), by name where equal."""
    some = rows.filter(F.coalesce(F.trim(category_col), F.lit("")) != "")
    return some.groupBy(F.col(category_col).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def recrawl_due(history: DataFrame, as_of: Column, policy: str = "adaptive", days: int = 7, last_col: str = "last_fetched", count_col: str = "fetches") -> DataFrame:
    """`history` with interval_days and due: never, every `days`, or 1 day doubling with each fetch up to 16."""
    adaptive = F.when(F.col(count_col) <= 1, F.lit(1)).otherwise(F.least(F.pow(F.lit(2), F.least(F.col(count_col) - 1, F.lit(4))), F.lit(30)).cast("int"))
    interval = {"never": F.lit(None).cast("int"), "fixed": F.lit(days), "adaptive": adaptive}[policy]
    age = F.unix_timestamp(as_of) - F.unix_timestamp(last_col)
    due = F.lit(False) if policy == "never" else F.col(last_col).isNull() | (age > interval * 86400)
    return history.withColumn("interval_days", interval).withColumn("due", due)


def storage_size(pages: DataFrame, *columns: str) -> DataFrame:
    """One row (bytes, pages)."""
    total = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns), F.lit(0).cast("long"))
    return pages.agg(total.alias("bytes"), F.count("*").alias("pages"))


def eviction(pages: DataFrame, budget: int, id_col: str, time_col: str, *columns: str) -> DataFrame:
    """`pages` (id, bytes, evict): the oldest pages whose texts must go for the rest to keep within `budget` bytes.

    Running sums go over time buckets first, so that no task sorts the whole table.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
    rows = pages.select(F.col(id_col).alias("id"), F.col(time_col).alias("at"), size.alias("bytes")).withColumn("day", F.to_date("at"))
    daily = rows.groupBy("day").agg(F.sum("bytes").alias("day_bytes"))
    newer = daily.withColumn("after", F.coalesce(F.sum("day_bytes").over(Window.orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("day").orderBy(F.col("at").desc_nulls_last(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.join(newer.select(F.col("day").alias("d"), "after"), F.col("day").eqNullSafe(F.col("d")))
    return kept.withColumn("kept", F.col("after") + F.sum("bytes").over(within)).select("id", "bytes", (F.col("kept") > budget).alias("evict"))


def index_age(nodes: DataFrame, as_of: Column, time_col: str = "discovered_at") -> DataFrame:
    """One row (newest_days, oldest_days, mean_days), to one decimal."""
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(time_col)) / 86400.0
    return nodes.agg(F.round(F.min(days), 1).alias("newest_days"), F.round(F.max(days), 1).alias("oldest_days"), F.round(F.avg(days), 1).alias("mean_days"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_first: dict[str, str] | None = None) -> DataFrame:
    """`old` with the rows of `new` put over those of equal key: the latest by `order` wins, `keep_first` columns (all named alike) keep their least value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_new")]
    last = F.max_by(F.struct(*columns), F.struct("_new", order)).alias("_last")
    first = [F.min(c).alias(f"_first_{c}") for c in (keep_first or {})]
    merged = both.groupBy(key).agg(last, *first)
    return merged.select(key, *[(F.col(f"_first_{c}") if c in (keep_first or {}) else F.col(f"_last.{c}")).alias(c) for c in columns])


def with_endpoints(nodes: DataFrame, edges: DataFrame, id_col: str, ends: tuple[str, str]) -> DataFrame:
    """`nodes` and a placeholder row for each end of an edge that has none."""
    every = edges.select(F.col(ends[0]).alias(id_col)).unionByName(edges.select(F.col(ends[1]).alias(id_col))).filter(F.col(id_col).isNotNull()).distinct()
    return nodes.unionByName(every.join(nodes, id_col, "left_anti"), allowMissingColumns=True)


def health(events: DataFrame, key_col: str, ok: Column, time_col: str) -> DataFrame:
    """Rows (key, successes, failures, last_at, last_ok)."""
    return events.withColumn("_ok", ok).groupBy(F.col(key_col).alias("key")).agg(
        F.count_if("_ok").alias("successes"), F.count_if(~F.col("_ok")).alias("failures"), F.max(time_col).alias("last_at"), F.max_by("_ok", F.struct(time_col, "_ok")).alias("last_ok")
    )
