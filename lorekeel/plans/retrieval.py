"""Queries of lexical and vector search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readability as R
from ..functions import text as T
from ..functions import urls as U
from ..operators import fusion, lexical, rank, vector
from ..operators.router import route
from ..runtime import table, texts
from .registry import query

AS_OF = "2026-01-01 00:00:00"
QUERIES = [(1, "museum catalogue interest rates"), (2, "winter timetable harbour authority"), (3, "lesson plans of the library portal"), (4, "bibliothèque horaire hiver")]
_Q = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def _bm25_sql(having: str = "") -> str:
    return f"""
q(query_id, query) AS (VALUES {_Q}),
qt0 AS (SELECT query_id, list_distinct({TOKENS.format("query")}) AS ts FROM q),
qt AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term FROM qt0),
d AS (SELECT doc_id, {TOKENS.format("text")} AS ts FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean_length FROM d),
e AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qt.query_id, p.doc_id AS id, n_terms, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score, count(*) AS matched
  FROM p JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY ALL {having}),
b AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""


@query(f"WITH {_bm25_sql()} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 20")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.top(lexical.bm25(texts(spark, folder, "documents"), asked(spark), "doc_id", "text"), 20)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql('HAVING count(*) = n_terms')} SELECT query_id, id AS doc_id, round(score, 6) AS score FROM s")
def bm25_and_match(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.bm25(texts(spark, folder, "documents"), asked(spark), "doc_id", "text", all_words=True)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""
WITH q(query_id, query) AS (VALUES {_Q}),
qt AS (SELECT query_id, unnest(list_distinct({TOKENS.format("query")})) AS term FROM q),
d AS (SELECT doc_id, 5.0 AS field, {TOKENS.format("title")} AS ts FROM documents UNION ALL SELECT doc_id, 1.0, {TOKENS.format("text")} FROM documents),
st AS (SELECT field, count(*) AS n_docs, avg(len(ts)) AS mean_length FROM d GROUP BY field),
e AS (SELECT doc_id, field, len(ts) AS length, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, field, length, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, sum(field * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM p JOIN df USING (term) JOIN qt USING (term) JOIN st USING (field) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 20""")
def bm25f_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.top(lexical.bm25f(texts(spark, folder, "documents"), asked(spark), "doc_id", "title", "text"), 20)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH d AS (SELECT doc_id, {TOKENS.format("text")} AS ts FROM documents),
t AS (SELECT doc_id, unnest(ts) AS term FROM d), df AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term)
SELECT term, df, cf, round(ln(((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df""")
def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents")
    counted = lexical.postings(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    out = counted.crossJoin(F.broadcast(lexical.corpus_statistics(docs, "text")))
    return out.select("term", "df", "cf", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents) SELECT doc_id, len(ts)::INT AS n_tokens, len(list_distinct(ts))::INT AS n_distinct FROM d")
def tokens_stats(spark: SparkSession, folder: str) -> DataFrame:
    parts = texts(spark, folder, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return parts.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"))


@query(f"""
WITH t AS (SELECT unnest({TOKENS.format("text")}) AS word FROM documents)
SELECT word, count(*) AS n FROM t WHERE length(word) >= 3 AND word NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def top_words(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.top_words(texts(spark, folder, "documents"), "text", 50)


@query(f"""
WITH d AS (SELECT doc_id, {TOKENS.format("text")} AS ts FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean_length FROM d),
e AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM d), p AS (SELECT doc_id, length, term, count(*) AS tf FROM e GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, count(*)::INT AS n_terms, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 4) AS mass
FROM p JOIN df USING (term) CROSS JOIN st GROUP BY doc_id""")
def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.sparse_vectors(texts(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.size("weights").alias("n_terms"), F.round(F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x), 4).alias("mass"))


@query()
def rake_keywords(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.rake(texts(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "phrase", F.round("score", 6).alias("score"), "rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[]) > 0
  THEN list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) ELSE 0 END AS similarity
  FROM embeddings CROSS JOIN q WHERE len(embedding) = len(q) AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(similarity, 5) AS similarity, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten most similar vectors of each twentieth vector, against all vectors."""
    vectors = table(spark, folder, "embeddings")
    asked_ = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vector.top_similar(vectors, asked_, 10, "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    found = texts(spark, folder, "documents").select("doc_id", R.hash_embedding("text").alias("v"))
    return found.select("doc_id", F.size("v").alias("dims"), F.round(vector.norm(F.col("v")), 4).alias("norm"))


#: Three ranked lists of page URLs: by crawl priority, by recency, by depth.
_LISTS_SQL = """
n AS (SELECT id, min(url) AS url, min(domain) AS domain, max(priority) AS priority, max(discovered_at) AS seen, min(depth) AS depth, max(excerpt) AS excerpt FROM url_nodes GROUP BY id),
h AS (
  SELECT 1 AS query_id, 0 AS list_no, 'priority' AS engine, row_number() OVER (ORDER BY priority DESC, url, id) AS rank, 1.0 AS weight, url FROM n
  UNION ALL SELECT 1, 1, 'recency', row_number() OVER (ORDER BY seen DESC, url, id), 2.0, url FROM n
  UNION ALL SELECT 1, 2, 'depth', row_number() OVER (ORDER BY depth, url, id), 0.5, url FROM n),
hits AS (SELECT * FROM h WHERE rank <= 200),
host AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p,
  array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','mc_cid','mc_eid'], lower(split_part(x, '=', 1)))), '&') AS kq FROM hits),
keyed AS (SELECT *, origin || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN kq <> '' THEN '?' || kq ELSE '' END AS ck FROM host),
fused AS (SELECT query_id, ck, sum(weight / (60 + rank)) AS score, count(*) AS engine_count, arg_min(url, list_no * 1000000 + rank) AS url FROM keyed GROUP BY query_id, ck)"""


def ranked_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of three lists over all nodes, the first 200 of each (the lists' length is the feature of a ranked list)."""
    nodes = table(spark, folder, "url_nodes").groupBy("id").agg(F.min("url").alias("url"), F.max("priority").alias("priority"), F.max("discovered_at").alias("seen"), F.min("depth").alias("depth"))
    out = None
    for no, (engine, weight, order) in enumerate((("priority", 1.0, F.desc("priority")), ("recency", 2.0, F.desc("seen")), ("depth", 0.5, F.asc("depth")))):
        best = nodes.orderBy(order, "url", "id").limit(200)
        part = best.groupBy().agg(F.collect_list(F.struct("url", "id", "priority", "seen", "depth")).alias("l"))
        key = {"priority": lambda x: (-x["priority"]), "recency": lambda x: (-F.unix_micros(x["seen"])), "depth": lambda x: x["depth"]}[engine]
        listed = part.select(F.posexplode(F.array_sort(F.transform("l", lambda x: F.struct(key(x).alias("o"), x["url"].alias("url"), x["id"].alias("id"))))).alias("p", "x"))  # noqa: B023
        rows = listed.select(F.lit(1).alias("query_id"), F.lit(no).alias("list_no"), F.lit(engine).alias("engine"), (F.col("p") + 1).alias("rank"), F.lit(weight).alias("weight"), F.col("x.url").alias("url"), U.title_from_url(F.col("x.url")).alias("title"), F.lit("").alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_LISTS_SQL} SELECT url, round(score, 8) AS score, engine_count FROM fused")
def rrf_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(ranked_lists(spark, folder)).select("url", F.round("score", 8).alias("score"), "engine_count")


@query(f"WITH {_LISTS_SQL} SELECT url, round(0.4 + 0.6 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM fused")
def rrf_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.normalised(fusion.reciprocal_rank_fusion(ranked_lists(spark, folder))).select("url", F.round("score", 6).alias("score"))


@query(f"""
WITH {_LISTS_SQL},
g AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS d, split_part(ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '/', 1) AS seg FROM fused),
gk AS (SELECT d, CASE WHEN seg = '' THEN d ELSE d || '/' || seg END AS grp, seg = '' AS home, sum(score) AS score, sum(engine_count) AS n FROM g GROUP BY ALL),
t AS (SELECT *, CASE WHEN home THEN first_value(grp) OVER (PARTITION BY d ORDER BY home, score DESC, grp) ELSE grp END AS target FROM gk)
SELECT target AS concept, round(sum(score), 8) AS score, sum(n)::BIGINT AS engine_count FROM t GROUP BY target""")
def aggregate_concepts(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.aggregate_concepts(fusion.reciprocal_rank_fusion(ranked_lists(spark, folder)))
    return found.select("concept", F.round("score", 8).alias("score"), "engine_count")


@query(f"""
WITH {_bm25_sql()}, hits AS (SELECT b.query_id, b.rank, b.id, coalesce(title, '') AS title, query FROM b JOIN documents ON b.id = doc_id JOIN q USING (query_id) WHERE rank <= 50),
k AS (SELECT *, list_filter(string_split(lower(query), ' '), lambda w: w NOT IN ('of', 'the')) AS terms, lower(title || ' ') AS hay FROM hits),
m AS (SELECT *, list_sum(list_transform(terms, lambda t: CASE WHEN contains(hay, t) THEN 1 ELSE 0 END)) AS hit FROM k)
SELECT query_id, id AS doc_id, round(1.0 / (60 + rank) * (1 + 0.25 * hit / len(terms)), 8) AS score FROM m""")
def rblf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks biased by the share of keywords that a title holds."""
    docs = texts(spark, folder, "documents")
    best = lexical.top(lexical.bm25(docs, asked(spark), "doc_id", "text"), 50)
    rows = best.join(docs.select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title")), "id").join(F.broadcast(asked(spark)), "query_id")
    hits = rows.select("query_id", F.lit(0).alias("list_no"), F.lit("bm25").alias("engine"), "rank", F.lit(1.0).alias("weight"), F.col("id").cast("string").alias("url"), "title", F.lit("").alias("snippet"), T.keywords(F.col("query")).alias("terms"))
    found = fusion.reciprocal_rank_fusion(hits, key=F.col("url"), terms=F.col("terms"))
    return found.select("query_id", F.col("url").cast("long").alias("doc_id"), F.round("score", 8).alias("score"))


@query(f"""
WITH {_bm25_sql()}, lex AS (SELECT query_id, id, rank FROM b WHERE rank <= 50),
qv AS (SELECT query_id, embedding AS v FROM q JOIN embeddings ON vec_id = query_id),
vs AS (SELECT query_id, vec_id AS id, list_dot_product(e.embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS s FROM embeddings e CROSS JOIN qv),
vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM vs QUALIFY rank <= 50),
u AS (SELECT query_id, id, rank, 'bm25' AS signal FROM lex UNION ALL SELECT query_id, id, rank, 'vector' FROM vec),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, array_to_string(list_sort(list(signal)), ',') AS signals FROM u GROUP BY query_id, id),
fr AS (SELECT doc_id AS id FROM documents WHERE fetched_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00')
SELECT query_id, id AS doc_id, round(score + CASE WHEN id IN (SELECT id FROM fr) THEN 0.03 ELSE 0 END, 8) AS score, signals || CASE WHEN id IN (SELECT id FROM fr) THEN ',freshness' ELSE '' END AS signals FROM f""")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, vectors = texts(spark, folder, "documents"), table(spark, folder, "embeddings")
    lex = lexical.top(lexical.bm25(docs, asked(spark), "doc_id", "text"), 50)
    near = asked(spark).join(vectors, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"))
    vec = vector.top_similar(vectors, near, 50, "vec_id", "embedding")
    fresh = docs.filter("fetched_at >= timestamp '2025-01-01 00:00:00'").select(F.col("doc_id").alias("id"))
    found = fusion.hybrid(lex, vec, freshness=fresh)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 8).alias("score"), F.array_join("signals", ",").alias("signals"))


@query(f"""
WITH {_LISTS_SQL.replace("SELECT * FROM h WHERE rank <= 200", "SELECT query_id, CASE WHEN engine = 'recency' THEN 1 ELSE 0 END AS list_no, engine, rank, CASE WHEN engine = 'recency' THEN 3.0 ELSE 1.0 END AS weight, url FROM h WHERE rank <= 200 AND engine <> 'depth'")},
o AS (SELECT ck, max(list_no = 0) AS stored FROM keyed GROUP BY ck),
g AS (SELECT url, engine_count, stored, score * CASE WHEN stored THEN 1.0 ELSE 1.1 END AS score FROM fused JOIN o USING (ck))
SELECT url, engine_count, stored::INT AS stored, round(0.4 + 0.6 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM g""")
def store_live_fusion(spark: SparkSession, folder: str) -> DataFrame:
    lists = ranked_lists(spark, folder).withColumn("engine_count", F.lit(1))
    found = fusion.store_live_fusion(lists.filter("engine = 'priority'"), lists.filter("engine = 'recency'"))
    return found.select("url", "engine_count", "stored", F.round("score", 6).alias("score"))


@query("""
WITH j AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS engine, count(*) FILTER (WHERE lower(status) = 'done') AS hits, avg(epoch(updated_at) - epoch(created_at)) AS ms FROM crawl_jobs GROUP BY ALL)
SELECT engine, round(greatest(0.5, least(1.0, (CASE WHEN hits = 0 THEN 0.5 ELSE 0.5 + 0.5 * least(hits, 4) / 4.0 END) * greatest(0.7, least(1.0, 1 - 0.3 * ms / 12000.0)))), 6) AS weight FROM j""")
def engine_reliability(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "crawl_jobs").groupBy(U.domain(F.col("url")).alias("engine"))
    delay = F.unix_micros("updated_at") / 1e6 - F.unix_micros("created_at") / 1e6
    found = jobs.agg(F.count_if(F.lower("status") == "done").alias("hits"), F.avg(delay).alias("ms"))
    return found.select("engine", F.round(fusion.reliability(F.col("hits"), F.col("ms")), 6).alias("weight"))


_TIER_SQL = """CASE WHEN h IN ('raw.githubusercontent.com', 'gist.githubusercontent.com') THEN 'raw_source' WHEN suffix IN ('gov','edu','mil','int','gov.uk','gov.au','ac.uk','edu.au') THEN 'primary_official'
 WHEN root IN ('wikipedia.org','wikimedia.org','britannica.com') THEN 'encyclopedia' WHEN root IN ('reddit.com','stackoverflow.com','stackexchange.com','quora.com') THEN 'community'
 WHEN root IN ('rust-lang.org','docs.rs','python.org','go.dev') THEN 'primary_official' WHEN suffix = 'org' THEN 'reference' ELSE 'unknown' END"""
_SOURCES = ["https://raw.githubusercontent.com/a/b", "https://www.nasa.gov/x", "https://en.wikipedia.org/wiki/A", "https://old.reddit.com/r/x", "https://docs.rs/tokio", "https://doc.rust-lang.org/std", "https://example.org/p", "https://cam.ac.uk/q", "https://shop.example.com/"]
_S = ", ".join(f"('{u}')" for u in _SOURCES)


@query(f"""
WITH u AS (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL UNION SELECT * FROM (VALUES {_S})),
h AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM u),
s AS (SELECT *, string_split(h, '.') AS p FROM h),
t AS (SELECT *, array_to_string(p[-2:], '.') AS two FROM s),
r AS (SELECT *, CASE WHEN two IN ('gov.uk','ac.uk','co.uk','org.uk','gov.au','edu.au','com.au','org.au','co.jp','co.nz','com.br') THEN array_to_string(p[-3:], '.') ELSE two END AS root,
 CASE WHEN two IN ('gov.uk','ac.uk','co.uk','org.uk','gov.au','edu.au','com.au','org.au','co.jp','co.nz','com.br') THEN two ELSE p[-1] END AS suffix FROM t),
c AS (SELECT url, {_TIER_SQL} AS tier FROM r)
SELECT url, tier, CASE tier WHEN 'raw_source' THEN 0.95 WHEN 'primary_official' THEN 1.0 WHEN 'reference' THEN 0.7 WHEN 'encyclopedia' THEN 0.55 WHEN 'community' THEN 0.45 ELSE 0.6 END::DOUBLE AS precision FROM c""")
def source_tier(spark: SparkSession, folder: str) -> DataFrame:
    urls = texts(spark, folder, "documents").select("url").filter("url is not null").union(spark.createDataFrame([(u,) for u in _SOURCES], "url string")).distinct()
    found = urls.select("url", rank.source_tier(F.col("url")).alias("tier"))
    return found.select("url", "tier", rank.precision(F.col("tier")).alias("precision"))


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate a document and query: BM25, freshness, quality from length, authority from tier, vector from the embedding of its id."""
    docs = texts(spark, folder, "documents")
    best = lexical.top(lexical.bm25(docs, asked(spark), "doc_id", "text"), 150)
    best = best.withColumn("bm25", fusion.min_max(F.col("score"), ["query_id"]))
    attributes = docs.select(F.col("doc_id").alias("id"), F.coalesce("domain", F.lit("")).alias("domain"), "fetched_at", "source_tier", F.least(F.lit(1.0), F.length("text") / 2000.0).alias("quality"))
    rows = best.join(attributes, "id")
    fresh = F.coalesce(rank.freshness(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp")), F.lit(0.0))
    authority = F.when(F.col("source_tier") == "official", 1.0).when(F.col("source_tier") == "reference", 0.7).otherwise(0.4)
    return rows.select("query_id", F.format_string("%010d", F.col("id").cast("long")).alias("url"), "domain", "bm25", fresh.alias("freshness"), "quality", F.lit(None).cast("double").alias("graph"), F.lit(None).cast("double").alias("vector"), authority.alias("authority"), F.when(F.col("source_tier") == "raw", 0.25).alias("machine"), (F.col("source_tier") == "raw").alias("has_example"))


_SIGNALS_SQL = f"""
{_bm25_sql()}, c0 AS (SELECT * FROM b WHERE rank <= 150),
c1 AS (SELECT query_id, id, CASE WHEN max(score) OVER w - min(score) OVER w < 2.220446049250313e-16 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS bm25 FROM c0 WINDOW w AS (PARTITION BY query_id)),
c2 AS (SELECT query_id, printf('%010d', id) AS url, coalesce(domain, '') AS domain, bm25, CASE WHEN fetched_at IS NULL THEN 0.0 ELSE exp(-greatest(floor((epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(fetched_at))) / 86400), 0) / 180.0) END AS freshness, least(1.0, length(text) / 2000.0) AS quality,
  CASE source_tier WHEN 'official' THEN 1.0 WHEN 'reference' THEN 0.7 ELSE 0.4 END AS authority, CASE WHEN source_tier = 'raw' THEN 0.25 END AS machine, coalesce(source_tier = 'raw', false) AS has_example FROM c1 JOIN documents ON doc_id = id),
c3 AS (SELECT *, greatest(0.001, least(1.0, (CASE WHEN has_example THEN 0.05 ELSE 0 END + 0.5 * bm25 + 0.15 * freshness + 0.1 * coalesce(quality, 0) + 0.1 * authority + 0.2 * coalesce(machine, 0)) / (0.75 + CASE WHEN quality IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN machine IS NOT NULL THEN 0.2 ELSE 0 END))) AS s0,
  0.4 + 0.2 * coalesce(quality, 0.5) + 0.15 * bm25 + 0.1 * freshness + CASE WHEN has_example THEN 0.05 ELSE 0 END AS fs, coalesce(quality, 0.5) >= 0.45 AS passed, row_number() OVER (PARTITION BY query_id ORDER BY url) > 128 AS late FROM c2),
c4 AS (SELECT *, s0 * pow(0.85, row_number() OVER (PARTITION BY query_id, domain ORDER BY late, passed DESC, round(fs, 9) DESC, url) - 1) AS score FROM c3),
c5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, url) AS rank FROM c4)"""


@query(f"WITH {_SIGNALS_SQL} SELECT query_id, url, round(score, 6) AS score, CASE WHEN passed THEN 'high' ELSE 'marginal' END AS tier, rank FROM c5")
def rank_final(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank.rank(_signals(spark, folder), use_vector=False)
    return ranked.select("query_id", "url", F.round("score", 6).alias("score"), "tier", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SIGNALS_SQL} SELECT query_id, domain, count(*) AS n, round(sum(s0), 5) AS before, round(sum(score), 5) AS after FROM c5 GROUP BY ALL")
def diversity_penalty(spark: SparkSession, folder: str) -> DataFrame:
    signals = _signals(spark, folder)
    ranked = rank.rank(signals, use_vector=False)
    names = ["bm25", "freshness", "quality", "graph", "authority", "machine"]
    plain = rank.final_score(False, F.col("has_example"), **{n: F.col(n) for n in names})
    return ranked.withColumn("plain", plain).groupBy("query_id", "domain").agg(F.count("*").alias("n"), F.round(F.sum("plain"), 5).alias("before"), F.round(F.sum("score"), 5).alias("after"))


@query(f"""
WITH n AS (SELECT id, min(domain) AS domain FROM url_nodes GROUP BY id), i AS (SELECT target_id AS id, count(*) AS c FROM link_edges GROUP BY ALL),
g AS (SELECT lower(domain) AS domain, max(coalesce(1 / (60 + 100.0 / c), 0)) AS g FROM n LEFT JOIN i USING (id) GROUP BY ALL)
SELECT domain, round(least(1.0, g + CASE WHEN domain LIKE '%.gov' THEN 0.35 WHEN domain LIKE '%.edu' THEN 0.3 WHEN domain LIKE '%.org' THEN 0.08 ELSE 0 END), 6) AS authority FROM g""")
def domain_authority(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators import graph

    nodes = table(spark, folder, "url_nodes").groupBy("id").agg(F.min("domain").alias("domain"))
    into = table(spark, folder, "link_edges").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("c"))
    rows = nodes.join(into, "id", "left").select(F.lower("domain").alias("domain"), graph.in_degree_signal(F.col("c")).alias("graph"))
    return rank.domain_authority(rows).select("domain", F.round("authority", 6).alias("authority"))


@query(f"""
WITH n AS (SELECT id, max(discovered_at) AS seen FROM url_nodes GROUP BY id)
SELECT id, greatest(floor((epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(seen))) / 86400), 0)::BIGINT AS days, round(exp(-greatest(floor((epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(seen))) / 86400), 0) / 180.0), 6) AS freshness,
 round(pow(0.5, greatest(floor((epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(seen))) / 86400), 0) / 180.0), 6) AS half_life FROM n""")
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "url_nodes").groupBy("id").agg(F.max("discovered_at").alias("seen"))
    now = F.lit(AS_OF).cast("timestamp")
    return nodes.select("id", rank.age_days(F.col("seen"), now).alias("days"), F.round(rank.freshness(F.col("seen"), now), 6).alias("freshness"), F.round(rank.freshness(F.col("seen"), now, mode="half_life"), 6).alias("half_life"))


@query("""
WITH r AS (SELECT id, max(content_markdown IS NOT NULL) AS markdown, max(contains(coalesce(content_html, ''), '<script')) AS structured, max(contains(coalesce(content_text, ''), '|')) AS pipe FROM page_content GROUP BY id)
SELECT id, CASE WHEN markdown OR pipe OR structured THEN round(CASE WHEN markdown OR pipe THEN 0.25 ELSE 0.0 END + CASE WHEN structured THEN 0.2 ELSE 0.0 END, 6) END::DOUBLE AS score FROM r""")
def machine_readability(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "page_content").groupBy("id").agg(
        F.max(F.col("content_markdown").isNotNull()).alias("markdown"), F.max(F.coalesce(F.col("content_html"), F.lit("")).contains("<script")).alias("structured"), F.max(F.coalesce(F.col("content_text"), F.lit("")).contains("|")).alias("pipe")
    )
    return rows.select("id", F.round(rank.machine_readability(F.lit(False), F.col("markdown") | F.col("pipe"), F.lit(False), F.col("structured")), 6).alias("score"))


_KEYWORDS_SQL = f"list_distinct_ordered(list_filter(list_transform(list_filter(regexp_split_to_array(lower({{0}}), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^a-z0-9à-öø-ÿ]+|[^a-z0-9à-öø-ÿ]+$', '', 'g')), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in T.STOP_WORDS + T.MODIFIERS)}], w) AND NOT regexp_matches(w, '^(19[0-9]{{{{2}}}}|20[0-9]{{{{2}}}}|2100)$')))"


_KEYWORD_ROWS = (
    "k AS (SELECT item_id, "
    + _KEYWORDS_SQL.format("text").replace("list_distinct_ordered(", "(").replace("{{", "{").replace("}}", "}")
    + " AS ks FROM eval_items), u AS (SELECT item_id, unnest(ks) AS k, unnest(range(len(ks))) AS n FROM k), f AS (SELECT item_id, k, min(n) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n) AS p FROM f)"
)


@query(f"WITH {_KEYWORD_ROWS} SELECT item_id, string_agg(k, ' ' ORDER BY n) AS keywords FROM r WHERE p <= 6 GROUP BY item_id")
def keyword_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "eval_items").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))
    return found.filter("keywords <> ''")


@query(f"""
WITH {_KEYWORD_ROWS}, q AS (SELECT item_id AS query_id, string_agg(k, ' ' ORDER BY n) AS query FROM r WHERE p <= 6 GROUP BY item_id),
qt AS (SELECT query_id, unnest(list_distinct({TOKENS.format("query")})) AS term FROM q),
d AS (SELECT doc_id, {TOKENS.format("text")} AS ts FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean_length FROM d),
e AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM d),
p2 AS (SELECT doc_id, length, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p2 GROUP BY term),
s AS (SELECT query_id, doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score FROM p2 JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10""")
def search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for the keywords of every evaluation item, all queries in one job."""
    queries = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.array_join(T.keywords(F.col("text")), " ").alias("query"))
    found = lexical.top(lexical.bm25(texts(spark, folder, "documents"), queries, "doc_id", "text"), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""
SELECT doc_id, (CASE WHEN contains(h, 'museum') THEN 1 ELSE 0 END + CASE WHEN contains(h, 'cve-2024-3094') THEN 2 ELSE 0 END + CASE WHEN contains(h, 'timetable') THEN 1 ELSE 0 END)::INT AS matches
FROM (SELECT doc_id, lower(concat_ws(' ', title, text)) AS h FROM documents)""")
def keyword_matches(spark: SparkSession, folder: str) -> DataFrame:
    terms = F.array(F.lit("museum"), F.lit("cve-2024-3094"), F.lit("timetable"))
    return texts(spark, folder, "documents").select("doc_id", T.keyword_matches(terms, F.col("title"), F.col("text")).alias("matches"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', title, text)), 'tide tables') AND contains(lower(concat_ws(' ', title, text)), 'local paper')")
def phrase_filter(spark: SparkSession, folder: str) -> DataFrame:
    phrases = T.quoted_terms(F.lit('about "tide tables" and “Local Paper”'))
    return texts(spark, folder, "documents").filter(T.has_phrases(phrases, F.col("title"), F.col("text"))).select("doc_id")


@query("""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM eval_items)
SELECT item_id, array_to_string(ws[1:greatest(1, len(ws) - 2)], ' ') AS relaxed FROM w""")
def query_relaxation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", T.relaxed(F.col("text"), 2).alias("relaxed"))


def _case(table_: dict[str, list[str]], default: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in table_.items())
    return f"CASE {arms} ELSE '{default}' END"


def _route_sql() -> str:
    from ..operators import router as Z

    has = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
    tests = ["regexp_matches(q, 'cve-[0-9]{4}-[0-9]{4,}|ghsa-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}')", "regexp_matches(q, '(^|[^a-z0-9])e0[0-9]{3}([^a-z0-9]|$)')", has(Z.CODE_WORDS), has(Z.API_WORDS), has(Z.SPEC_WORDS)]
    pick = lambda values, other: "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values, strict=True)) + f" ELSE {other} END"
    language = _case(Z.LANGUAGES, "en")
    return (
        f"SELECT id, {pick(["'vulnerability'", "'rust_error'", "'code_explanation'", "'api_docs'", "'specification'"], "'general'")} AS intent, "
        f"{pick(["'security'", "'rust'", "'programming'", "'programming'", "'technical'"], _case(Z.DOMAINS, 'general'))} AS domain, {pick(["'en'", "'en'", language, "'en'", "'en'"], language)} AS language, "
        f"{pick(['0.99', '0.95', '0.85', '0.8', '0.8'], '0.7')}::DOUBLE AS confidence FROM (SELECT doc_id AS id, lower(trim(title)) AS q FROM documents WHERE title IS NOT NULL UNION ALL SELECT -item_id, lower(trim(text)) FROM eval_items)"
    )


@query(_route_sql())
def route_query(spark: SparkSession, folder: str) -> DataFrame:
    titled = texts(spark, folder, "documents").filter("title is not null").select(F.col("doc_id").alias("id"), F.col("title").alias("q")).unionByName(table(spark, folder, "eval_items").select((-F.col("item_id")).alias("id"), F.col("text").alias("q")))
    routed = titled.select("id", route(F.col("q")).alias("r"))
    return routed.select("id", "r.intent", "r.domain", "r.language", "r.confidence")


@query("""
WITH o AS (SELECT id, content_text, excerpt FROM page_content)
SELECT id, count(*) AS n, max(CASE WHEN coalesce(excerpt, '') <> '' THEN excerpt WHEN coalesce(content_text, '') <> '' THEN substring(content_text, 1, 200) || '…' ELSE id END) AS snippet FROM o GROUP BY id""")
def repaired_snippets(spark: SparkSession, folder: str) -> DataFrame:
    fixed = rank.repaired_snippet(F.lit(""), F.col("excerpt"), F.col("content_text"), F.col("id"))
    return texts(spark, folder, "page_content").groupBy("id").agg(F.count("*").alias("n"), F.max(fixed).alias("snippet"))


@query("""
WITH r AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY url) AS p, count(*) OVER (PARTITION BY domain) AS n FROM documents WHERE domain IS NOT NULL AND url IS NOT NULL)
SELECT domain, url, round(1 - (p - 1) / n::DOUBLE, 6) AS relevance FROM r""")
def positional_relevance(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("domain")
    rows = texts(spark, folder, "documents").filter("domain is not null and url is not null")
    rows = rows.withColumn("p", F.row_number().over(w.orderBy("url"))).withColumn("n", F.count("*").over(w))
    return rows.select("domain", "url", F.round(fusion.positional_relevance(F.col("p"), F.col("n")), 6).alias("relevance"))
