"""Queries of corpus hygiene: sizes, gates, entities, SimHash, canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import readability as R
from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup
from ..runtime import cut, table, texts
from .registry import query

_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_WORDS.format('text')})::INT AS words, ceil(len({_WORDS.format('text')}) / 238.0 * 60)::BIGINT AS seconds, strlen(coalesce(text, ''))::INT AS bytes, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def text_sizes(spark: SparkSession, folder: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return texts(spark, folder, "documents").select("doc_id", n.alias("words"), T.reading_seconds(n).alias("seconds"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id FROM documents WHERE len({_WORDS.format('text')}) >= 300")
def thin_gate(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "documents").filter(T.word_count(F.col("text")) >= T.INDEX_WORDS).select("doc_id")


@query(f"""
WITH r AS (SELECT id, max(content_text) AS t FROM page_content GROUP BY id)
SELECT id, CASE WHEN len({_WORDS.format("t")}) < 5 THEN 'empty' WHEN coalesce(regexp_matches(lower(t), '{"|".join(T.UNSAFE_TERMS)}'), false) THEN 'unsafe' WHEN len({_WORDS.format("t")}) < 300 THEN 'thin' ELSE 'passed' END AS status FROM r""")
def gate_chain(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "page_content").groupBy("id").agg(F.max("content_text").alias("t"))
    return dedup.gates(rows, "t").select("id", "status")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t, length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) / greatest(length(t), 1)::DOUBLE AS letters, len(regexp_extract_all(t, '\\{[^{}]*:[^{}]*;?[^{}]*\\}')) AS css, len(regexp_extract_all(t, '\\bfunction\\b|=>|\\bvar |\\blet |\\bconst |===|document\\.|window\\.|\\);')) AS js FROM d)
SELECT doc_id, round(letters, 6) AS letters, js >= 3 AS javascript, (css >= 2 OR (css >= 1 AND regexp_matches(t, '@media|!important|font-family|margin:|padding:'))) AS css FROM f""")
def prose_flags(spark: SparkSession, folder: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return texts(spark, folder, "documents").select("doc_id", F.round(T.letter_share(t), 6).alias("letters"), T.looks_like_javascript(t).alias("javascript"), T.looks_like_css(t).alias("css"))


def _cut_sql() -> str:
    places = ", ".join(f"CASE WHEN instr(lower(t), '{p}') > 1 THEN instr(lower(t), '{p}') ELSE 1000000000 END" for p in T.AFTER_ARTICLE)
    return f"WITH r AS (SELECT id, max(content_text) AS t FROM page_content GROUP BY id), c AS (SELECT id, t, least({places}) AS pos FROM r) SELECT id, trim(CASE WHEN pos < 1000000000 THEN substring(t, 1, pos - 1) ELSE t END) AS kept FROM c"


@query(_cut_sql())
def boilerplate_cut(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "page_content").groupBy("id").agg(F.max("content_text").alias("t"))
    return rows.select("id", T.boilerplate_cut(F.col("t")).alias("kept"))


@query()
def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "documents").filter("text is not null").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query()
def visible_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "page_content").filter("content_html is not null").groupBy("id").agg(F.max("content_html").alias("h"))
    return rows.select("id", T.visible_text(F.col("h")).alias("text"), F.round(T.content_density(F.col("h")), 6).alias("density"))


def _entity_sql(slot: str) -> str:
    pattern = E.PATTERNS[slot].replace("'", "''")
    return f"""
WITH e AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS xs FROM documents),
u AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS n FROM e), k AS (SELECT doc_id, arg_min(x, n) AS x, min(n) AS n FROM u GROUP BY doc_id, lower(x))
SELECT doc_id, string_agg(x, ' | ' ORDER BY n) AS found FROM k GROUP BY doc_id"""


def _entity_query(slot: str) -> None:
    @query(_entity_sql(slot), name=f"entities_{slot}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = texts(spark, folder, "documents").select("doc_id", E.entity(F.col("text"), slot).alias("xs")).filter(F.size("xs") > 0)
        return found.select("doc_id", F.array_join("xs", " | ").alias("found"))


for _slot in ("email", "phone", "url", "version", "price", "date", "ip", "handle"):
    _entity_query(_slot)


@query()
def readability(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "documents").select("doc_id", R.readability("text").alias("r"))
    return rows.select("doc_id", "r.words", "r.sentences", F.round("r.ease", 4).alias("ease"), F.round("r.grade", 4).alias("grade"), R.fog_estimate(F.col("r.grade")).alias("fog"), F.round(R.quality(F.col("r.ease"), F.col("r.grade")), 6).alias("quality"))


@query("SELECT doc_id, nfc_normalize(text) AS nfc FROM documents WHERE text IS NOT NULL")
def nfc_texts(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "documents").filter("text is not null").select("doc_id", R.nfc("text").alias("nfc"))


_SIMHASH_SQL = """
d AS (SELECT doc_id AS id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^a-z0-9à-öø-ÿ]+|[^a-z0-9à-öø-ÿ]+$', '', 'g')), lambda w: w <> '') AS w FROM documents),
s AS (SELECT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [NULL] END) AS sh FROM d),
m AS (SELECT id, ('0x' || substring(md5(sh), 1, 8))::BIGINT AS a, ('0x' || substring(md5(sh), 9, 8))::BIGINT AS b FROM s),
hashes AS (SELECT id, """ + ", ".join("(" + " + ".join(f"CASE WHEN sum((({c} >> {i}) & 1) * 2 - 1) > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) + f")::BIGINT AS {n}" for c, n in (("a", "hi"), ("b", "lo"))) + " FROM m GROUP BY id)"


@query(f"WITH {_SIMHASH_SQL} SELECT id AS doc_id, hi, lo FROM hashes")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.simhash(texts(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_NEAR_SQL = f"""{_SIMHASH_SQL}, nz AS (SELECT * FROM hashes WHERE NOT (hi = 0 AND lo = 0)), cl AS (SELECT hi, lo, min(id) AS id FROM nz GROUP BY hi, lo),
copies AS (SELECT cl.id AS a, nz.id AS b, 0 AS bits FROM nz JOIN cl USING (hi, lo) WHERE nz.id <> cl.id),
pairs AS (SELECT x.id AS a, y.id AS b, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::INT AS bits FROM cl x JOIN cl y ON x.id < y.id WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3 UNION ALL SELECT * FROM copies)"""


@query(f"WITH {_NEAR_SQL} SELECT a, b, bits FROM pairs")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    hashes = cut(dedup.simhash(texts(spark, folder, "documents"), "doc_id", "text"))
    return dedup.near_pairs(hashes).select("a", "b", F.col("bits").cast("int").alias("bits"))


@query(f"WITH {_NEAR_SQL}, w AS (SELECT a AS id, b AS near_id, bits FROM pairs UNION ALL SELECT b, a, bits FROM pairs) SELECT id, near_id, bits FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY bits, near_id) = 1")
def nearest_duplicate(spark: SparkSession, folder: str) -> DataFrame:
    hashes = cut(dedup.simhash(texts(spark, folder, "documents"), "doc_id", "text"))
    return dedup.nearest_duplicate(dedup.near_pairs(hashes)).select("id", "near_id", F.col("bits").cast("int").alias("bits"))


@query(f"""
WITH RECURSIVE {_NEAR_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk(id, r) AS (SELECT a, a FROM e UNION SELECT e.b, walk.r FROM walk JOIN e ON e.a = walk.id), comp AS (SELECT id, min(r) AS component FROM walk GROUP BY id)
SELECT doc_id, component, row_number() OVER (PARTITION BY component ORDER BY fetched_at ASC NULLS LAST, doc_id) = 1 AS canonical FROM comp JOIN documents ON doc_id = id""")
def canonical_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicates with the record seen first as canonical."""
    from ..operators import graph

    docs = texts(spark, folder, "documents")
    pairs = cut(dedup.near_pairs(cut(dedup.simhash(docs, "doc_id", "text"))))
    groups = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = groups.join(docs.select(F.col("doc_id").alias("node"), "fetched_at"), "node")
    return dedup.canonical(rows, "component", "fetched_at", "node").select(F.col("node").alias("doc_id"), "component", "canonical")


@query("SELECT content_hash, count(*) AS copies, max(id) AS kept FROM (SELECT DISTINCT id, content_hash, content_text FROM page_content WHERE coalesce(content_hash, '') <> '') GROUP BY content_hash HAVING count(*) > 1")
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "page_content").filter("coalesce(content_hash, '') <> ''").select("id", "content_hash", "content_text").distinct()
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.max("id").alias("kept")).filter("copies > 1")


@query(f"""
WITH i AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS sh FROM (SELECT item_id, {_WORDS.format("lower(text)")} AS w FROM eval_items) WHERE len(w) >= 3),
d AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS sh FROM (SELECT doc_id, {_WORDS.format("lower(text)")} AS w FROM documents) WHERE len(w) >= 3),
iu AS (SELECT item_id, unnest(sh) AS s FROM i), du AS (SELECT doc_id, unnest(sh) AS s FROM d)
SELECT item_id, doc_id, count(*) AS shared FROM iu JOIN du USING (s) GROUP BY ALL HAVING count(*) >= 20""")
def shingle_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share twenty distinct three-word shingles or more with an item."""
    shingle = lambda df, key: df.select(key, F.explode(F.array_distinct(T.shingles(T.words(F.lower("text")), 3))).alias("s"))
    items, docs = shingle(table(spark, folder, "eval_items"), "item_id"), shingle(texts(spark, folder, "documents"), "doc_id")
    return items.join(docs, "s").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).filter("shared >= 20")


@query("SELECT lower(split_part(regexp_replace(lower(domain), '^www\\.', ''), '.', -1)) AS suffix, count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY ALL")
def suffix_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(spark, folder, "documents").filter("domain is not null")
    return rows.groupBy(U.public_suffix(F.regexp_replace(F.lower("domain"), r"^www\.", "")).alias("suffix")).agg(F.count("*").alias("n"))
