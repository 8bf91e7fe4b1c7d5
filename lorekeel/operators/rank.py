"""Ranking signals, the ranker and its two-stage ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

#: Weights of the signals without and with vectors.
LEXICAL = {"bm25": 0.50, "freshness": 0.15, "quality": 0.10, "graph": 0.10, "vector": 0.0, "authority": 0.10, "machine": 0.20}
HYBRID = {"bm25": 0.35, "freshness": 0.10, "quality": 0.07, "graph": 0.08, "vector": 0.20, "authority": 0.08, "machine": 0.12}
EXAMPLE_BONUS, DIVERSITY = 0.05, 0.85
SEMANTIC_GATE, QUALITY_GATE, FUNNEL_SIZE = 0.60, 0.45, 128

#: Domains of sources by kind, with the prior of each kind; the first kind that fits counts.
INSTITUTIONS = [
    "wikipedia.org", "wikimedia.org", "archive.org", "gutenberg.org", "jstor.org", "arxiv.org",
    "semanticscholar.org", "ieee.org", "acm.org", "cern.ch", "nih.gov", "ncbi.nlm.nih.gov",
    "nature.com", "science.org", "cell.com", "thelancet.com", "nejm.org", "plos.org",
    "biorxiv.org", "medrxiv.org", "cochranelibrary.com", "mayoclinic.org", "who.int", "cdc.gov",
    "springer.com", "wiley.com", "oup.com", "cambridge.org", "sciencedirect.com", "pnas.org",
    "iop.org", "acs.org", "federalreserve.gov", "stlouisfed.org", "ecb.europa.eu", "bankofengland.co.uk",
    "bis.org", "imf.org", "worldbank.org", "oecd.org", "w3.org", "ietf.org",
    "iso.org", "nist.gov",
]
PRESS = [
    "reuters.com", "apnews.com", "afp.com", "upi.com", "propublica.org", "icij.org",
    "bellingcat.com", "theintercept.com", "bbc.com", "bbc.co.uk", "bloomberg.com", "wsj.com",
    "ft.com", "economist.com", "theguardian.com", "nytimes.com", "washingtonpost.com", "theatlantic.com",
    "newyorker.com", "foreignaffairs.com", "snopes.com", "factcheck.org", "politifact.com", "consumerreports.org",
]
CRAFT = ["seriouseats.com", "kingarthurbaking.com", "americastestkitchen.com"]
GOVERNMENT = [".gov", ".gov.uk", ".mil", ".gov.au", ".int", ".europa.eu"]
EDUCATION = [".edu", ".ac.uk", ".edu.au"]
#: Precision of each source tier.
PRECISION = {"raw_source": 0.95, "primary_official": 1.00, "reference": 0.70, "encyclopedia": 0.55, "community": 0.45, "unknown": 0.60}


def _ends(name: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for suffix in suffixes:
        out = out | name.endswith(suffix)
    return out


def _of(name: Column, domains: list[str]) -> Column:
    return name.isin(domains) | _ends(name, ["." + d for d in domains])


def institutional_prior(name: Column) -> Column:
    """Authority that a domain has by its kind."""
    d = F.lower(name)
    chain = ((_ends(d, GOVERNMENT), 0.35), (_ends(d, EDUCATION), 0.30), (_of(d, INSTITUTIONS), 0.28), (_of(d, PRESS), 0.22), (_of(d, CRAFT), 0.16), (d.endswith(".org"), 0.08))
    out = F.when(chain[0][0], F.lit(chain[0][1]))
    for test, value in chain[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(0.0))


def domain_authority(results: DataFrame, domain_col: str = "domain", graph_col: str = "graph") -> DataFrame:
    """Rows (domain, authority): the largest graph score of the domain's rows and its prior, at most 1."""
    top = results.groupBy(F.col(domain_col).alias("domain")).agg(F.max(F.coalesce(graph_col, F.lit(0.0))).alias("g"))
    return top.select("domain", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("g") + institutional_prior(F.col("domain")))).alias("authority"))


def source_tier(url: Column) -> Column:
    """Trust tier of a URL's host: raw source, official suffix, encyclopedia, community, official root, .org, unknown."""
    h = U.host(url)
    root, suffix = U.root_domain(h), U.public_suffix(h)
    return (
        F.when(h.isin("raw.githubusercontent.com", "gist.githubusercontent.com"), "raw_source")
        .when(suffix.isin("gov", "edu", "mil", "int", "gov.uk", "gov.au", "ac.uk", "edu.au"), "primary_official")
        .when(root.isin("wikipedia.org", "wikimedia.org", "britannica.com"), "encyclopedia")
        .when(root.isin("reddit.com", "stackoverflow.com", "stackexchange.com", "quora.com"), "community")
        .when(root.isin("rust-lang.org", "docs.rs", "python.org", "go.dev"), "primary_official")
        .when(suffix == "org", "reference")
        .otherwise("unknown")
    )


def precision(tier: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PRECISION.items() for x in pair])[tier], F.lit(0.60))


def code_intent(query: Column) -> Column:
    """Whether a query names an identifier or asks how code does something."""
    q = F.lower(query)
    return q.contains("cve-") | q.contains("ghsa-") | q.contains("rfc ") | q.contains("@") | q.rlike(r"(^|\s)[ew][0-9]{3,}(\s|$)") | q.rlike(r"\b(how does|implement|parse|compile)\b")


def intent_boost(score: Column, tier: Column, wants_code: Column) -> Column:
    """Raw sources gain 15 % (up to 1) and encyclopedias lose 30 % where a query wants code."""
    return F.when(wants_code & (tier == "raw_source"), F.least(F.lit(1.0), score * 1.15)).when(wants_code & (tier == "encyclopedia"), score * 0.70).otherwise(score)


def age_days(at: Column, as_of: Column) -> Column:
    """Whole days from `at` to `as_of`, never negative; null for an unknown time."""
    return F.when(at.isNotNull(), F.greatest(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400), F.lit(0)))


def freshness(at: Column, as_of: Column, days: float = 180.0, mode: str = "e_folding") -> Column:
    """exp(-age/days), or with mode "half_life" a half after `days`."""
    import math

    rate = 1 / days if mode == "e_folding" else math.log(2) / days
    return F.exp(-age_days(at, as_of) * rate)


def machine_readability(manifest: Column, markdown: Column, api: Column, structured: Column) -> Column:
    """0.35, 0.25, 0.20 and 0.20 for what a page offers to machines; null for nothing."""
    total = F.lit(0.0)
    for test, value in ((manifest, 0.35), (markdown, 0.25), (api, 0.20), (structured, 0.20)):
        total = total + F.when(test, value).otherwise(0.0)
    return F.when(manifest | markdown | api | structured, F.least(total, F.lit(1.0)))


def final_score(use_vector: bool, has_example: Column, **signals: Column) -> Column:
    """Weighted mean over the signals that are present; absent quality, graph and machine signals count in neither sum."""
    weights = HYBRID if use_vector else LEXICAL
    top, bottom = F.when(has_example, EXAMPLE_BONUS).otherwise(0.0), F.lit(0.0)
    for name, weight in weights.items():
        value = signals.get(name, F.lit(None).cast("double"))
        top = top + weight * F.coalesce(value, F.lit(0.0))
        bottom = bottom + (F.when(value.isNotNull(), weight).otherwise(0.0) if name in ("quality", "graph", "machine") else F.lit(weight))
    return F.greatest(F.lit(0.001), F.least(F.lit(1.0), top / bottom))


def quality_tier(vector: Column, quality: Column) -> Column:
    """high, marginal or rejected by how many of the two gates are passed; no vector passes its gate, unknown quality is 0.5."""
    v, q = F.coalesce(vector, F.lit(1.0)) >= SEMANTIC_GATE, F.coalesce(quality, F.lit(0.5)) >= QUALITY_GATE
    return F.when(v & q, "high").when(v | q, "marginal").otherwise("rejected")


def rank(results: DataFrame, use_vector: bool, per: str = "query_id", key: str = "url", order: str | None = None) -> DataFrame:
    """`results` (query_id, url, domain, bm25, freshness, quality, graph, vector, authority, machine, has_example) with score, tier and rank.

    The funnel puts rows that pass both gates first, by its own formula; its
    order decides which row of a domain counts as first. Each further row of a
    domain loses 15 %, and the penalised score ranks. Rows beyond FUNNEL_SIZE of
    a query (by `order`, else key) stand behind the others in the funnel.
    """
    names = ["bm25", "freshness", "quality", "graph", "vector", "authority", "machine"]
    score = final_score(use_vector, F.col("has_example"), **{n: F.col(n) for n in names if n != "vector" or use_vector})
    vector = F.col("vector") if use_vector else F.lit(None).cast("double")
    funnel = 0.40 * F.coalesce(vector, F.lit(1.0)) + 0.20 * F.coalesce("quality", F.lit(0.5)) + 0.15 * F.coalesce("bm25", F.lit(0.0)) + 0.10 * F.coalesce("freshness", F.lit(0.0)) + 0.10 * F.coalesce("graph", F.lit(0.0)) + F.when(F.col("has_example"), EXAMPLE_BONUS).otherwise(0.0)
    arrival = F.row_number().over(Window.partitionBy(per).orderBy(order or key))
    staged = results.withColumn("_s", score).withColumn("tier", quality_tier(vector, F.col("quality"))).withColumn("_f", funnel).withColumn("_late", arrival > FUNNEL_SIZE)
    passed = (F.coalesce(vector, F.lit(1.0)) >= SEMANTIC_GATE) & (F.coalesce("quality", F.lit(0.5)) >= QUALITY_GATE)
    by_funnel = [F.col("_late").asc(), passed.desc(), F.round("_f", 9).desc(), F.col(key).asc()]
    nth = F.row_number().over(Window.partitionBy(per, "domain").orderBy(*by_funnel)) - 1
    penalised = staged.withColumn("score", F.col("_s") * F.pow(F.lit(DIVERSITY), nth))
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.round("score", 9).desc(), F.col(key).asc()))
    return penalised.withColumn("rank", place).drop("_s", "_f", "_late")


def repaired_snippet(snippet: Column, excerpt: Column, text: Column, title: Column) -> Column:
    """The snippet, else the excerpt, else 200 characters of text, else the title."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(some(snippet), some(excerpt), F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.substring(text, 1, 200), F.lit("…"))), title)
