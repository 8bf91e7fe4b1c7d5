"""Routing of a query to its intent, by fixed patterns and then by words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell the language of a program, its domain and the intent.
LANGUAGES = {"rust": ["rust", "cargo", "tokio"], "python": ["python", "pip", "django"], "javascript": ["javascript", "typescript", "npm", "node"], "go": ["golang", "goroutine"], "java": ["java ", "maven", "spring"]}
DOMAINS = {"science": ["paper", "study", "research", "theorem"], "programming": ["code", "library", "compile", "debug"], "security": ["vulnerability", "exploit", "malware"], "news": ["news", "today", "latest"]}
CODE_WORDS = ["how to", "implement", "async fn", "fn ", "struct ", "impl ", "trait ", "macro "]
API_WORDS = ["api reference", "method ", "function ", "class ", "interface "]
SPEC_WORDS = ["rfc ", "specification", "standard "]


def _any(q: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | q.contains(word)
    return out


def _first(q: Column, table: dict[str, list[str]], default: str) -> Column:
    out = None
    for name, words in table.items():
        out = F.when(_any(q, words), name) if out is None else out.when(_any(q, words), name)
    return out.otherwise(default)


def route(query: Column) -> Column:
    """struct(intent, domain, language, confidence, strategy) of a query; null for null."""
    q = F.lower(F.trim(query))
    language = _first(q, LANGUAGES, "en")
    row = lambda intent, domain, lang, confidence, strategy: F.struct(F.lit(intent).alias("intent"), (F.lit(domain) if isinstance(domain, str) else domain).alias("domain"), (F.lit(lang) if isinstance(lang, str) else lang).alias("language"), F.lit(confidence).alias("confidence"), F.lit(strategy).alias("strategy"))
    return F.when(
        query.isNotNull(),
        F.when(q.rlike(r"cve-[0-9]{4}-[0-9]{4,}|ghsa-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}"), row("vulnerability", "security", "en", 0.99, "deterministic"))
        .when(q.rlike(r"(^|[^a-z0-9])e0[0-9]{3}([^a-z0-9]|$)"), row("rust_error", "rust", "en", 0.95, "deterministic"))
        .when(_any(q, CODE_WORDS), row("code_explanation", "programming", language, 0.85, "deterministic"))
        .when(_any(q, API_WORDS), row("api_docs", "programming", "en", 0.80, "deterministic"))
        .when(_any(q, SPEC_WORDS), row("specification", "technical", "en", 0.80, "deterministic"))
        .otherwise(row("general", _first(q, DOMAINS, "general"), language, 0.70, "language")),
    )
