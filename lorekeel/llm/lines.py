"""Lines of page texts: keys up to spelling, and the site a page belongs to."""

from __future__ import annotations

import re
import unicodedata

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE = re.compile(r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b|\b\d{1,2}\.?\s+(?:de\s+)?[^\W\d_]{3,12}\.?,?\s+(?:de\s+)?(?:19|20)\d\d\b|\b[^\W\d_]{3,12}\.?\s+\d{1,2},?\s+(?:19|20)\d\d\b")
ADDRESS_FORM = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+|(?<!\w)/[\w.~%-]+[^\s]*|\b\w+(?:\.\w+)+(?::\d+)?|\b\w+:\d+\b")
_WORD = re.compile(r"[^\W_]+")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_MARKED = re.compile(r"[^\W_]+|[\x01-\x03]")
_SPECIAL = re.compile(r"[\d/@]|\w\.\w")
#: A run of words with digits in them, as 1,234 or 10 000, is one number.
_NUMBERS = re.compile(r"[^\W_]*\d[^\W_]*(?:[\W_]+[^\W_]*\d[^\W_]*)*")
#: Stand for a filled-in date, address or number in a line's words.
DATE, ADDRESS, NUMBER = "%d", "%a", "%n"
_MARKS = {"\x01": DATE, "\x02": ADDRESS, "\x03": NUMBER}


def fold(text: str) -> str:
    """Lower case without accents or compatibility forms."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    return text if text.isascii() else _COMBINING.sub("", text)


def line_words(line: str) -> list[str]:
    """The words of a line, with dates, addresses and numbers replaced by marks."""
    text = fold(line)
    if not _SPECIAL.search(text):
        return _WORD.findall(text)
    text = _DATE.sub(" \x01 ", text)
    text = ADDRESS_FORM.sub(" \x02 ", text.rstrip(" .!?,;:)»”\"'"))
    text = _NUMBERS.sub(" \x03 ", text)
    return [_MARKS.get(word, word) for word in _MARKED.findall(text)]


def key_of(words: list[str]) -> int:
    """A signed 64-bit key of the words; 0 for none."""
    if not words:
        return 0
    h = xxhash.xxh64_intdigest(" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def site(domain: Column) -> Column:
    """The site of a domain: lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", "")


def node_sites(nodes: DataFrame, id_col: str = "id", domain_col: str = "domain", *more: Column) -> DataFrame:
    """One row (node, site) for each node, whatever number of rows it comes in; the least site where they differ."""
    rows = nodes.select(F.col(id_col).alias("node"), site(F.col(domain_col)).alias("site"), *more).filter("node is not null")
    return rows.groupBy("node").agg(F.min("site").alias("site"), *[F.min(c).alias(c) for c in rows.columns[2:]])
