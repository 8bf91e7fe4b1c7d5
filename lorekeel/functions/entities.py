"""Entities found by pattern: each slot an array in order of appearance, equal ones (up to case) once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of each slot. ASCII classes, no look-around, so that other engines agree.
PATTERNS: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}",
    "url": r"https?://[A-Za-z0-9./?=&%_~:#@+-]+",
    "repository": r"https?://(?:github|gitlab|bitbucket)\.(?:com|org)/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+",
    "version": r"v?[0-9]+\.[0-9]+\.[0-9]+(?:-[A-Za-z0-9.]+)?",
    "license": r"(?i)(?:MIT|Apache-2\.0|BSD-[23]-Clause|GPL-[23]\.0|LGPL-[23]\.[01]|MPL-2\.0|ISC|CC BY(?:-[A-Z]{2})* ?[0-9.]*) licen[sc]e",
    "price": r"[$€£] ?[0-9]+(?:[.,][0-9]{3})*(?:[.,][0-9]{2})?",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}",
    "ip": r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}",
    "handle": r"@[A-Za-z0-9_]{2,30}",
    "tex": r"\$[^$\n]{1,200}\$",
}
#: Entities of a slot kept for one text, where there is a limit.
MOST = {"tex": 200}


def distinct_ignoring_case(found: Column) -> Column:
    """First of each value that is equal up to case, in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(found, none, lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.array_append(kept, x)))


def entity(text: Column, slot: str) -> Column:
    """Entities of one slot; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[slot]), 0)
    kept = distinct_ignoring_case(found)
    return F.slice(kept, 1, MOST[slot]) if slot in MOST else kept


def entities(text: Column) -> Column:
    """All slots as a struct of arrays."""
    return F.struct(*[entity(text, slot).alias(slot) for slot in PATTERNS])
