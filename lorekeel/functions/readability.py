"""Functions that need Python for each text, vectorised over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SYLLABLE = re.compile(r"[aeiouyà-æè-ïò-öù-ý]+")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?]+")
_READABILITY = T.StructType([T.StructField(n, T.IntegerType()) for n in ("words", "sentences", "syllables")] + [T.StructField(n, T.DoubleType()) for n in ("ease", "grade")])


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode form NFC; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode form NFKC; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def syllables(word: str) -> int:
    """Groups of vowels, without a silent e at the end; at least one."""
    count = len(_SYLLABLE.findall(word))
    if word.endswith("e") and not word.endswith("le") and count > 1:
        count -= 1
    return max(1, count)


@F.pandas_udf(_READABILITY)
def readability(text: pd.Series) -> pd.DataFrame:
    """Flesch reading ease and Flesch-Kincaid grade by the published formulas; null for texts of fewer than three words."""
    rows = []
    for t in text:
        found = [w.lower() for w in _WORD.findall(t)] if t else []
        ends = max(1, len(_END.findall(t))) if t else 0
        total = sum(map(syllables, found))
        if len(found) < 3:
            rows.append((len(found), ends, total, None, None))
        else:
            per_sentence, per_word = len(found) / ends, total / len(found)
            rows.append((len(found), ends, total, 206.835 - 1.015 * per_sentence - 84.6 * per_word, 0.39 * per_sentence + 11.8 * per_word - 15.59))
    return pd.DataFrame(rows, columns=["words", "sentences", "syllables", "ease", "grade"])


def fog_estimate(grade: Column) -> Column:
    """Gunning fog index estimated from the Flesch-Kincaid grade."""
    return F.round(grade * 1.1 + 0.8, 1)


def quality(ease: Column, grade: Column) -> Column:
    """0.7 of ease in hundredths and 0.3 of a grade term that is 1 from grade 6 to 12; 0.5 where unknown."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    term = F.when(grade.between(6, 12), F.lit(1.0)).when(grade < 6, grade / 6.0).otherwise((20.0 - grade) / 8.0)
    return F.when(ease.isNotNull() & grade.isNotNull(), 0.7 * clamp(ease / 100.0) + 0.3 * clamp(term)).otherwise(F.lit(0.5))


def hash_vector(text: str | None, dims: int = 32) -> list[float]:
    """Byte values summed by position modulo `dims`, at unit length; zeros for an empty text."""
    out = [0.0] * dims
    for i, byte in enumerate((text or "").encode()):
        out[i % dims] += byte / 255.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm > 0 else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    return text.map(hash_vector)
