"""Texts that were cut off by a limit or in transfer.

Problem 9. A backward character n-gram model over all lines counts, for the
characters before each position read from right to left, how often a line ends
there and how often it goes on. It is made of two parts, whose log-odds add up.
The characters themselves, for each language, tell whether a word ends after
these letters or goes on. Their classes, with runs of letters and of digits as one, reach back over several
words to the start of the line and tell its form: a sentence, an entry, a
signature, a link. A text is cut if its last context is that of a line that
goes on, against a threshold found for each language and column.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .langid import named_language

#: Context lengths in classes of characters, longest first.
ORDERS = (10, 6, 3)
#: Context lengths in characters, longest first.
LETTERS = (7, 4)
#: Texts whose contexts are counted together before they are shuffled.
COUNTED_TEXTS = 2000
#: Contexts seen less often say nothing; the shorter one decides.
SUPPORT = 2
#: Weight of the shorter context's share of ends, in occurrences.
DRAW = 2.0
_START, _LINE, _DOC = 15, 16, 17
_CLASSES: list[np.ndarray] = []
#: Marks of omission, words that follow them, and remnants of broken characters, entities and tags.
_MARK = re.compile(
    r"\s*(?:(?:\.\.\.|…|>>|»|\[\s*(?:\.\.\.|…|\+\s*\d+\s*\w*)\s*\]|\(\s*(?:\.\.\.|…)\s*\))\s*"
    r"(?:\(?(?:continued|more|read (?:on|more)|weiter(?:lesen)?|mehr|lire la suite|suite|leer más|más|continua|leggi tutto|ler mais|lees (?:verder|meer)|читать далее|далее)\)?\s*[.»>]*)?)\s*$",
    re.I,
)
_REMNANT = re.compile(r"\s*(?:�+|&#?\w{0,7}|</?[a-z]\w{0,9}(?:\s[^<>]{0,80})?|\\u[0-9a-f]{0,3}|%[0-9A-F]?)$", re.I)


def _class_table() -> np.ndarray:
    """The class of each code point: 0 space, 1 and 2 letters, 3 digits, 4 to 14 signs."""
    if not _CLASSES:
        table = np.full(sys.maxunicode + 1, 14, np.uint8)
        for n in range(0x3000):
            kind = unicodedata.category(chr(n))
            table[n] = 2 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 3 if kind[0] == "N" else 0 if kind[0] in "ZC" else 14
        table[0x3000:0xD800] = 1
        for value, signs in ((4, "."), (5, "!?"), (6, ","), (7, ";:"), (8, "\"'«»„“”‘’"), (9, "-–—•*·"), (10, "([{<"), (11, ")]}>"), (12, "#@"), (13, "/\\=+_&%$|~^`")):
            for sign in signs:
                table[ord(sign)] = value
        table[ord("\n")] = _LINE
        table[0] = _DOC
        _CLASSES.append(table)
    return _CLASSES[0]


def contexts(joined: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of texts joined by NUL: for each symbol whether its line ends there, whether its line is a text's first, its contexts by order, and whether the symbol counts (is no boundary)."""
    table = _class_table()
    kinds = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = (kinds == 1) | (kinds == 2)
    digit = kinds == 3
    keep = kinds != 0
    keep[1:] &= ~((letter[1:] & letter[:-1]) | (digit[1:] & digit[:-1]))
    s = kinds[keep]
    n = len(s)
    boundary = s >= _LINE
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(boundary, at, -1))
    since = at - last
    value = np.where(boundary, _START, s).astype(np.int64)
    ends = np.ones(n, bool)
    ends[:-1] = boundary[1:]
    # Line numbers in each text: a text's first line has no line boundary before it since the text's start.
    lines = np.cumsum(s == _LINE)
    doc_start = np.maximum.accumulate(np.where(s == _DOC, at, -1))
    base = np.where(doc_start >= 0, lines[np.maximum(doc_start, 0)], 0)
    first = lines == base
    out = []
    context = np.zeros(n, np.int64)
    wanted = sorted(ORDERS)
    for j in range(max(ORDERS)):
        moved = np.full(n, _START, np.int64)
        if j < n:
            moved[j:] = value[: n - j]
        context = context | np.where(j <= since, moved << (4 * j), 0)
        if j + 1 in wanted:
            out.append(context.copy())
    return ends, first, out[::-1], ~boundary


def letters(joined: str, language: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of texts joined by NUL, with a number for the language of each: for each character whether its word ends there, its contexts by LETTERS, whether it counts (is a letter), and whether it is a NUL.

    A context is a hash of the language and of the characters up to this one,
    in lower case; it stops at the start of the word.
    """
    code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    at = np.arange(n)
    kinds = _class_table()[code]
    letter = (kinds == 1) | (kinds == 2)
    ends = np.ones(n, bool)
    ends[:-1] = ~letter[1:]
    since = at - np.maximum.accumulate(np.where(letter, -1, at))
    value = code.astype(np.uint64) + np.uint64(1)
    nul = code == 0
    state = language[np.minimum(np.cumsum(nul), len(language) - 1)].astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        for k in range(max(LETTERS)):
            moved = np.zeros(n, np.uint64)
            moved[k:] = value[: n - k]
            state = (state ^ np.where(k < since, moved, np.uint64(0))) * np.uint64(0xFF51AFD7ED558CCD)
            state ^= state >> np.uint64(32)
            if k + 1 in LETTERS:
                found.append(state.view(np.int64).copy())
    return ends, found[::-1], letter, nul


def _clean(text: str) -> str:
    """The text without NUL characters and without spaces at the ends of its lines."""
    return "\n".join(line.rstrip() for line in text.replace("\0", " ").split("\n"))


def _shorn(text: str) -> tuple[str, bool]:
    """The text without a mark of omission or broken remnant at its end, and whether it had one."""
    text = text.rstrip()
    # Marks may stand on a line of their own, below the last one.
    at = text.rfind("\n", 0, max(0, text.rfind("\n"))) + 1
    head, tail = text[:at], text[at:]
    rest = _MARK.sub("", tail)
    if rest == tail:
        rest = _REMNANT.sub("", tail)
    return (head + rest).rstrip(), rest != tail


def _model(df: DataFrame) -> DataFrame:
    """Rows (n, context, ends, goes) of all contexts of (text, label) that occur SUPPORT times or more; n is negative for contexts of characters."""

    def counted(n: int, context: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        keys, inverse = np.unique(context, return_inverse=True)
        stops = np.bincount(inverse, weights=ends, minlength=len(keys)).astype(np.int64)
        every = np.bincount(inverse, minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys), pa.array(stops), pa.array(every - stops)], names=["n", "context", "ends", "goes"])

    def run(batches):
        for batch in batches:
            rows = [(_clean(t), _number(named_language(label))) for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]
            for low in range(0, len(rows), COUNTED_TEXTS):
                joined = "\0".join(text for text, _ in rows[low : low + COUNTED_TEXTS])
                language = np.array([number for _, number in rows[low : low + COUNTED_TEXTS]], np.int64)
                ends, first, found, counts = contexts(joined)
                # The first line may be a title, which ends without a stop.
                use = counts & ~(first & ends)
                for n, context in zip(ORDERS, found, strict=True):
                    yield counted(n, context[use], ends[use])
                ends, found, letter, _ = letters(joined, language)
                for n, context in zip(LETTERS, found, strict=True):
                    yield counted(-n, context[letter], ends[letter])

    rows = df.select("text", "label").mapInArrow(run, "n int, context long, ends long, goes long")
    return rows.groupBy("n", "context").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")).filter(F.col("ends") + F.col("goes") >= SUPPORT)


def _number(language: str | None) -> int:
    """A number for a language code; 0 for none."""
    return int.from_bytes((language or "").encode()[:4], "big")


def truncated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    keep: tuple[str, ...] = (),
    steady: float = 50.0,
) -> DataFrame:
    """Rows (id, *keep, log_odds, marked, cut) of all rows with a text; `cut` says whether it breaks off.

    Null, empty and blank texts are complete and give no row. log_odds is that
    of an end against a continuation after the text's last context, by the
    form of its last line and by its last characters; a mark of omission or a
    broken remnant is taken off first (`marked`) and makes a cut, unless it
    follows the end of a sentence. The threshold on log_odds is found for each
    language in this column: the value that parts the log-odds of its texts in
    two groups of least spread, drawn to that of all languages by `steady`
    texts. Repeated rows come out repeatedly; columns other than those named
    are ignored; an empty table gives no rows.

    Counts are taken over all lines of all texts, and whole lines are read.
    Only contexts are shuffled; each text looks up its own by joins. The
    driver holds one histogram a language.
    """
    label = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("label"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    model = cut(_model(chosen.filter("text is not null")))
    kept = [f"k{i}" for i in range(len(keep))]
    looked_up = [f"c{n}" for n in ORDERS] + [f"l{n}" for n in LETTERS]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in chosen.select("id", *kept).schema] + ["language string", "marked boolean", *[f"{c} long" for c in looked_up]])

    def run(batches):
        for batch in batches:
            at, languages, marks, tails = [], [], [], []
            for n, (text, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not text or not text.strip():
                    continue
                rest, marked = _shorn(text)
                if not rest.strip():
                    continue
                at.append(n)
                languages.append(named_language(label) or "")
                marks.append(marked)
                tails.append(_clean(rest.rsplit("\n", 1)[-1]))
            if not at:
                continue
            joined = "\0".join(tails) + "\0"
            _, _, found, counts = contexts(joined)
            # The last symbol of each tail stands before its NUL; tails of spaces and controls alone have none.
            ends = np.flatnonzero(~counts)
            has = np.diff(np.concatenate([[-1], ends])) > 1
            where = np.maximum(ends - 1, 0)
            lasts = [pa.array(np.where(has, context[where], 0)) for context in found]
            _, found, letter, nul = letters(joined, np.array([_number(x) for x in languages], np.int64))
            where = np.maximum(np.flatnonzero(nul) - 1, 0)
            lasts += [pa.array(context[where], mask=~letter[where]) for context in found]
            rows = pa.array(at, pa.int64())
            columns = [batch.column(0), *[batch.column(3 + i) for i in range(len(kept))]]
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in columns], pa.array(languages), pa.array(marks), *lasts], names=["id", *kept, "language", "marked", *looked_up])

    scored = chosen.mapInArrow(run, schema)
    for c in looked_up:
        n = int(c[1:]) * (1 if c[0] == "c" else -1)
        part = model.filter(F.col("n") == n).select(F.col("context").alias(c), F.col("ends").alias(f"{c}_ends"), F.col("goes").alias(f"{c}_goes"))
        scored = scored.join(part, c, "left")
    # A text's own end is one of those counted.
    own = F.when(F.col("marked"), 0).otherwise(1)
    totals = {row["n"]: row for row in model.filter(F.col("n").isin(min(ORDERS), -min(LETTERS))).groupBy("n").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")).collect()}

    def log_odds(n: int, names: list[str]) -> Column:
        """Those of an end, against its share in all places."""
        e, g = (totals[n]["ends"], totals[n]["goes"]) if n in totals else (0, 0)
        base = (e + 1) / (e + g + 2)
        # Each order's share of ends is drawn towards that of the next shorter one.
        chance = F.lit(base)
        for c in reversed(names):
            ends = F.greatest(F.coalesce(F.col(f"{c}_ends"), F.lit(0)) - own, F.lit(0))
            chance = (ends + DRAW * chance) / (ends + F.coalesce(F.col(f"{c}_goes"), F.lit(0)) + DRAW)
        return F.log(chance / (1 - chance)) - math.log(base / (1 - base))

    form = log_odds(min(ORDERS), [f"c{n}" for n in ORDERS])
    # That a word may end here is no sign of an end of the text; that it goes on is one of a cut.
    word = F.least(F.lit(0.0), log_odds(-min(LETTERS), [f"l{n}" for n in LETTERS]))
    odds = form + F.when(F.col(f"l{min(LETTERS)}").isNull(), F.lit(0.0)).otherwise(word)
    rated = cut(scored.select("id", *kept, "language", "marked", odds.alias("log_odds")))
    binned = rated.filter("not marked").groupBy("language", F.round(F.greatest(F.lit(-20), F.least(F.lit(20), F.col("log_odds"))), 1).alias("b")).agg(F.count("*").alias("n")).collect()
    thresholds = _thresholds([(r["language"], r["b"], r["n"]) for r in binned], steady)
    limit = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(thresholds.items()) for x in pair])[F.col("language")] if thresholds else F.lit(None).cast("double"), F.lit(0.0))
    names = [F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
    return rated.select(F.col("id").alias(id_col), *names, "log_odds", "marked", (F.col("marked") | (F.col("log_odds") < limit)).alias("cut"))


def _thresholds(bins: list[tuple[str, float, int]], steady: float) -> dict[str, float]:
    """For each language the log-odds that part its texts in two groups of least spread.

    The texts of all languages together count as `steady` texts of each, so
    that a language of few texts takes the common threshold.
    """
    at = np.round(np.arange(-60, 61) / 10, 1)
    whole = np.zeros(len(at))
    by_language: dict[str, np.ndarray] = {}
    for language, b, n in bins:
        place = int(round((min(6.0, max(-6.0, b)) + 6.0) * 10))
        by_language.setdefault(language, np.zeros(len(at)))[place] += n
        whole[place] += n
    out = {}
    for language, counts in by_language.items():
        mixed = counts + steady * whole / max(1.0, whole.sum())
        below, total = np.cumsum(mixed), mixed.sum()
        sums = np.cumsum(mixed * at)
        above = total - below
        with np.errstate(divide="ignore", invalid="ignore"):
            between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
        between = np.where((below > 0) & (above > 0), between, 0)
        best = np.flatnonzero(between >= between.max() - 1e-9 * abs(between.max()))
        # Any value in the gap parts them alike; its middle is taken.
        # A context that ends more often than places do at large is none of a cut, even if no text of the language is cut.
        out[language] = min(0.0, float(at[best].mean() + 0.05)) if between.max() > 0 else 0.0
    return out


def truncation_by_source(found: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows (source, texts, cut, share) of `truncated` rows that keep their source; a null source is one of its own."""
    counted = found.groupBy(source_col).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))
    return counted.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
