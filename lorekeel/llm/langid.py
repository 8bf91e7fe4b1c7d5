"""Language of documents and of their lines, by compression.

Problem 1. Each language has a zstandard dictionary of raw content, made from
its labelled samples. A text is compressed with every dictionary; the smallest
result names the language, unless the next one is too close or the dictionary
helps too little for the text to be language at all.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import fold

#: Bytes of samples a language, at most; later samples add little and the dictionaries are broadcast.
MAX_SAMPLE_BYTES = 1 << 20
_LINKS = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+|\S+@\S+\.\S+", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Names and codes of languages (ISO 639-1, 639-2, and in words).
NAMES: dict[str, str] = {
    name: code
    for code, names in {
        "en": "en eng english englisch anglais ingles inglese engels английский",
        "de": "de deu ger german deutsch allemand aleman tedesco alemao duits немецкий",
        "fr": "fr fra fre french francais franzosisch frances francese frans французский",
        "es": "es spa spanish espanol castellano spanisch espagnol spagnolo espanhol spaans испанский",
        "it": "it ita italian italiano italienisch italien italiaans итальянский",
        "pt": "pt por portuguese portugues portugiesisch portugais portoghese portugees португальский",
        "nl": "nl nld dut dutch nederlands niederlandisch neerlandais holandes olandese голландский нидерландский",
        "ru": "ru rus russian русский russisch russe ruso russo",
    }.items()
    for name in names.split()
}


def named_language(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names by code, region or name; None if it names none of those known."""
    if not label:
        return None
    words = _LETTERS.findall(fold(label))
    return NAMES.get(words[0]) if words else None


def normal(text: str) -> bytes:
    """The words of a text, folded, without links and numbers."""
    if "/" in text or "@" in text or "www" in text:
        text = _LINKS.sub(" ", text)
    return " ".join(_LETTERS.findall(fold(text))).encode()


class Classifier:
    """Compressors of all languages."""

    def __init__(self, samples: dict[str, list[str]], level: int, margin: float, gain: float, least_letters: int):
        import zstandard

        options = {"level": level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.margin, self.gain, self.least = margin, gain, least_letters
        self.plain = zstandard.ZstdCompressor(**options)
        self.by_language = []
        for language, texts in sorted(samples.items()):
            data = zstandard.ZstdCompressionDict(b"\n".join(normal(t) for t in texts), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.by_language.append((language, zstandard.ZstdCompressor(dict_data=data, **options)))

    def language(self, text: str) -> tuple[str | None, float]:
        """(language, confidence), or (None, confidence) where the margin is narrow or the text is no language."""
        data = normal(text)
        if len(data) < self.least or not self.by_language:
            return None, 0.0
        sizes = sorted((len(c.compress(data)), language) for language, c in self.by_language)
        best, language = sizes[0]
        lead = (sizes[1][0] if len(sizes) > 1 else len(self.plain.compress(data))) - best
        confidence = 1 - math.exp(-3 * lead / (self.margin * len(data) + 4))
        if lead < 2 or lead < self.margin * len(data) or best > (1 - self.gain) * len(self.plain.compress(data)):
            return None, confidence
        return language, confidence


def samples_of(samples: DataFrame, most_bytes: int = MAX_SAMPLE_BYTES) -> dict[str, list[str]]:
    """Labelled texts by language; of each language the first by id until they hold `most_bytes`."""
    rows = samples.filter("lang is not null and text is not null").select("lang", "sample_id", "text", F.octet_length("text").cast("long").alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("sample_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    chosen = rows.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most_bytes)
    out: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "sample_id", "text").collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def languages(
    df: DataFrame,
    samples: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content_text",
    label_col: str | None = "language",
    level: int = 3,
    margin: float = 0.03,
    gain: float = 0.2,
    least_letters: int = 12,
    sample_bytes: int = MAX_SAMPLE_BYTES,
) -> DataFrame:
    """Rows (id, seg_no, lang, confidence, chars, words, label_names, main) for each document and each of its lines in a language.

    seg_no is -1 for the document, whose language is the one with most
    characters (the first by code of equal ones), and the line's number from 0
    otherwise, blank lines counted too. Lines of code, numbers, links and the
    like have no language and give no row; neither do documents without a line
    in a language, nor null and empty texts. `label_names` is the code that the
    document's label names, null if none, and `main` the document's language. Repeated rows come out repeatedly;
    other columns are ignored; an empty table gives no rows. One scan, no
    shuffle: the samples (of each language `sample_bytes`, and the rest of the
    last one) are broadcast.
    """
    label = F.col(label_col) if label_col else F.lit(None)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.cast("string").alias("label"))
    id_type = chosen.schema["id"].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast(samples_of(samples, sample_bytes))

    def run(batches):
        classifier = Classifier(known.value, level, margin, gain, least_letters)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            mains: list[str] = []
            for n, (text, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not text or text.isspace():
                    continue
                chars: dict[str, int] = {}
                weight: dict[str, float] = {}
                first = len(rows)
                named = named_language(label)
                for k, line in enumerate(text.split("\n")):
                    language, confidence = classifier.language(line)
                    if language:
                        size = len(line)
                        chars[language] = chars.get(language, 0) + size
                        weight[language] = weight.get(language, 0.0) + size * confidence
                        rows.append((k, language, confidence, size, len(line.split()), named))
                if chars:
                    main = min(chars, key=lambda c: (-chars[c], c))
                    share = weight[main] / sum(chars.values())
                    rows.append((-1, main, share, chars[main], 0, named))
                    mains += [main] * (len(rows) - first)
                at += [n] * (len(rows) - first)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays, pa.array(mains, pa.string())], names=["id", "seg_no", "lang", "confidence", "chars", "words", "label_names", "main"])

    schema = f"id {id_type}, seg_no int, lang string, confidence double, chars int, words int, label_names string, main string"
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def mislabelled(found: DataFrame, id_col: str = "doc_id", least_words: int = 5) -> DataFrame:
    """Of `languages` rows: documents whose label doesn't name their language, and lines of enough words in another language than their document's."""
    wrong = (F.col("seg_no") == -1) & ~F.col("label_names").eqNullSafe(F.col("lang"))
    other = (F.col("seg_no") >= 0) & (F.col("words") >= least_words) & (F.col("lang") != F.col("main"))
    return found.filter(wrong | other).select(id_col, "seg_no", "lang").distinct()
