"""Template residue, filler, error messages and script notices in place of content.

Problem 4. Labelled exemplars of residue are kept in an inverted index by their
words. Passage windows of a record retrieve the exemplars that share words with
them and are scored by TF-IDF containment: how much of the best exemplar's
weight the window holds, and how much of the window's weight the exemplars of
one kind and language account for together, which finds messages worded in
other ways. Inverse document frequencies are counted over the whole table.
Unfilled fields are one token, whatever their form, and filler is a kind of
exemplars like any other.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exemplars import EXEMPLARS, FIELD, LIVING, STOPWORDS
from .lines import ADDRESS_FORM, fold

#: Letters of a word that count, so that its forms are the same.
STEM = 6

#: The forms of an unfilled field, each with an exemplar of its kind.
FIELDS = re.compile(
    r"\{\{\{?\s*[\w.\-| ]{1,60}\s*\}?\}\}"  # {{ page.title }}
    r"|[$#]\{\s*[\w.\-]{1,60}\s*\}"  # ${article.text} #{title}
    r"|\$\(\w{1,40}\)"  # $(id)
    r"|\{[a-z_]{2,40}\}"  # {summary}
    r"|<%=?\s*[\w.\- ]{1,60}\s*%>"  # <%= title.name %>
    r"|\{%\s*[\w.\- ]{1,60}\s*%\}"  # {% block %}
    r"|\[\[\s*[\w.\- ]{1,60}\s*\]\]"  # [[date_label]]
    r"|@@\w{2,40}@@"  # @@city@@
    r"|%[A-Z][A-Z_]{2,40}%"  # %TITLE%
    r"|\bX{3}-[A-Z_]{2,40}-X{3}\b"  # XXX-NAME-XXX
    r"|(?<!\w)__[A-Z][A-Z_]{2,40}__(?!\w)"  # __NAME_VALUE__
    r"|<[A-Z][A-Z_]{2,40}>"  # <NAME>
    r"|\[[A-Z][A-Z_ ]{2,60} HERE\]"  # [CITY LABEL HERE]
)
#: What every unfilled field begins with.
_FIELD_SIGN = re.compile(r"[{<%$#@\[]|__[A-Z]|XXX")
#: Stems of words by which a sentence speaks about templates.
_ABOUT = re.compile(r"\b(?:template|vorlage|gabarit|plantilla|placeholder|platzhalter|modele de page|marcador de posicion)", re.I)
_QUOTED = re.compile(r'"[^"\n]{1,300}"|«[^»\n]{1,300}»|„[^“”\n]{1,300}[“”]|“[^”\n]{1,300}”')
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The words of a text, without addresses, paths and numbers; an unfilled field is one word."""
    if _FIELD_SIGN.search(text):
        text = FIELDS.sub(f" {FIELD} ", text)
    text = fold(text)
    return _WORD.findall(ADDRESS_FORM.sub(" ", text) if "/" in text or "." in text else text)


def stems_of(words: list[str]) -> list[str]:
    """Content words cut to their stems; words of little meaning are left out."""
    return [w[:STEM] for w in words if w not in STOPWORDS]


def unquoted(line: str, outside: int) -> str:
    """The line without its quotations, if so many words stand outside of them; else the line."""
    if not any(c in line for c in '"«„“'):
        return line
    rest = _QUOTED.sub(" ", line)
    return rest if len(_WORD.findall(rest)) >= outside else line


@dataclass(frozen=True)
class Rules:
    """When a window matches exemplars."""

    #: Content words of a window at most.
    window: int = 8
    #: Share of one exemplar's weight that the window holds, and of the window's weight that it accounts for.
    containment: float = 0.55
    coverage: float = 0.6
    #: Exemplars of fewer content words must be the whole sentence.
    short: int = 3
    #: Share of the window's weight that all exemplars of one kind and language account for, with so many distinct words.
    union: float = 0.66
    distinct: int = 3


class Index:
    """Exemplars with their weights, found by their words."""

    def __init__(self, exemplars: dict[str, dict[str, list[str]]], frequency: dict[str, int], rows: int, rules: Rules):
        self.rules = rules
        self.frequency, self.rows = frequency, rows
        self.idf: dict[str, float] = {}
        #: Of each exemplar its kind and language, its stems and their weight.
        self.entries: list[tuple[tuple[str, str], frozenset[str], float]] = []
        self.by_stem: dict[str, list[int]] = {}
        #: All stems of a kind and language.
        self.pool: dict[tuple[str, str], set[str]] = {}
        for language, kinds in exemplars.items():
            for kind, texts in kinds.items():
                for text in texts:
                    for part in _SENTENCE.split(text):
                        stems = frozenset(stems_of(words_of(part)) or [w[:STEM] for w in words_of(part)])
                        if not stems:
                            continue
                        for stem in stems:
                            self.by_stem.setdefault(stem, []).append(len(self.entries))
                            self.pool.setdefault((kind, language), set()).add(stem)
                        self.entries.append(((kind, language), stems, sum(self.weight(w) for w in stems)))
        self.living = {w[:STEM] for w in LIVING}

    def weight(self, stem: str) -> float:
        """The inverse document frequency of a stem; one that no exemplar holds weighs as a word of a hundredth of all rows."""
        known = self.idf.get(stem)
        if known is None:
            count = self.frequency.get(stem, self.rows // 100)
            known = self.idf[stem] = math.log((self.rows + 1) / (count + 1)) + 0.5
        return known

    def segment(self, words: list[str]) -> str | None:
        """The kind of exemplars that a window of these words matches."""
        stems = stems_of(words)
        if not stems:
            # A sentence of words of little meaning may be a short exemplar itself.
            stems = [w[:STEM] for w in words] if len(words) <= 3 else []
        if self.by_stem.keys().isdisjoint(stems):
            return None
        found = [self.by_stem.get(stem, ()) for stem in stems]
        size = self.rules.window
        if len(stems) <= size:
            return self._window(stems, found, len(stems))
        held = [bool(entries) for entries in found]
        for low in range(len(stems) - size + 1):
            # A window that brings in no found word holds less than the one before; of a longer text one or two words say nothing.
            if low and not held[low + size - 1]:
                continue
            if sum(held[low : low + size]) >= self.rules.short or FIELD[:STEM] in stems[low : low + size]:
                kind = self._window(stems[low : low + size], found[low : low + size], len(stems))
                if kind:
                    return kind
        return None

    def _window(self, window: list[str], found: list, length: int) -> str | None:
        rules = self.rules
        met = {e for entries in found for e in entries}
        held = frozenset(window)
        pools = set()
        for e in met:
            pool, own, total = self.entries[e]
            hits = own & held
            if sum(self.weight(w) for w in hits) >= rules.containment * total:
                at = [n for n, w in enumerate(window) if w in own]
                # Short exemplars say something only where they are all that is said.
                field = own == {FIELD[:STEM]}
                span = [FIELD[:STEM]] if field else window[at[0] : at[-1] + 1] if len(own) >= rules.short else window
                mass = sum(self.weight(w) for w in span)
                enough = field or (len(hits) >= rules.short if len(own) >= rules.short else length <= len(window))
                if enough and pool[0] != "filler" and sum(self.weight(w) for w in span if w in own) >= rules.coverage * mass:
                    return pool[0]
            pools.add(pool)
        mass = sum(self.weight(w) for w in window)
        for pool in sorted(pools):
            stems = self.pool[pool]
            inside = [w for w in window if w in stems]
            # A living language may hold some words of filler.
            least = {w for w in inside if pool[0] != "filler" or w not in self.living}
            if len(least) >= (rules.distinct if pool[0] != "filler" else 2) and len(window) >= rules.distinct and sum(self.weight(w) for w in inside) >= rules.union * mass:
                return pool[0]
        return None


def vocabulary(exemplars: dict[str, dict[str, list[str]]]) -> set[str]:
    return {w[:STEM] for kinds in exemplars.values() for texts in kinds.values() for text in texts for w in words_of(text)}


def document_frequency(df: DataFrame, text_cols: tuple[str, ...], stems: set[str]) -> tuple[dict[str, int], int]:
    """In how many rows each of the stems stands in any of the columns, and the number of rows; counted over the whole table."""
    wanted = df.sparkSession.sparkContext.broadcast(frozenset(stems))

    def run(batches):
        for batch in batches:
            counts: dict[str, int] = {}
            for values in zip(*[batch.column(c).to_pylist() for c in range(batch.num_columns)], strict=True):
                held = {w[:STEM] for text in values if text for w in set(words_of(text))}
                for stem in held & wanted.value:
                    counts[stem] = counts.get(stem, 0) + 1
            counts[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = df.select(*[F.col(c).alias(f"t{n}") for n, c in enumerate(text_cols)]).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {row["word"]: row["n"] for row in rows}
    return found, found.pop("", 0)


def kind_of(text: str | None, index: Index) -> str | None:
    """The kind of residue in a text, or None."""
    if not text:
        return None
    for line in text.split("\n"):
        line = unquoted(line, 3)
        # Short exemplars are told by sentences, messages of several sentences by the line.
        parts = [(sentence, words) for sentence in _SENTENCE.split(line) if (words := words_of(sentence))]
        if len(parts) > 1:
            parts.append((line, [word for _, words in parts for word in words]))
        for part, words in parts:
            kind = index.segment(words)
            if kind and not (kind == "placeholder" and _about(part)):
                return kind
    return None


def _about(sentence: str) -> bool:
    """Whether a sentence speaks about templates: it names them and has words enough besides its fields."""
    rest = FIELDS.sub(" ", sentence)
    return bool(_ABOUT.search(fold(rest))) and len(_WORD.findall(rest)) >= 5


def residue(
    df: DataFrame,
    id_col: str = "id",
    text_cols: tuple[str, ...] = ("content_text", "excerpt"),
    order_col: str | None = "created_at",
    exemplars: dict[str, dict[str, list[str]]] | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """Rows (id, column, kind) of records that carry residue in one of `text_cols`, the first such column of each.

    Quotations inside a sentence of their own and sentences about templates
    are no residue. Null and empty values are none; null ids take no part; an
    empty table gives no rows; of an id delivered several times the last by
    `order_col` counts, and of rows equal in that the one of the greatest text
    hash; other columns are ignored. `exemplars` are texts by language and kind.
    One scan counts their words over all of `text_cols`, one scores; only ids
    and findings are shuffled.
    """
    exemplars = EXEMPLARS if exemplars is None else exemplars
    frequency, rows = document_frequency(df, text_cols, vocabulary(exemplars))
    at = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    chosen = df.select(F.col(id_col).alias("id"), at.alias("at"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(text_cols)]).filter("id is not null")
    chosen = chosen.withColumn("tie", F.xxhash64(*[f"t{i}" for i in range(len(text_cols))]))
    id_type = chosen.schema["id"].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast((exemplars, frequency, rows))
    names = list(text_cols)

    def run(batches):
        index = Index(*known.value, rules)
        for batch in batches:
            columns: list[str | None] = [None] * batch.num_rows
            kinds: list[str | None] = [None] * batch.num_rows
            for c, name in enumerate(names):
                for n, text in enumerate(batch.column(2 + c).to_pylist()):
                    if kinds[n] is None:
                        kinds[n] = kind_of(text, index)
                        columns[n] = name if kinds[n] else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(batch.num_columns - 1), pa.array(columns, pa.string()), pa.array(kinds, pa.string())], names=["id", "at", "tie", "column", "kind"])

    scored = chosen.mapInArrow(run, f"id {id_type}, at timestamp, tie long, column string, kind string")
    last = scored.groupBy("id").agg(F.max_by(F.struct("column", "kind"), F.struct("at", "tie")).alias("last"))
    return last.select(F.col("id").alias(id_col), "last.*").filter("kind is not null")


def without_residue(df: DataFrame, found: DataFrame, id_col: str = "id") -> DataFrame:
    """`df` without the records found."""
    return df.join(found.select(id_col).distinct(), id_col, "left_anti")
