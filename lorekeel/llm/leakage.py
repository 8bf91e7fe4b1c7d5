"""Evaluation passages that appear in documents.

Problem 8. One Aho-Corasick automaton holds the word windows of all normalised
passages, whole passages that are too short for windows, and all answers. Each
document is scanned once; around its hits a passage is aligned with the document
in a band, in time linear in the stretch, and what is found is given with
offsets in the original text. Passages too short to tell by themselves count
where their answer follows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import fold

#: Characters of evaluation items broadcast at most.
MAX_ITEM_CHARS = 8 << 20
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def words_of(text: str) -> list[str]:
    """The folded words of a text; invisible characters don't part a word."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(fold(text))


@dataclass(frozen=True)
class Rules:
    """When a document holds a passage; `leaked_items` says what each means."""

    window: int = 5
    share: float = 0.4
    least_words: int = 10
    gap: int = 6
    block: int = 4
    density: float = 0.75
    #: Stretches of fewer words than `short` times `least_words` must fit as closely as `short_density`, since sentences of one pattern share most words.
    short: float = 2.4
    short_density: float = 0.85
    #: and so many of their windows must be no turns of phrase.
    own_windows: float = 0.6
    #: Share of the windows of the words that must be held for which edits may leave whole windows.
    needed: float = 0.25
    #: Windows held by more than this share of all passages are turns of phrase and count `common_weight`.
    common_share: float = 0.01
    common_weight: float = 0.4
    #: Words within which an answer follows a short passage.
    answer_gap: int = 40


def passages(items: list[dict], least_words: int = 10) -> dict[int, list[str]]:
    """The words of each item's passage: its text without the words that all items of its suite start with.

    Where a passage of `least_words` words would be left with fewer, these words are no instruction.
    """
    suites = defaultdict(list)
    for item in items:
        suites[item["suite"]].append((item["item_id"], words_of(item["text"] or "")))
    out = {}
    for members in suites.values():
        shared = 0
        if len(members) > 1:
            for column in zip(*(words for _, words in members if words), strict=False):
                if len(set(column)) > 1:
                    break
                shared += 1
            if any(len(words) >= least_words > len(words) - shared for _, words in members):
                shared = 0
        out |= {item_id: words[shared:] for item_id, words in members}
    return out


class Matcher:
    """The automaton and the rules by which a document holds a passage."""

    def __init__(self, items: list[dict], rules: Rules = Rules()):
        import ahocorasick

        self.rules = rules
        every = passages(items, rules.least_words)
        self.passages = {k: v for k, v in every.items() if len(v) >= rules.least_words}
        self.answers = {item["item_id"]: " ".join(words) for item in items if (words := words_of(item.get("answer") or ""))}
        #: Too short for windows: found whole, if the answer follows.
        self.whole = {k: " ".join(v) for k, v in every.items() if 0 < len(v) < rules.least_words and k in self.answers}
        window = rules.window
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, words in self.passages.items():
            for at in range(len(words) - window + 1):
                places[" ".join(words[at : at + window])].append((item_id, at))
        #: For each item, how many items hold its window at each place.
        self.held_by: dict[int, dict[int, int]] = defaultdict(dict)
        for where in places.values():
            holders = len({item_id for item_id, _ in where})
            for item_id, at in where:
                self.held_by[item_id][at] = holders
        self.common = max(2, int(len(self.passages) * rules.common_share))
        texts = set(places) | set(self.answers.values()) | set(self.whole.values())
        self.automaton = ahocorasick.Automaton()
        for text in texts:
            self.automaton.add_word(f" {text} ", (text, places.get(text, ())))
        if len(self.automaton):
            self.automaton.make_automaton()
        # Of the share of a passage that counts, edits may leave few whole windows.
        self.needed = {k: max(2, round(rules.needed * rules.share * len(v))) for k, v in self.passages.items()}
        self.phrases = set(self.answers.values()) | set(self.whole.values())

    def _likely(self, places: list[tuple[int, int]], needed: float, common: dict[int, int]) -> bool:
        """Whether windows enough lie near one or two diagonals, as those of a stretch do."""
        if len(places) < needed:
            return False
        diagonals: dict[int, set[int]] = defaultdict(set)
        for word, at in places:
            d = (word - at) // self.rules.gap
            diagonals[d].add(at)
            diagonals[d + 1].add(at)
        counts = sorted(((sum(1.0 if common.get(at, 0) <= self.common else self.rules.common_weight for at in ats), d) for d, ats in diagonals.items()), reverse=True)
        most, d = counts[0]
        return most + next((n for n, other in counts[1:] if abs(other - d) > 1), 0) >= needed

    def found(self, text: str) -> list[tuple[int, float, int, int, str, bool]]:
        """(item, share of its words, start, end, kind, answer seen) of each passage that the text holds."""
        if not len(self.automaton) or not text:
            return []
        words = words_of(text)
        joined = " " + " ".join(words) + " "
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        seen: dict[str, list[int]] = defaultdict(list)
        for end, (phrase, where) in self.automaton.iter(joined):
            if phrase in self.phrases:
                seen[phrase].append(end)
            for item_id, at in where:
                hits[item_id].append((end, at))
        out: list = []
        if not hits and not seen:
            return out
        # The number of the word that starts after each space.
        after, at = {0: 0}, 0
        for n, word in enumerate(words):
            at += len(word) + 1
            after[at] = n + 1
        for item_id, places in hits.items():
            if len(places) < self.needed[item_id]:
                continue
            where = [(after[end] - self.rules.window, at) for end, at in places]
            if not self._likely(where, self.needed[item_id], self.held_by[item_id]):
                continue
            best = self._align(self.passages[item_id], words, where, self.held_by[item_id])
            if best:
                coverage, first, last = best
                out.append((item_id, coverage, *_offsets(text, first, last), "passage", self.answers.get(item_id) in seen))
        for item_id, phrase in self.whole.items():
            answer = self.answers[item_id]
            if phrase in seen and answer in seen:
                last = [after[end] for end in seen[phrase]]
                size = answer.count(" ") + 1
                begins = sorted(after[end] - size for end in seen[answer])
                for end in last:
                    n = bisect_left(begins, end)
                    if n < len(begins) and begins[n] <= end + self.rules.answer_gap:
                        out.append((item_id, 1.0, *_offsets(text, end - phrase.count(" ") - 1, begins[n] + size - 1), "answer", True))
                        break
        return out

    def _align(self, passage: list[str], words: list[str], places: list[tuple[int, int]], held_by: dict[int, int]) -> tuple[float, int, int] | None:
        rules = self.rules
        rated = []
        covered: dict[int, int] = {}
        for n, at in sorted(places):
            # A hit on the diagonal of a stretch that holds it says nothing new.
            if covered.get(n - at, -1) >= n:
                continue
            blocks = self._stretch(passage, words, n, at)
            for a, b, size in blocks:
                covered[b - a] = max(covered.get(b - a, -1), b + size - 1)
            matched = sum(size for _, _, size in blocks)
            first, last = blocks[0], blocks[-1]
            span = max(last[0] + last[2] - first[0], last[1] + last[2] - first[1])
            density = rules.density
            if matched < rules.short * rules.least_words:
                density = max(density, rules.short_density)
                windows = [at for a, _, size in blocks for at in range(a, a + size - rules.window + 1)]
                if sum(held_by.get(at, 0) <= self.common for at in windows) < rules.own_windows * len(windows):
                    continue
            if matched >= rules.least_words and matched >= density * span:
                rated.append((matched, first[0], last[0] + last[2], first[1], last[1] + last[2] - 1))
        # One stretch, or two in the passage's order: of those that end before it in the passage the best.
        best = None
        for one in rated:
            if best is None or one[0] > best[0]:
                best = (one[0], one[3], one[4])
        starts = sorted(rated, key=lambda r: r[3])
        ends = sorted(rated, key=lambda r: r[4])
        # Best stretch among those that end in the document so far, by where they end in the passage.
        done: list = []
        k = 0
        for two in starts:
            while k < len(ends) and ends[k][4] < two[3]:
                one = ends[k]
                i = bisect_right(done, (one[2], float("inf")))
                if i == 0 or done[i - 1][1] < one[0]:
                    while i < len(done) and done[i][1] <= one[0]:
                        done.pop(i)
                    done.insert(i, (one[2], one[0], one))
                k += 1
            i = bisect_right(done, (two[1], float("inf")))
            if i:
                total = done[i - 1][1] + two[0]
                if total > best[0]:
                    best = (total, done[i - 1][2][3], two[4])
        if best and best[0] >= rules.share * len(passage):
            return best[0] / len(passage), best[1], best[2]
        return None

    def _stretch(self, passage: list[str], words: list[str], n: int, at: int) -> list[tuple[int, int, int]]:
        """Blocks (place in the passage, place in the document, size) of equal words around a hit, in order.

        From a block's end the next one is sought within `gap` words on either
        side: one of `block` words, or a shorter one right behind; in between
        single words count where they are the same in order.
        """
        forth = self._extend(passage, words, at, n, 1)
        back = self._extend(passage, words, at - 1, n - 1, -1)
        blocks = [(a - size + 1, b - size + 1, size) for a, b, size in reversed(back)]
        # The hit's own block was cut at the hit.
        if blocks and forth and blocks[-1][0] + blocks[-1][2] == forth[0][0] and blocks[-1][1] + blocks[-1][2] == forth[0][1]:
            a, b, size = blocks.pop()
            forth[0] = (a, b, size + forth[0][2])
        return blocks + forth

    def _extend(self, passage: list[str], words: list[str], a: int, b: int, step: int) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        gap, block = self.rules.gap, self.rules.block

        def run(i: int, j: int, most: int) -> int:
            size = 0
            while size < most and 0 <= i < len(passage) and 0 <= j < len(words) and passage[i] == words[j]:
                size, i, j = size + 1, i + step, j + step
            return size

        size = run(a, b, len(passage))
        if size:
            out.append((a, b, size))
        a, b = a + step * size, b + step * size
        while 0 <= a < len(passage) and 0 <= b < len(words):
            found = None
            for skipped in range(1, 2 * gap + 1):
                for i in range(max(0, skipped - gap), min(skipped, gap) + 1):
                    j = skipped - i
                    size = run(a + step * i, b + step * j, block)
                    if size >= block or size >= 2 and i <= 2 and j <= 2:
                        found = (i, j)
                        break
                if found:
                    break
            if not found:
                break
            i, j = found
            for k in range(i):
                # Single equal words within the gap, in order.
                for m in range(j):
                    if (not out or step * (b + step * m - out[-1][1]) > 0) and passage[a + step * k] == words[b + step * m]:
                        out.append((a + step * k, b + step * m, 1))
                        break
            a, b = a + step * i, b + step * j
            size = run(a, b, len(passage))
            out.append((a, b, size))
            a, b = a + step * size, b + step * size
        return out


def _offsets(text: str, first: int, last: int) -> tuple[int, int]:
    """Where in the original text its words number `first` to `last` begin and end."""
    if text.isascii():
        folded, origin = [text.lower()], range(len(text))
        text = ""
    else:
        folded, origin = [], []
    for n, char in enumerate(text):
        if _INVISIBLE.match(char):
            continue
        for c in fold(char):
            folded.append(c)
            origin.append(n)
    begin = end = 0
    for n, found in enumerate(_WORD.finditer("".join(folded))):
        if n == first:
            begin = origin[found.start()]
        if n == last:
            end = origin[found.end() - 1] + 1
            break
    return begin, end


_built: dict[int, Matcher] = {}


def _matcher(held, rules: Rules) -> Matcher:
    """The matcher of broadcast items, built once in each worker."""
    key = hash((held._path if hasattr(held, "_path") else id(held), rules))
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(held.value, rules)
    return _built[key]


def leaked_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Rows (id, item_id, share, start, end, kind, answer_seen): the items of which a document holds a passage.

    kind "passage": at least `share` of the passage's words stand in the
    document in their order, in one or two stretches of `least_words` words or
    more; case, accents, punctuation and spacing don't count, and a stretch may
    have gaps of up to `gap` words, 1-`density` of it in all. kind "answer":
    the whole of a passage of fewer than `least_words` words, word for word,
    with its answer within `answer_gap` words behind it. start and end are
    offsets in the original text; answer_seen tells whether the answer stands
    anywhere in the document. Words that all items of a suite start with are an
    instruction and count for nothing; `unsearchable` names the items that
    cannot be found.

    Null and empty texts hold nothing, and items without text are never held;
    a row comes out for each input row that leaks, once for each item; of an
    item given several times the greatest row counts; other columns are
    ignored; empty tables give no rows. The items (of checked size) are
    broadcast; the plan is one scan without a shuffle.
    """
    held = df.sparkSession.sparkContext.broadcast(_items(items))
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = chosen.schema["id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        matcher = _matcher(held, rules)
        for batch in batches:
            at, found = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                for one in matcher.found(text) if text else ():
                    at.append(n)
                    found.append(one)
            if found:
                kinds = (None, pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=["id", "item_id", "share", "start", "end", "kind", "answer_seen"])

    schema = f"id {id_type}, item_id {item_type}, share double, start int, end int, kind string, answer_seen boolean"
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _items(items: DataFrame) -> list[dict]:
    """One row an item; their size is checked before they are collected."""
    rows = items.select("item_id", "suite", "text", "answer").filter("item_id is not null")
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))), F.lit(0))).first()[0]
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"{size} characters of evaluation items; at most {MAX_ITEM_CHARS} are broadcast")
    one = rows.groupBy("item_id").agg(F.max(F.struct("text", "suite", "answer")).alias("i")).select("item_id", "i.*")
    return [row.asDict() for row in one.collect()]


def unsearchable(items: DataFrame, rules: Rules = Rules()) -> list:
    """The ids of items that `leaked_items` cannot find: without text, or with a short passage and no answer."""
    known = _items(items)
    matcher = Matcher(known, rules)
    return sorted(item["item_id"] for item in known if item["item_id"] not in matcher.passages and item["item_id"] not in matcher.whole)
