"""Boilerplate lines of web pages, by nearest-URL page differencing.

Problem 2. Within each host pages are put in the order of their URL paths and
each is paired with the pages next to it. The lines of a pair are aligned by
their longest common subsequence; aligned lines are shared by the site's pages
and are deleted wherever the site shows them. Lines that no other page shares
but that stand in the gap below a deleted heading are entries of its list and
go with it. Markup, where present, only vetoes: what most of a site's pages
hold in their bodies is kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .lines import DATE, key_of, line_words, node_sites

#: Where a line stands, by the markup: in the body, in the page's frame, or in it as an item that is a link. UNKNOWN where there is no markup or the line isn't in it.
UNKNOWN, BODY, FRAME, ENTRY = -1, 0, 1, 2
#: Lines of so many words without a full stop may be entries of a list of pages, or a page's title.
ENTRY_WORDS = 6
#: Lines of so many words with a full stop are sentences, which make up a body.
SENTENCE_WORDS = 8
#: Pages on which a line must stand to be deleted where it may be a page's title.
TITLE_PAGES = 4
#: What a line may be by its text: a byline or other line with a date, a sentence, an entry or title, the page's title, or none of these.
PLAIN, DATED, SENTENCE, OPEN, TITLE = 0, 1, 2, 3, 4
#: Parts of the URL order at most, and pages sampled for each border.
MAX_PARTS, BORDER_SAMPLE = 8192, 20

_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]*)""", re.I)
_HREF = re.compile(r"\bhref\b", re.I)
#: Elements that set a line of their own, and elements and class names of a page's frame.
BLOCKS = frozenset("address article aside blockquote body button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section small table tbody td tfoot th thead title tr ul".split())
FRAME_TAGS = frozenset("nav aside footer dialog menu".split())
FRAME_NAMES = frozenset("banner bottom breadcrumb breadcrumbs complementary consent contentinfo cookie cookie-bar cookies copyright footer menu nav navbar navigation popup rail related side sidebar site-footer site-header toolbar widget".split())
_VOID = frozenset("br hr img input meta link wbr source area col".split())
_HEADS = frozenset("h2 h3 h4 h5 h6".split())
_STOP = re.compile(r"[.!?;:…][\"'”»)\s]*$")


class _Element:
    __slots__ = ("tag", "frame", "up", "texts", "links", "button", "only", "children", "kept")

    def __init__(self, tag: str, frame: bool, up: _Element | None):
        self.tag, self.frame, self.up = tag, frame, up
        self.texts: list[int] = []
        self.links = self.kept = 0
        self.button = False
        self.only: str | None = None
        self.children = 0


def zones(markup: str) -> dict[int, int]:
    """For the key of each block of text in the markup: where it stands."""
    markup = _DROP.sub(" ", markup)
    root = _Element("root", False, None)
    here, blocks = root, []  # a block: [text, element, linked characters]
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((html.unescape(text), here, linked))
        parts, linked = [], 0

    at = 0
    for found in _TAG.finditer(markup):
        text = markup[at : found.start()]
        at = found.end()
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        close, tag, rest = found.group(1), found.group(2).lower(), found.group(3)
        if tag == "a":
            in_link = not close and bool(_HREF.search(rest))
        elif tag == "br":
            flush()
        elif tag in BLOCKS or tag == "span":
            flush()
            if close:
                up = here
                while up is not None and up.tag != tag:
                    up = up.up
                if up is not None and up.up is not None:
                    here = up.up
            elif tag not in _VOID:
                if tag in ("p", "li", "td", "tr", "dt", "dd", "h1", "h2", "h3", "h4") and here.tag in (tag, "p", "span"):
                    here = here.up or root
                names = _CLASS.findall(rest) if rest else ()
                frame = here.frame or tag in FRAME_TAGS or any(name.lower() in FRAME_NAMES for value in names for name in value.split())
                here.children += 1
                here.only = tag if here.children == 1 else None
                here = _Element(tag, frame, here)
                if tag == "button" and here.up is not None:
                    here.up.button = True
    parts.append(markup[at:])
    flush()

    # Items that are links are entries; a menu may come out as one line of all its entries.
    out: dict[int, int] = {}
    menu: list[str] = []
    previous: tuple[int, _Element] | None = None
    for text, element, in_links in blocks:
        words = line_words(text)
        key = key_of(words)
        if element.tag == "li" and in_links > 0 and in_links >= 0.8 * len(text.replace(" ", "")):
            if not menu and previous is not None and _heads(previous[1], element):
                out[previous[0]] = FRAME
            menu += words
            if key:
                out[key] = ENTRY
            continue
        if menu:
            out[key_of(menu)] = FRAME
            menu = []
        if key and element.tag != "title" and key not in out:
            up = element.up
            consent = element.button or (up is not None and up.button and up.tag != "body") or element.tag == "button"
            # A block that holds nothing but small print.
            fine = element.tag == "small" and up is not None and up.tag == "div" and up.only == "small" and not _beside(up)
            out[key] = FRAME if element.frame or consent or fine else BODY
        previous = (key, element)
    if menu:
        out[key_of(menu)] = FRAME
    return out


def _heads(element: _Element, item: _Element) -> bool:
    """Whether an element's text stands right above the list of an item as its heading, whatever tag it has."""
    holder = item.up.up if item.up is not None else None
    if holder is None or element.tag in ("h1", "title"):
        return False
    return element is holder or element.up is holder and (element.tag in _HEADS or holder.tag not in ("body", "html", "root"))


def _beside(element: _Element) -> bool:
    return element.children > 1


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of two key lists; 0 matches nothing."""
    common = set(a).intersection(b)
    common.discard(0)
    if not common:
        return []
    left, right = [i for i, key in enumerate(a) if key in common], [j for j, key in enumerate(b) if key in common]
    if len(left) == len(right) and all(a[i] == b[j] for i, j in zip(left, right, strict=True)):
        return list(zip(left, right, strict=True))
    places: dict[int, list[int]] = {}
    for j in right:
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple[int, int, tuple | None]] = []
    for i in left:
        for j in reversed(places[a[i]]):
            k = bisect_left(tails, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k] = j
                links[k] = link
    out = []
    link = links[-1] if links else None
    while link is not None:
        out.append((link[0], link[1]))
        link = link[2]
    return out[::-1]


class _Lines:
    """The lines of one page: keys, zones, whether each is a sentence or may be a title, and the lines above the gap in which it stands."""

    __slots__ = ("keys", "zones", "kinds", "heads", "firsts")

    def __init__(self, text: str, known: dict[int, int] | None):
        self.keys: list[int] = []
        self.zones: list[int] = []
        self.kinds: list[int] = []
        for line in text.split("\n"):
            words = line_words(line)
            key = key_of(words)
            zone = known.get(key, UNKNOWN) if known is not None and key else UNKNOWN
            stop = bool(_STOP.search(line))
            kind = PLAIN
            if DATE in words:
                kind = DATED
            elif stop and len(words) >= SENTENCE_WORDS:
                kind = SENTENCE
            elif not stop and len(words) >= ENTRY_WORDS:
                kind = OPEN
            self.keys.append(key)
            self.zones.append(zone)
            self.kinds.append(kind)
        self.heads, self.firsts = [0] * len(self.keys), [0] * len(self.keys)
        self._gaps()

    def _gaps(self) -> None:
        """Runs of lines that may be entries, each with the line above it and its own first line, either of which may be the heading."""
        last, titled = 0, False
        run: list[int] = []
        for n, (key, zone, kind) in enumerate(zip(self.keys, self.zones, self.kinds, strict=True)):
            if not key:
                continue
            if zone == ENTRY or (zone != BODY and kind == OPEN):
                if not run:
                    above = last
                run.append(n)
                self.heads[n] = above
                self.firsts[n] = self.keys[run[0]] if len(run) > 1 else 0
            else:
                # The first run that a byline or a sentence follows ends in the page's title.
                if run and not titled and zone == UNKNOWN and kind in (DATED, SENTENCE) and self.zones[run[-1]] == UNKNOWN:
                    titled = True
                    self.kinds[run[-1]] = TITLE
                    self.heads[run[-1]] = self.firsts[run[-1]] = 0
                run = []
            last = key


def page_lines(df: DataFrame, id_col: str, node_col: str, text_col: str, html_col: str | None, order_col: str) -> DataFrame:
    """One row (id, node, keys, zones, kinds, heads, firsts) for each id, of its last delivery."""
    markup = F.col(html_col) if html_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(node_col).alias("node"), F.col(text_col).alias("text"), markup.alias("markup"), F.col(order_col).cast("timestamp").alias("at")).filter("id is not null and text is not null")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, node {rows.schema['node'].dataType.simpleString()}, at timestamp, keys array<long>, zones array<byte>, kinds array<byte>, heads array<long>, firsts array<long>"
    fields = {"keys": pa.int64(), "zones": pa.int8(), "kinds": pa.int8(), "heads": pa.int64(), "firsts": pa.int64()}

    def run(batches):
        for batch in batches:
            pages = [_Lines(text, zones(markup) if markup else None) for text, markup in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            arrays = [pa.array([getattr(page, name) for page in pages], pa.list_(kind)) for name, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *arrays], names=["id", "node", "at", *fields])

    lined = rows.mapInArrow(run, schema)
    return lined.groupBy("id").agg(F.max_by(F.struct("node", *fields), F.struct("at", F.xxhash64("keys"))).alias("last")).select("id", "last.*")


def url_order(pages: DataFrame, neighbours: int, parts: int | None = None) -> DataFrame:
    """`pages` (s, path, id, ...) in parts of their URL order: b, the part, and carried, whether a row stands there as one of the `neighbours` rows before the part.

    The borders of the parts come from a sample of at most MAX_PARTS *
    BORDER_SAMPLE rows; where they fall has no influence on which rows are
    neighbours, since each part gets the last rows of those before it.
    """
    spark = pages.sparkSession
    total = pages.count()
    parts = max(1, min(MAX_PARTS, parts or int(spark.conf.get("spark.sql.shuffle.partitions")), total // max(1, neighbours)))
    order = ["s", "path", "id"]
    share = min(1.0, 1.5 * parts * BORDER_SAMPLE / max(1, total))
    some = pages.select(*order).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * MAX_PARTS * BORDER_SAMPLE)
    sample = sorted(tuple(row) for row in some.collect())
    borders = [sample[len(sample) * n // parts] for n in range(1, parts)] if sample else []

    @F.pandas_udf("int")
    def part_of(s: pd.Series, path: pd.Series, row_id: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, at) for at in zip(s, path, row_id, strict=True)], dtype="int32")

    placed = pages.withColumn("b", part_of(*order))
    # Of each part its last rows; the limit on the rank is applied before the shuffle.
    back = Window.partitionBy("b").orderBy(*[F.col(c).desc() for c in order])
    tails = cut(placed.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= neighbours))
    held = {row["b"]: row["n"] for row in tails.groupBy("b").agg(F.count("*").alias("n")).collect()}
    targets, filled = [], sorted(held)
    for n, b in enumerate(filled):
        room = neighbours
        for before in reversed(filled[:n]):
            if room <= 0:
                break
            targets.append((before, b, room))
            room -= held[before]
    known = spark.createDataFrame(targets, "b int, c int, room int")
    carried = tails.join(F.broadcast(known), "b").filter("r <= room").drop("b", "r", "room").withColumnRenamed("c", "b")
    both = placed.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("carried", F.lit(True)))
    return both.repartition(parts, "b").sortWithinPartitions("b", *order)


def shared_lines(pages: DataFrame, neighbours: int, parts: int | None = None) -> DataFrame:
    """Distinct (s, key) of the lines of `pages` (s, path, id, node, keys, zones, kinds) that align with a page next to theirs.

    Pages are ordered by site and path over the whole cluster and cut in
    parts, so that a site that holds a third of all pages is cut as well; each
    page is held against the `neighbours` pages before it, across the parts'
    borders too. Versions of one article are not differenced: pages of one
    node, and pages that have two titles or sentences of their bodies and more
    than half of the shorter body's in common.
    """

    def body_of(row) -> set[int]:
        return {key for key, zone, kind in zip(row["keys"], row["zones"], row["kinds"], strict=True) if kind in (SENTENCE, TITLE) and zone in (BODY, UNKNOWN) or kind == OPEN and zone == BODY}

    def run(batches):
        window: list[dict] = []
        found: set[tuple[int, int]] = set()
        part = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["b"] != part:
                    window, part = [], row["b"]
                if window and window[-1]["s"] != row["s"]:
                    window = []
                row["body"] = body_of(row)
                if not row["carried"]:
                    for other in window:
                        if other["node"] == row["node"]:
                            continue
                        same = len(row["body"] & other["body"])
                        if same >= 2 and same > 0.5 * min(len(row["body"]), len(other["body"])):
                            continue
                        s = row["s"]
                        found.update((s, row["keys"][j]) for _, j in aligned(other["keys"], row["keys"]))
                window.append(row)
                if len(window) > neighbours:
                    window.pop(0)
            if len(found) > 100_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    def _pairs(found):
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([key for _, key in found], pa.int64())], names=["s", "key"])

    chosen = pages.select("s", "path", "id", "node", "keys", "zones", "kinds")
    return url_order(chosen, neighbours, parts).mapInArrow(run, "s long, key long").distinct()


def boilerplate_lines(
    df: DataFrame,
    nodes: DataFrame,
    neighbours: int = 8,
    id_col: str = "id",
    node_col: str = "url_node_id",
    text_col: str = "content_text",
    html_col: str | None = "content_html",
    order_col: str = "created_at",
    parts: int | None = None,
) -> DataFrame:
    """Rows (id, line_no) of the lines that are not part of a page's main body.

    Lines are split at line feeds and numbered from 0, blank ones too; lines
    without a word never come out. Lines that align with one of the
    `neighbours` pages before or after in URL order are deleted on all pages of
    the site, unless the markup of its pages has them in the body at least as
    often as outside (of all sites' pages where the site's have none). A
    deleted line is the heading of a list if on half of its pages or more lines
    that may be entries (links in the markup, else of ENTRY_WORDS words or more
    without a stop or date) stand between it and the next other line; those are
    deleted with it. On the page itself a line that the markup has in the body
    always stays.

    Null texts, null ids and pages without a known site take no part; empty
    texts and tables give no rows; of an id delivered several times the last by
    `order_col` counts, then the one of the greatest line hash; other columns
    are ignored. Without markup (null, or html_col=None) the differencing
    decides alone, as it does for lines that the markup does not hold. `parts`
    is the number of tasks for the alignment and has no influence on the rows.
    """
    path = F.regexp_replace(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "").alias("path")
    docs = page_lines(df, id_col, node_col, text_col, html_col, order_col)
    located = docs.join(node_sites(nodes, "id", "domain", path), "node").filter("site is not null").withColumn("s", F.xxhash64("site"))
    pages = cut(located.select("s", F.coalesce("path", F.lit("")).alias("path"), "id", "node", "keys", "zones", "kinds", "heads", "firsts"))
    shared = shared_lines(pages, neighbours, parts)

    each = F.posexplode(F.arrays_zip("keys", "zones", "kinds", "heads", "firsts")).alias("line_no", "l")
    lines = pages.select("s", "id", each).select("s", "id", "line_no", F.col("l.keys").alias("key"), F.col("l.zones").alias("zone"), F.col("l.kinds").alias("kind"), F.col("l.heads").alias("head"), F.col("l.firsts").alias("first")).filter("key <> 0")
    # An entry names another page, whose title it may be; it has no vote on where that line stands.
    title = (F.col("zone") == ENTRY) & (F.col("kind") == OPEN)
    votes = [F.count_if(F.col("zone") == BODY).alias("body"), F.count_if(F.col("zone").isin(FRAME, ENTRY)).alias("frame"), F.count("*").alias("lines")]
    own = cut(lines.filter(~title).groupBy("s", "key").agg(*votes))
    everywhere = own.groupBy("key").agg(F.sum("body").alias("body_all"), F.sum("frame").alias("frame_all"))
    kept = F.when(F.col("body") + F.col("frame") > 0, F.col("body") >= F.col("frame")).otherwise(F.col("body_all") > F.col("frame_all"))
    deleted = own.join(shared, ["s", "key"]).join(everywhere, "key").filter(~kept).select("s", "key", "lines")

    # On how many of its pages a line has entries below it.
    opened = F.array_distinct(F.filter(F.concat("heads", "firsts"), lambda k: k != 0))
    opens = pages.select("s", F.explode(opened).alias("key")).groupBy("s", "key").agg(F.count("*").alias("opened"))
    deleted = cut(deleted.join(opens, ["s", "key"], "left").select("s", "key", "lines", (2 * F.coalesce("opened", F.lit(0)) >= F.col("lines")).alias("listed")))

    outside = lines.filter(F.col("zone") != BODY).join(deleted, ["s", "key"]).filter((F.col("kind") != TITLE) | (F.col("lines") >= TITLE_PAGES)).select("id", "line_no")
    listed = deleted.filter("listed").select("s", "key")
    entries = lines.filter(F.col("zone") != BODY).select("s", "id", "line_no", F.explode(F.array("head", "first")).alias("key")).filter("key <> 0")
    under = entries.join(listed, ["s", "key"], "left_semi").select("id", "line_no")
    return outside.unionByName(under).distinct().withColumnRenamed("id", id_col)
