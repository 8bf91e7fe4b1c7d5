"""Lines that one site repeats on many pages.

Problem 6. Deliveries and near-duplicate documents are collapsed first; each
line is then counted over the distinct pages, document clusters and publication
dates on which its site shows it, so that a republished article, edited or not,
can be told from boilerplate.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import oddsketch
from .lines import DATE, key_of, line_words, node_sites

#: Lines with a date and at most so many words may be bylines, in which names are filled in.
BYLINE_WORDS = 14
#: Words of a filled-in name at most.
NAME_WORDS = 4


def document_lines(df: DataFrame, id_col: str, node_col: str, text_col: str, order_col: str, date_col: str) -> DataFrame:
    """One row (id, node, date, own, keys, dated) for each id, of its last delivery.

    keys holds one key a line, 0 for lines without a word; dated the words of
    lines that may be bylines; own is equal for equal texts.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(node_col).alias("node"), F.col(text_col).alias("text"), F.col(order_col).cast("timestamp").alias("at"), F.to_date(date_col).alias("date")).filter("id is not null and text is not null")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, node {rows.schema['node'].dataType.simpleString()}, at timestamp, date date, own long, keys array<long>, dated array<struct<line:int,words:array<string>>>"
    dated_type = pa.list_(pa.struct([("line", pa.int32()), ("words", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            clusters, keys, dated = [], [], []
            for text in batch.column(2).to_pylist():
                own, some = [], []
                for at, line in enumerate(text.split("\n")):
                    words = line_words(line)
                    own.append(key_of(words))
                    if DATE in words and len(words) <= BYLINE_WORDS:
                        some.append({"line": at, "words": words})
                keys.append(own)
                dated.append(some)
                clusters.append(key_of([str(k) for k in own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(clusters, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(dated, dated_type)],
                names=["id", "node", "at", "date", "own", "keys", "dated"],
            )

    lined = rows.mapInArrow(run, schema)
    last = F.max_by(F.struct("node", "date", "own", "keys", "dated"), F.struct("at", "own")).alias("last")
    return lined.groupBy("id").agg(last).select("id", "last.*")


def byline_frames(dated: DataFrame) -> DataFrame:
    """One row (s, words, frame) for each distinct line of a site in (s, words), words joined by spaces.

    A frame is the line with up to NAME_WORDS words in a row taken out, where
    the site fills other words into the same place. Of a line's frames the one
    of most fillings counts, and of those the one with most words left; a frame
    of marks alone only if it has more than twice the fillings of each other.
    Where one word is taken out, or no word is left, two fillings may be two
    wordings of a notice, so three are asked for. A line without such a frame is its own. Other sites
    have no influence.
    """
    lines = dated.select("s", "words").distinct()
    spans = """
        filter(flatten(transform(sequence(1, size(ws)), i -> transform(sequence(1, least({most}, size(ws) - i + 1)), l -> struct(
            l AS taken, slice(ws, i, l) AS span, concat(slice(ws, 1, i - 1), slice(ws, i + l, size(ws))) AS rest,
            concat_ws(' ', slice(ws, 1, i - 1), array('%name'), slice(ws, i + l, size(ws))) AS frame)))), x -> not exists(x.span, w -> startswith(w, '%')))"""
    each = lines.withColumn("ws", F.split("words", " ")).select("s", "words", F.explode(F.expr(spans.format(most=NAME_WORDS))).alias("x"))
    each = each.select("s", "words", "x.taken", "x.frame", F.expr("exists(x.rest, w -> not startswith(w, '%'))").alias("fixed"))
    # A frame and its filling make up the line, so that lines are fillings.
    fillings = each.groupBy("s", "frame").agg(F.count("*").alias("n"), F.max(F.when(F.col("fixed"), F.col("taken"))).alias("longest"))
    fillings = fillings.filter((F.col("n") >= 3) | (F.col("n") == 2) & (F.col("longest") > 1)).drop("longest")
    order = F.struct(F.when(F.col("fixed"), 2 * F.col("n")).otherwise(F.col("n")), F.col("n"), -F.col("taken"), F.col("frame"))
    best = each.join(fillings, ["s", "frame"]).groupBy("s", "words").agg(F.max_by("frame", order).alias("frame"))
    return lines.join(best, ["s", "words"], "left").select("s", "words", F.coalesce("frame", "words").alias("frame"))


def repeated_lines(
    df: DataFrame,
    nodes: DataFrame,
    min_pages: int = 8,
    min_texts: int = 1,
    min_dates: int = 1,
    id_col: str = "id",
    node_col: str = "url_node_id",
    text_col: str = "content_text",
    order_col: str = "created_at",
    date_col: str = "fetched_at",
) -> DataFrame:
    """Rows (id, line_no, pages, texts, dates) of every line that its site shows on at least `min_pages` pages.

    Lines are split at line feeds and numbered from 0, blank ones too. They are
    the same up to letter case, accents, spacing, punctuation and the dates,
    numbers and addresses in them, and in short lines with a date up to the
    names filled in, which `byline_frames` tells inside each site. `min_texts` and `min_dates` demand as many document clusters and
    publication dates: with 2 or more, an article republished with small edits
    is not taken for boilerplate. Clusters are the classes of
    `oddsketch.near_duplicate_classes` (five words, a similarity of 0.8); a text
    too short for these is in one with its equals. All three are counted exactly.

    Null texts, null ids and pages without a known site take no part; empty
    texts and tables give no rows; of an id delivered several times the last by
    `order_col` counts; other columns are ignored. A site or line that holds a
    third of all rows is counted in partial aggregates.
    """
    docs = cut(document_lines(df, id_col, node_col, text_col, order_col, date_col))
    classes = oddsketch.near_duplicate_classes(df, id_col, text_col, order_col).select(F.col(id_col).alias("id"), F.xxhash64("class_id").alias("cluster"))
    docs = docs.join(classes, "id", "left").withColumn("cluster", F.coalesce("cluster", "own"))
    docs = docs.join(node_sites(nodes), "node").filter("site is not null").withColumn("s", F.xxhash64("site"))
    lines = docs.select("s", "id", "node", "cluster", "date", F.posexplode("keys").alias("line_no", "key"), F.transform("dated", lambda d: d["line"]).alias("named"))
    plain = lines.filter("key <> 0 and not array_contains(named, line_no)").drop("named")
    dated = docs.select("s", "id", "node", "cluster", "date", F.explode("dated").alias("d")).select("s", "id", "node", "cluster", "date", F.col("d.line").alias("line_no"), F.concat_ws(" ", "d.words").alias("words"))
    named = dated.join(byline_frames(dated), ["s", "words"]).withColumn("key", F.xxhash64("frame")).drop("words", "frame")
    rows = cut(plain.select("s", "id", "node", "cluster", "date", "line_no", "key").unionByName(named))
    pages = rows.groupBy("s", "key", "node").agg(F.min("cluster").alias("cluster"), F.min("date").alias("date"))
    counts = [F.count("*").alias("pages"), F.countDistinct("cluster").alias("texts"), F.countDistinct("date").alias("dates")]
    often = (F.col("pages") >= min_pages) & (F.col("texts") >= min_texts) & (F.col("dates") >= min_dates)
    hits = pages.groupBy("s", "key").agg(*counts).filter(often)
    return rows.select("s", "key", "id", "line_no").join(hits, ["s", "key"]).drop("s", "key").withColumnRenamed("id", id_col)


def without_lines(df: DataFrame, lines: DataFrame, id_col: str = "id", text_col: str = "content_text") -> DataFrame:
    """`df` with the lines (id, line_no) taken out of `text_col`; rows without such lines stay as they are."""
    gone = lines.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    joined = df.join(gone, df[id_col] == gone["_id"], "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).drop("_id", "_gone")
