"""Graph operators over an edge relation (src, dst). Loops cut their lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Rounds between two cuts of the lineage.
EVERY = 5


def both_ways(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow: out as they are, in reversed, both in both directions."""
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": edges.select("src", "dst"), "in": reverse, "both": edges.select("src", "dst").unionByName(reverse)}[direction].distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Rows (node, depth) within `depth` steps of any start (column node); starts are always there, at 0.

    Each round joins the frontier with the edges and takes out what was seen.
    """
    follow = cut(both_ways(edges, direction))
    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, depth + 1):
        new = frontier.select(F.col("node").alias("src")).join(follow, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (node, out_degree, in_degree) of all end points; parallel edges count."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def in_degree_signal(degree: Column) -> Column:
    """1 / (60 + 100 / in-degree); 0 for none."""
    return F.when(degree > 0, 1 / (60 + 100 / degree)).otherwise(F.lit(0.0))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, weight: str | None = None, dangling: bool = False, warm: DataFrame | None = None) -> DataFrame:
    """Rows (node, score). Every node starts at (1-d)/N and only nodes with in-edges change.

    Parallel edges count each; with `weight` a column of `edges` shares a
    node's score out instead. Where a node's weights add up to 0 its shares are
    those of IEEE division, as in SQL: NaN for an edge of weight 0, else an
    infinity. All that it leads to within `iterations` steps then has no finite
    score, with `dangling` too. `dangling` spreads the score of nodes without
    out-edges over all. `warm` (node, score) gives starting scores; nodes that
    vanished are dropped.
    """
    known = cut(nodes.select("node").distinct().withColumn("id", F.monotonically_increasing_id()))
    n = known.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    base = (1 - damping) / n
    # The rounds move numbers in place of the nodes. Shares are of all edges of a node, but only edges between nodes carry a score.
    kept = edges.join(known.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").select("s", "dst", *([weight] if weight else []))
    kept = kept.join(known.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst", "left")
    share = F.sum(weight) if weight else F.count("*").cast("double")
    merged = cut(kept.groupBy("s", "d").agg(share.alias("w")))
    out = merged.groupBy("s").agg(F.sum("w").alias("out"))
    # Division by 0 is an error in Spark's ANSI mode and null outside it.
    part = F.when(F.col("out") == 0, F.col("w") * F.lit(float("inf"))).otherwise(F.col("w") / F.col("out"))
    links = cut(merged.filter("d is not null").join(out, "s").select("s", "d", part.alias("p")))
    sources = cut(out.select(F.col("s").alias("id"))) if dangling else None
    targets = links.select(F.col("d").alias("id")).distinct()
    if warm is None:
        score = known.select("id", F.lit(base).alias("score"))
        still = cut(score.join(targets, "id", "left_anti"))
    else:
        score = cut(known.join(warm.select("node", "score"), "node", "left").select("id", F.coalesce("score", F.lit(base)).alias("score")))
        fed = known.join(edges.select(F.col("dst").alias("node")), "node", "left_semi").select("id", F.lit(base).alias("b"))
        still = cut(score.join(targets, "id", "left_anti").join(fed, "id", "left").select("id", F.coalesce("b", "score").alias("score")))
    for i in range(max(1, iterations)):
        flow = score.join(links, score["id"] == links["s"]).groupBy("d").agg(F.sum(F.col("score") * F.col("p")).alias("in"))
        spread = 0.0
        if dangling:
            lost = score.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
            spread = damping * lost / n
        moved = flow.select(F.col("d").alias("id"), (F.lit(base + spread) + damping * F.col("in")).alias("score"))
        score = moved.unionByName(still if not dangling else still.select("id", F.lit(base + spread).alias("score")))
        if i % EVERY == EVERY - 1:
            score = cut(score)
    return known.join(score, "id").select("node", "score")


def affected(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """Nodes (column node) whose rank a change of `changed` can reach within `depth` steps along the edges."""
    return bfs(edges, changed, depth, "out").select("node")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the least node of each connected component, by alternating large and small stars.

    Each round halves distances at least, so long chains take few rounds.
    """
    links = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = cut(links)
    while True:
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small)
        if after.count() == links.count() and after.join(links, ["u", "v"], "left_anti").isEmpty():
            links = after
            break
        links = after
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return ends.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the greatest node of each strongly connected component.

    In each round the greatest node spreads forward as colour; what reaches its
    colour's node backwards within the colour is one component and leaves.
    """
    left = cut(edges.select("src", "dst").distinct())
    ends = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
    nodes, done = cut(ends), None
    while not nodes.isEmpty():
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            sent = left.join(colour, left["src"] == colour["node"]).select(F.col("dst").alias("node"), "colour")
            new = cut(colour.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")))
            changed = not new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if not changed:
                break
        within = cut(left.join(colour.toDF("src", "c1"), "src").join(colour.toDF("dst", "c2"), "dst").filter("c1 = c2").select("src", "dst", "c1"))
        found = cut(colour.filter("node = colour"))
        frontier = found
        while not frontier.isEmpty():
            back = within.join(frontier, (within["dst"] == frontier["node"]) & (within["c1"] == frontier["colour"])).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(back.join(found, "node", "left_anti"))
            found = found.unionByName(frontier)
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        nodes = cut(nodes.join(found, "node", "left_anti"))
        left = cut(left.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))
    return (done if done is not None else nodes.withColumn("colour", F.col("node"))).select("node", F.col("colour").alias("component"))


def topological_levels(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Rows (node, level): the longest path that leads to each node; a cycle is an error."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    done = None
    for level in range(most_rounds):
        if nodes.isEmpty():
            return done if done is not None else nodes.withColumn("level", F.lit(0))
        free = cut(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        here = free.withColumn("level", F.lit(level))
        done = here if done is None else done.unionByName(here)
        nodes = cut(nodes.join(free, "node", "left_anti"))
        left = cut(left.join(free.toDF("src"), "src", "left_anti"))
    raise ValueError(f"more than {most_rounds} levels")


def shortest_paths(edges: DataFrame, start, weight: str = "weight", most_rounds: int = 1000) -> DataFrame:
    """Rows (node, distance, path) from `start` over edges of non-negative weight; equal distances take the smaller path.

    Only nodes that got nearer in a round are followed in the next.
    """
    links = cut(edges.select("src", "dst", F.col(weight).cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    spark = edges.sparkSession
    first = spark.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("node"), F.lit(0.0).alias("distance"))
    best = cut(first.withColumn("path", F.array("node")))
    frontier = best
    for _ in range(most_rounds):
        step = frontier.join(links, frontier["node"] == links["src"]).filter(~F.array_contains("path", F.col("dst")))
        offers = step.select(F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
        offers = offers.groupBy("node").agg(F.min(F.struct("distance", "path")).alias("o"))
        better = offers.join(best.select("node", F.struct("distance", "path").alias("b")), "node", "left").filter("b is null or o < b")
        frontier = cut(better.select("node", F.col("o.distance").alias("distance"), F.col("o.path").alias("path")))
        if frontier.isEmpty():
            return best
        best = cut(best.join(frontier, "node", "left_anti").unionByName(frontier))
    raise ValueError(f"not settled after {most_rounds} rounds")


def summary(nodes: DataFrame, edges: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Rows (domain, pages, out_links, in_links) over nodes (node, domain) and edges."""
    by = nodes.select("node", F.col(domain_col).alias("domain"))
    pages = by.groupBy("domain").agg(F.count("*").alias("pages"))
    out = edges.join(by.toDF("src", "domain"), "src").groupBy("domain").agg(F.count("*").alias("out_links"))
    into = edges.join(by.toDF("dst", "domain"), "dst").groupBy("domain").agg(F.count("*").alias("in_links"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return pages.join(out, "domain", "left").join(into, "domain", "left").select("domain", "pages", zero("out_links"), zero("in_links"))


def anchor_texts(edges: DataFrame, text_col: str = "anchor_text") -> DataFrame:
    """Rows (node, anchors, inbound): distinct non-empty anchor texts of each target in order, and its in-edges."""
    some = F.when(F.trim(text_col) != "", F.trim(text_col))
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set(some)), " ").alias("anchors"), F.count("*").alias("inbound"))


def cooccurrence(rows: DataFrame, group_col: str, item_col: str, position_col: str, window: int) -> DataFrame:
    """Rows (src, dst, weight): how often two items stand within `window` positions of each other in a group, src first."""
    a = rows.select(F.col(group_col).alias("g"), F.col(item_col).alias("src"), F.col(position_col).alias("p"))
    # Positions fall in buckets of the window's size, so each meets its own and the next bucket only.
    left = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("p") / window), F.floor(F.col("p") / window) + 1)))
    right = a.select("g", F.col("src").alias("dst"), F.col("p").alias("q"), F.floor(F.col("p") / window).alias("bucket"))
    near = left.join(right, ["g", "bucket"]).filter((F.col("q") > F.col("p")) & (F.col("q") - F.col("p") <= window) & (F.col("src") != F.col("dst")))
    return near.groupBy("src", "dst").agg(F.count("*").alias("weight"))
