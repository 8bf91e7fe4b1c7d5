"""The k most similar vectors of every vector, by an inverted multi-index.

Problem 3. The two halves of each unit vector are quantised separately, so K
centroids a half give K*K cells. Every query walks centroid pairs in order of
summed distance with a heap until the cells it has met hold enough vectors;
those vectors are reranked by exact cosine. A cell that holds far more than its
share is split by a second multi-index over the residuals of its vectors, which
the walk enters when it meets the cell. Near cells make up groups, and a query
is sent once to each group that it meets.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Bytes of codebooks, counts and groups that are broadcast at most.
MAX_INDEX_BYTES = 256 << 20
#: A cell of so many times its share of vectors is split.
HOT_SHARES = 16
#: Rows of the probes' matrix product at once.
PROBE_ROWS = 512


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """One row (id, unit) for each id with a usable vector, unit as float32 bytes.

    Unusable are null vectors, those of another length, with null, NaN or
    infinite numbers, or all zero. Of an id's usable vectors the least (as an
    array) counts, so repeated rows change nothing. Null ids take no part.
    """
    raw = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0)
    usable = raw.filter(F.col("id").isNotNull() & (F.size("v") == dims) & ~bad & some)
    one = usable.groupBy("id").agg(F.min("v").alias("v"))
    id_type = one.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dims)
            scale = np.abs(x).max(axis=1, keepdims=True)
            x = x / scale
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            # Equal directions at different lengths must give equal bytes.
            x = np.round(x, 7).astype(np.float32) + np.float32(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["id", "unit"])

    return one.mapInArrow(run, f"id {id_type}, unit binary")


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        empty = np.flatnonzero(~filled)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    norms = (centres * centres).sum(axis=1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        out[at : at + 4096] = (norms - 2 * part @ centres.T).argmin(axis=1)
    return out


def some_units(entries: DataFrame, total: int, rows: int) -> pa.Table:
    """At most `rows` of `total` vectors (column unit), chosen by their hashes; each partition sends its share only."""
    share = min(1.0, 1.1 * rows / max(1, total))
    chosen = entries.select("unit").filter(F.pmod(F.xxhash64("unit", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    return chosen.limit(rows).toArrow()


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


class Grid:
    """Codebooks of both halves and the number of rows in each of their cells."""

    def __init__(self, x: np.ndarray, k: int, rounds: int = 12, seed: int = 7):
        self.half = x.shape[1] // 2
        if not len(x):
            self.first, self.second = np.zeros((1, self.half), np.float32), np.zeros((1, x.shape[1] - self.half), np.float32)
        else:
            self.first, self.second = _kmeans(x[:, : self.half], k, rounds, seed), _kmeans(x[:, self.half :], k, rounds, seed + 1)
        self.filled: dict[int, int] = {}

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def centre(self, cells: np.ndarray) -> np.ndarray:
        """The centroid pair of each cell."""
        return np.hstack([self.first[cells // len(self.second)], self.second[cells % len(self.second)]])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)

    def nbytes(self) -> int:
        return self.first.nbytes + self.second.nbytes + 100 * len(self.filled)


def walk(first: np.ndarray, second: np.ndarray, filled: dict[int, int], width: int):
    """Filled cells in order of summed half distance, each with its rows.

    `first` and `second` are the distances to the centroids of either half, and
    `filled` gives the rows of each cell that has any.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(da[0] + db[0], 0, 0)]
    seen = {(0, 0)}
    left = len(filled)
    while heap and left:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        n = filled.get(cell)
        if n:
            left -= 1
            yield cell, n
        if i + 1 < len(a) and (i + 1, j) not in seen:
            seen.add((i + 1, j))
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < len(b) and (i, j + 1) not in seen:
            seen.add((i, j + 1))
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))


class MultiIndex:
    """A grid of cells, the grids over the residuals of hot cells, and the group of each leaf.

    A leaf is a cell without a grid of its own, or a cell of such a grid;
    leaves are numbered cell * 2**21, plus 1 + the inner cell where there is one.
    """

    INNER = 1 << 21

    def __init__(self, grid: Grid):
        self.grid, self.inner = grid, {}
        self.rows: dict[int, int] = {}
        self.group: dict[int, int] = {}

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        cells = self.grid.cells(x)
        out = cells.astype(np.int64) * self.INNER
        for cell in set(np.unique(cells).tolist()).intersection(self.inner):
            at = np.flatnonzero(cells == cell)
            out[at] += 1 + self.inner[cell].cells(x[at] - self.grid.centre(cells[at]))
        return out

    def visited(self, x: np.ndarray, wanted: int) -> list[list[int]]:
        """For each query the leaves in the order of its walk until they hold `wanted` rows."""
        first, second = self.grid.distances(x)
        width = len(self.grid.second)
        out = []
        for n in range(len(x)):
            leaves, rows = [], 0
            for cell, held in walk(first[n], second[n], self.grid.filled, width):
                grid = self.inner.get(cell)
                if grid is None:
                    leaves.append(cell * self.INNER)
                    rows += held
                else:
                    near = grid.distances(x[[n]] - self.grid.centre(np.array([cell])))
                    for inner, inside in walk(near[0][0], near[1][0], grid.filled, len(grid.second)):
                        leaves.append(cell * self.INNER + 1 + inner)
                        rows += inside
                        if rows >= wanted:
                            break
                if rows >= wanted:
                    break
            out.append(leaves)
        return out

    def lay_out(self, group_rows: int) -> int:
        """Put near leaves into groups of about `group_rows` rows, halved along the widest dimension; the number of groups."""
        leaves = np.array(sorted(self.rows), np.int64)
        if not len(leaves):
            return 0
        weight = np.array([self.rows[leaf] for leaf in leaves.tolist()], np.int64)
        cells = leaves // self.INNER
        centres = self.grid.centre(cells)
        for n in np.flatnonzero(leaves % self.INNER).tolist():
            centres[n] += self.inner[int(cells[n])].centre(leaves[[n]] % self.INNER - 1)[0]
        waiting, groups = [np.arange(len(leaves))], 0
        while waiting:
            part = waiting.pop()
            if len(part) == 1 or weight[part].sum() <= group_rows:
                self.group.update(zip(leaves[part].tolist(), [groups] * len(part), strict=True))
                groups += 1
                continue
            part = part[np.argsort(centres[part, centres[part].var(axis=0).argmax()], kind="stable")]
            cut_at = int(np.searchsorted(np.cumsum(weight[part]), weight[part].sum() / 2))
            cut_at = min(max(cut_at, 1), len(part) - 1)
            waiting += [part[:cut_at], part[cut_at:]]
        return groups

    def nbytes(self) -> int:
        return self.grid.nbytes() + sum(grid.nbytes() for grid in self.inner.values()) + 200 * len(self.rows)


def centroids_for(rows: int, cell_rows: int, most: int) -> int:
    """Centroids of either half, so that the cells hold about `cell_rows` rows each."""
    return max(1, min(most, round((rows / cell_rows) ** 0.5)))


def build_index(entries: DataFrame, total: int, dims: int, cell_rows: int, max_centroids: int, sample_rows: int, group_rows: int) -> MultiIndex:
    """The index of `total` vectors in entries (unit): codebooks fitted on samples, counts over all rows."""
    spark = entries.sparkSession
    index = MultiIndex(Grid(_matrix(some_units(entries, total, sample_rows)["unit"], dims), centroids_for(total, cell_rows, max_centroids)))
    share = max(cell_rows, total / max_centroids**2)

    def counted() -> dict[int, int]:
        known = spark.sparkContext.broadcast(index)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    leaves, counts = np.unique(known.value.leaves(_matrix(batch.column(0), dims)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(counts)], names=["leaf", "n"])

        return {row["leaf"]: row["n"] for row in entries.select("unit").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}

    index.rows = counted()
    index.grid.filled = {leaf // MultiIndex.INNER: n for leaf, n in index.rows.items()}
    hot = {cell: n for cell, n in index.grid.filled.items() if n > HOT_SHARES * share}
    if hot:
        known = spark.sparkContext.broadcast(index)
        # Of each hot cell as many vectors as its share of the hot rows, of `sample_rows` in all.
        part = min(1.0, 1.1 * sample_rows / sum(hot.values()))

        def chosen(batches):
            for batch in batches:
                if batch.num_rows:
                    cells = known.value.grid.cells(_matrix(batch.column(0), dims))
                    at = pa.array(np.flatnonzero(np.isin(cells, list(hot))), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cells).take(at).cast(pa.int32())], names=["unit", "cell"])

        some = entries.select("unit").filter(F.pmod(F.xxhash64("unit", F.lit(9)), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) + 1))
        sample = some.mapInArrow(chosen, "unit binary, cell int").limit(sample_rows).toArrow()
        x, cells = _matrix(sample["unit"], dims), sample["cell"].to_numpy()
        for cell, n in sorted(hot.items()):
            own = x[cells == cell]
            if len(own) > 1:
                index.inner[cell] = Grid(own - index.grid.centre(np.array([cell])), centroids_for(n, int(share), min(max_centroids, len(own))))
        index.rows = counted()
        for leaf, n in index.rows.items():
            if leaf % MultiIndex.INNER:
                index.inner[leaf // MultiIndex.INNER].filled[leaf % MultiIndex.INNER - 1] = n
    index.lay_out(group_rows)
    if index.nbytes() > MAX_INDEX_BYTES:
        raise ValueError(f"an index of {index.nbytes()} bytes; at most {MAX_INDEX_BYTES} are broadcast: ask for fewer centroids")
    return index


def nearest_vectors(
    df: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    dims: int = 64,
    k: int = 5,
    min_candidates: int = 1024,
    cell_rows: int = 64,
    max_centroids: int = 1024,
    sample_rows: int = 16384,
    group_rows: int = 16384,
    queries: DataFrame | None = None,
) -> DataFrame:
    """Rows (id, near_id, rank, cosine): for every id with a usable vector its k most similar other ids.

    Ties in cosine go to the smaller id. Fewer than k other ids give fewer
    rows; an empty table gives none. Which vectors are usable, and which of an
    id's repeated rows counts, `unit_vectors` says; other columns are ignored.
    Equal vectors are collapsed to one entry that keeps its k+1 least ids, which
    are all that can ever come out, so a vector shared by a third of all rows
    costs one entry. `queries` (ids in a column `id_col`) limits whose
    neighbours are sought; all rows are always indexed.

    The codebooks are fitted on `sample_rows` vectors, those of hot cells on as
    many again; `min_candidates` is the recall knob: distinct vectors reranked
    for each query, at least. The number of cells follows the number of rows
    and cells of more than HOT_SHARES times their share are split, so that the
    work of a query stays the same whatever the size and density of the
    collection. A task reads a group of about `group_rows` vectors and the
    queries that meet it. The driver holds the index, whose size is checked.
    """
    units = unit_vectors(df, id_col, vector_col, dims)
    id_type = units.schema["id"].dataType.simpleString()
    keep = k + 1
    # A group of equal vectors is cut in salted parts first, so that no list grows with the group.
    least = F.slice(F.array_sort(F.collect_set("id")), 1, keep)
    parts = units.groupBy("unit", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("part")).agg(least.alias("ids"))
    entries = cut(parts.groupBy("unit").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")).withColumn("m", F.xxhash64("unit")))
    total = entries.count()
    index = df.sparkSession.sparkContext.broadcast(build_index(entries, total, dims, cell_rows, max_centroids, sample_rows, group_rows))

    asked = entries.select("unit", "m")
    if queries is not None:
        wanted = units.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        asked = asked.join(wanted.select("unit").distinct(), "unit", "left_semi")

    def member(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = index.value.leaves(_matrix(batch.column(0), dims))
                groups = [index.value.group[leaf] for leaf in leaves.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(leaves), *batch.columns], names=["g", "leaf", "m_unit", "m", "lead"])

    def probe(batches):
        group = index.value.group
        for batch in batches:
            for at in range(0, batch.num_rows, PROBE_ROWS):
                part = batch.slice(at, PROBE_ROWS)
                where, groups, lists = [], [], []
                for n, leaves in enumerate(index.value.visited(_matrix(part.column(0), dims), min_candidates)):
                    by_group: dict[int, list[int]] = {}
                    for leaf in leaves:
                        by_group.setdefault(group[leaf], []).append(leaf)
                    where += [n] * len(by_group)
                    groups += by_group
                    lists += by_group.values()
                rows = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), part.column(1).take(rows), part.column(0).take(rows), pa.array(lists, pa.list_(pa.int64()))], names=["g", "q", "unit", "leaves"])

    members = entries.select("unit", "m", F.col("ids")[0].alias("lead")).mapInArrow(member, f"g int, leaf long, m_unit binary, m long, lead {id_type}")
    probes = asked.mapInArrow(probe, "g int, q long, unit binary, leaves array<long>")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each query the `keep` best members of the group, ties by their least ids."""
        if not (left.num_rows and right.num_rows):
            return pa.table({"q": pa.array([], pa.int64()), "m": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        x, y = _matrix(left["unit"], dims), _matrix(right["m_unit"], dims)
        order = np.argsort(right["leaf"].to_numpy(), kind="stable")
        names, starts = np.unique(right["leaf"].to_numpy()[order], return_index=True)
        places = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))
        lists = left["leaves"].combine_chunks()
        asking = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        by_leaf = np.argsort(flat, kind="stable")
        met, begins = np.unique(flat[by_leaf], return_index=True)
        found_q, found_m, found_c = [], [], []
        for leaf, at in zip(met.tolist(), np.split(by_leaf, begins[1:]), strict=True):
            cols = places.get(leaf)
            if cols is None:
                continue
            rows = asking[at]
            for low in range(0, len(rows), PROBE_ROWS):
                some = rows[low : low + PROBE_ROWS]
                sims = x[some] @ y[cols].T
                # Single precision may swap what lies so close together; it is told apart in double precision.
                edge = np.partition(sims, len(cols) - keep, axis=1)[:, [len(cols) - keep]] - 2e-6 if len(cols) > keep else -np.inf
                i, j = np.nonzero(sims >= edge)
                found_q.append(some[i])
                found_m.append(cols[j])
                found_c.append(np.einsum("ij,ij->i", x[some[i]].astype(np.float64), y[cols[j]].astype(np.float64)))
        q, m, c = np.concatenate(found_q), np.concatenate(found_m), np.round(np.concatenate(found_c), 9)
        lead = np.argsort(np.argsort(np.array(right["lead"].to_pylist()), kind="stable"), kind="stable")
        qs, ms = left["q"].to_numpy(), right["m"].to_numpy()
        c = np.where(qs[q] == ms[m], 2.0, c)
        best = np.lexsort((lead[m], -c, q))
        q, m, c = q[best], m[best], c[best]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < keep
        return pa.table({"q": qs[q[kept]], "m": ms[m[kept]], "cosine": np.minimum(c[kept], 1.0)})

    # A group a hash partition or more: few large groups make even tasks.
    met = probes.groupBy("g").cogroup(members.groupBy("g"))
    found = met.applyInArrow(rerank, "q long, m long, cosine double")
    # Of each query the best entries of a few groups, with all that tie with the last of them; only then their ids are looked up.
    ranked = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("m").alias("m")))).alias("all"))
    last = F.try_element_at("all", F.lit(keep + 1))["d"]
    kept = ranked.select("q", F.explode(F.filter("all", lambda e: last.isNull() | (e["d"] <= last))).alias("e"))
    ids = entries.select("m", "ids")
    listed = F.array_sort(F.collect_list(F.struct(F.col("e.d").alias("d"), F.col("ids").alias("ids"))))
    flat = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct(e["d"].alias("d"), i.alias("id")))))
    best = kept.join(ids, kept["e.m"] == ids["m"]).groupBy("q").agg(listed.alias("near")).select("q", F.slice(F.array_sort(flat), 1, keep).alias("near"))
    everyone = units if queries is None else wanted
    own = everyone.select("id", F.xxhash64("unit").alias("q")).join(best, "q")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k)
    rows = own.select("id", F.posexplode(others).alias("at", "e"))
    return rows.select(F.col("id").alias(id_col), F.col("e.id").alias("near_id"), (F.col("at") + 1).alias("rank"), (-F.col("e.d")).alias("cosine"))


def neighbour_pairs(near: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct pairs id_a < id_b of `nearest_vectors` rows."""
    return near.select(F.least(id_col, "near_id").alias("id_a"), F.greatest(id_col, "near_id").alias("id_b")).distinct()
